"""The registered queries of the operators, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from souklens.llm import bpe, contamination, dialogues, language, licences, lines, nearest, neardup, phrases, quality, repeats, secrets, warc
from souklens.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary files, which every executor must be able to open.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def spans_sql(kind: str, rank: int, pattern: str, keeps: str = "true") -> str:
    """Spans of one kind: a match begins after the gaps and matches before it. ``m`` is the match."""
    pattern = pattern.replace("'", "''")
    return f"""list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
        'm': regexp_extract_all(t, '{pattern}')[i],
        'b': CAST(list_sum(list_transform(regexp_split_to_array(t, '{pattern}')[1:i], lambda g: length(g)))
             + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda g: length(g))), 0) AS BIGINT)}}),
        lambda x: {keeps.replace('{m}', 'x.m')}), lambda x: {{'b': x.b, 'r': {rank}, 'e': CAST(x.b + length(x.m) AS BIGINT), 'k': '{kind}'}})"""


ASSIGN_HEAD = "(?:" + either_case("password|passwd|secret|token|api") + either_case("_?key") + r""")["']?\x20*[:=]\x20*["']?"""
SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id,
    {spans_sql('assign', 0, ASSIGN_HEAD + '[A-Za-z0-9+/_.=-]+', "length(regexp_extract({m}, '^" + ASSIGN_HEAD.replace("'", "''") + "([A-Za-z0-9+/_.=-]+)$', 1)) >= 12")} AS a,
    {spans_sql('access', 1, 'AKIA[A-Z0-9]+', 'length({m}) >= 18')} AS c,
    {spans_sql('hex', 2, '[0-9a-f]{16,}')} AS h,
    list_concat({spans_sql('pem', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----')}, {spans_sql('forge', 4, 'gh[pousr]_[A-Za-z0-9]{36,}')},
        {spans_sql('chat', 5, 'xox[abprs]-[A-Za-z0-9-]{10,}')},
        {spans_sql('jwt', 6, 'eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}')}) AS o
  FROM d)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(c) AS BIGINT) AS n_access, CAST(len(h) AS BIGINT) AS n_hex,
  sha256(array_to_string(list_transform(list_sort(list_concat(a, c, h)), lambda x: x.k || ':' || x.b || ':' || x.e), ',')) AS base_sha256,
  array_to_string(list_transform(list_sort(list_concat(a, c, h, o)), lambda x: x.k || ':' || x.b || ':' || x.e), ',') AS spans
FROM s"""


@query("op1_jaccard_forest")
def jaccard_forest(spark: SparkSession, path: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, path, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("class").alias("class_id"), "copy_of", "n_links")


@query("op2_contamination")
def contaminated(spark: SparkSession, path: str) -> DataFrame:
    found = contamination.mark(table(spark, path, "documents"), table(spark, path, "benchmark"), keep=["doc_id"])
    items = F.transform("hits", lambda h: h["item"])
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), items.alias("items"))


@query("op3_language_network")
def language_network(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    network = language.train(docs.where(~held_out), pick=F.xxhash64("doc_id"))
    found = language.predict(docs, network, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op4_secret_ledger", SECRETS_SQL)
def secret_ledger(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    ledger = secrets.Ledger(spark, new_path(spark, "ledger"))
    ledger.scan(docs)
    found = ledger.findings(docs, keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.shown(base), 256).alias("base_sha256"),
                        secrets.shown("spans").alias("spans"))


@query("op5_licence_scan")
def licence_scan(spark: SparkSession, path: str) -> DataFrame:
    found = licences.scan(table(spark, path, "documents"), keep=["doc_id"])
    words = F.transform("places", lambda p: p["word"])
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
                        F.array_max(words).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


@query("op6_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, path: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, path, "documents"), WORD_BPE, keep=["doc_id"])


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query("op7_warc_packages", f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, CAST(unhex(sha1(payload)) AS BIT)::VARCHAR AS bits FROM p),
t AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY bits) AS target,
    array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', CAST(1 + list_sum(list_transform(range(5),
        lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> target THEN target END AS refers_to FROM t""")
def warc_packages(spark: SparkSession, path: str) -> DataFrame:
    archives = warc.write_archives(table(spark, path, "pages"))
    return warc.read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_line_dedup", f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {lines.LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.LEAST_DOCS}),
j AS (SELECT k.*, g.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def line_dedup(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    cut = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs), keep=["doc_id"])
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op9_repeated_passages")
def repeated_passages(spark: SparkSession, path: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, path, "documents"), keep=["doc_id"])
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["begin"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_token_fertility")
def token_fertility(spark: SparkSession, path: str) -> DataFrame:
    return quality.measure(table(spark, path, "documents"), PIECE_BPE, keep=["doc_id"])


@query("op11_phrase_trie", f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, {phrases.LONGEST + 1}) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= {phrases.LEAST}),
x AS (SELECT lang, phrase, w, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM c, range(1, {phrases.LONGEST}) t(cut) WHERE cut < k),
s AS (SELECT x.lang, x.phrase, x.a, x.cut, l.n AS l, r.n AS r, t.n AS n,
    CAST(1000::HUGEINT * x.a * t.n // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.rest JOIN t ON t.lang = x.lang),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
h AS (SELECT lang, array_to_string(w[b:b + j - 1], ' ') AS phrase, max(a) AS held FROM c, range(1, {phrases.LONGEST}) t(b), range(2, {phrases.LONGEST}) u(j) WHERE j < k AND b + j - 1 <= k GROUP BY ALL),
d AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN h USING (lang, phrase) WHERE nth = 1 AND (held IS NULL OR held < a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM d WHERE rank <= {phrases.PER_LANG}""")
def phrase_trie(spark: SparkSession, path: str) -> DataFrame:
    return phrases.collocations(table(spark, path, "documents"))


def way(frm: str, cost: str, letter: str, line: str | None = None) -> str:
    """The cheapest way to a place of the pattern with one more edit: cost, audit and repaired lines."""
    lines = f"{frm}.t" if line is None else f"list_append({frm}.t, {line})"
    return f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{letter}', 't': {lines}}}"


def cheapest(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def repair_step() -> str:
    """Ways to the four places (s0 nothing, s1 system, u user, a assistant) over one row: letter ``l``, ``gone``, ``cut``."""
    kept, named = (lambda frm, letter: way(frm, f"CASE WHEN l = '{letter}' AND NOT gone THEN cut ELSE 1000000 END", "K", "said")), \
        (lambda frm, role: way(frm, "CASE WHEN gone THEN 1000000 ELSE 2 + cut END", "R", f"'{role}:' || text"))
    user = [w for frm in ("s0", "s1", "a") for w in (kept(frm, "u"), named(frm, "user"))]
    return f"""{way('s0', '3', 'D')} AS s0, {cheapest(way('s1', '3', 'D'), kept('s0', 's'))} AS s1,
        {cheapest(way('u', '3', 'D'), *user)} AS u, {cheapest(way('a', '3', 'D'), kept('u', 'a'), named('u', 'assistant'))} AS a"""


def with_insertions(rows: str) -> str:
    user = cheapest("u", *[way(frm, "2", "I", "'user:'") for frm in ("s0", "s1", "a")])
    return f"SELECT conv, n, s0, s1, u, {cheapest('a', way('u', '2', 'I', quote('assistant:')))} AS a FROM (SELECT * REPLACE ({user} AS u) FROM ({rows}))"


def quote(text: str) -> str:
    return "'" + text + "'"


NOTHING = "{'c': 1000000, 'a': '', 't': CAST([] AS VARCHAR[])}"
REPAIR_SQL = f"""
WITH RECURSIVE r AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
z AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS dice FROM r),
d AS (SELECT conv, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role,
    CASE dice WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN dice = 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE dice <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS n, substr(role, 1, 1) AS l, role || ':' || text AS said,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e FROM d),
q AS (SELECT *, e = '' AS blank, e <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS dup, lag(l) OVER (PARTITION BY conv ORDER BY n) || l AS pair FROM o),
y AS (SELECT *, blank OR dup AS gone, CAST(NOT blank AND NOT dup AND e NOT IN ('.', '!', '?') AS INTEGER) AS cut FROM q),
t AS (SELECT conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    CAST(sum(cut) AS BIGINT) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM y GROUP BY conv),
w AS ({with_insertions(f"SELECT conv, CAST(0 AS BIGINT) AS n, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS s0, {NOTHING} AS s1, {NOTHING} AS u, {NOTHING} AS a FROM (SELECT DISTINCT conv FROM r)")}
    UNION ALL {with_insertions(f"SELECT w.conv, y.n, {repair_step()} FROM w JOIN y ON w.conv IS NOT DISTINCT FROM y.conv AND y.n = w.n + 1")}),
b AS (SELECT w.conv, w.n, {cheapest('s0', 'a')} AS best FROM w)
SELECT b.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM b LEFT JOIN t ON b.conv IS NOT DISTINCT FROM t.conv WHERE b.n = coalesce(t.rows, 0)"""


@query("op12_block_repair", REPAIR_SQL)
def block_repair(spark: SparkSession, path: str) -> DataFrame:
    rows, found = dialogues.repair(table(spark, path, "conversations"))
    return dialogues.digests(rows, found).withColumnRenamed("conv", "conv_id")


@query("op13_multi_index")
def multi_index(spark: SparkSession, path: str) -> DataFrame:
    return nearest.nearest(table(spark, path, "embeddings"))
