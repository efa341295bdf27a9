"""Near duplicates against all pairs, computed one by one."""

import random
import re

from souklens.llm import components, neardup
from souklens.llm.queries import QUERIES


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(rows, threshold=0.8, n=5):
    """(copy_of, class, n_links) by doc_id, for rows with distinct ids."""
    first, copies, sets = {}, {}, {}
    for doc, text in sorted(rows):
        words = words_of(text)
        key = ("words", *words) if words else ("raw", text) if text else ("alone", doc)
        copies[doc] = first.setdefault(key, doc)
        if copies[doc] == doc and words:
            k = min(n, len(words))
            sets[doc] = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
    links, root = dict.fromkeys(sets, 0), {d: d for d in sets}
    ids, pairs = sorted(sets), []
    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    near = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1:]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return {d: (c, root.get(c, c), links.get(c, 0)) for d, c in copies.items()}


def corpus(seed=5, groups=25, large=160):
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    prose = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    rows = [prose(draw.randint(1, 200)) for _ in range(150)]
    for _ in range(groups):
        base = prose(draw.randint(20, 300))
        rows += [edited(draw, base, vocabulary, draw.choice([0.0, 0.01, 0.02, 0.03])) for _ in range(draw.randint(2, 6))]
    base = prose(250)
    rows += [edited(draw, base, vocabulary, 0.012) for _ in range(large)] + [base] * 30
    texts = [" ".join(r) for r in rows] + ["", None, "", "!!!", "!!!", "one two", "One, two", "x " * 30_000]
    draw.shuffle(texts)
    return list(enumerate(texts))


def edited(draw, words, vocabulary, share):
    return [draw.choice(vocabulary) if draw.random() < share else w for w in words]


def result(df):
    return {r["doc"]: (r["copy_of"], r["class"], r["n_links"]) for r in df.collect()}


def test_all_links_of_a_corpus(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(n for *_, n in want.values()) > 500
    assert result(neardup.near_duplicates(df, recall=0.9999, trees=24)) == want
    assert result(neardup.near_duplicates(df, recall=0.9999, trees=24, unit=16)) == want  # nodes cut into blocks
    assert result(neardup.near_duplicates(df, recall=0.9999, trees=24, unit_bytes=20_000)) == want


def test_a_corpus_with_the_parameters_of_the_query(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = result(neardup.near_duplicates(df))
    assert {d: r[0] for d, r in got.items()} == {d: r[0] for d, r in want.items()}
    assert all(got[d][2] <= r[2] for d, r in want.items())
    assert sum(r[2] for r in got.values()) >= neardup.RECALL * sum(r[2] for r in want.values()) > 0


def test_query_finds_the_links(spark, con):
    want = brute(con.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: (r["copy_of"], r["class_id"], r["n_links"]) for r in QUERIES["op1_jaccard_forest"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_nulls_repeated_rows_and_names(spark):
    text = " ".join(f"a{i}" for i in range(100))
    rows = [(1, text, 0, "x"), (1, text, 0, "y"), (None, text, 0, "z"), (2, text + " b", 0, None), (3, None, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, tree string")
    found = sorted(((r["doc"], r["copy_of"], r["class"], r["n_links"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert found == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 3, 0), (None, None, None, 0)]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_depth_shortens_until_the_recall_is_reached():
    assert neardup.depth(0.8, 0.999, 10) == 3
    assert neardup.depth(0.8, 0.9, 10) == 7
    assert neardup.depth(0.95, 0.999, 10) > 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (200, 202), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}
