"""Phrase collocation mining by HAT-trie counting: which runs of words stand together far more often than apart.

A phrase of k words can reach the least count only if its parts do, so a pass over the texts counts only places
whose parts have passed. What has passed is known to the tasks as a bitmap of hashes, at most ``MOST_BITS`` bits;
a collision only lets a phrase in that is counted in vain. Most pairs of words are rare, and there are nearly as many
as words in the text: the first pass, which counts words, therefore also counts hashes of pairs, three bytes each, and
only pairs whose hash has enough places are counted as phrases. Passes: words and hashes of pairs; pairs and triples;
longer phrases.

A task numbers the words that it meets and puts runs of numbers into a HAT-trie (``HatTrie``): hash containers
of counts below a shallow trie of word numbers. A container that grows too large bursts into one for each next word;
when the trie holds too many phrases its largest subtrees are written out whole, as sorted runs. Spark deals
the runs by prefix (language and first two words) and merges them there, so a phrase that a third of all documents
hold is a row for each task, and one that is common with very many continuations is spread by its second word.

Words are runs of characters other than blank and tab in pieces between ``.,;:!?`` and line breaks, A-Z lower-cased.
Everything is counted per language. NULL language is ``und``, which also holds documents labelled so. NULL or empty
texts have no words. Rows count as often as they are there; ids and other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from souklens.llm.common import discard, mixed, quoted, slices, table

LEAST = 100
LONGEST = 5
PER_LANG = 2_000
#: Entries of a container before it bursts, levels of the trie, entries of a trie and words before it is written out.
BURST = 4_096
SHALLOW = 2
MOST_ENTRIES = 1 << 20
MOST_WORDS = 1 << 19
#: Bits of the bitmap of passed phrases for each of them, and at most.
BITS_EACH = 32
MOST_BITS = 1 << 27
#: Bits of a hash that pairs are counted by, pairs that a task holds, text (bytes) for each range of buckets.
BUCKET_BITS = 40
MOST_PAIRS = 8 << 20
RANGE_BYTES = 16 << 20
ROWS = 50_000
#: ``size`` of rows that hold buckets of pairs.
PAIRS = -1

RUNS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("prefix", T.LongType()), T.StructField("phrase", T.BinaryType()),
                     T.StructField("hash", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("n", T.LongType())])

#: Bytes: capitals to small letters, piece ends to line feeds, tabs to blanks.
SHAPE = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"."


class HatTrie:
    """Counts of equally long rows of numbers.

    ``root`` is a container (Counter of the remaining numbers as big-endian bytes, so that their order is that of the
    numbers) or a trie node (dict from the next number to a container or node), at most ``SHALLOW`` nodes deep.
    """

    def __init__(self, size: int, burst: int = BURST, shallow: int = SHALLOW):
        self.size, self.burst, self.shallow = size, burst, min(shallow, size - 1)
        self.root: Counter | dict = Counter()
        self.entries = 0

    def add(self, rows: np.ndarray) -> None:
        """Count every row of an integer matrix; equal rows are counted together first."""
        if len(rows):
            rows, counts = distinct(rows)
            keys = np.ascontiguousarray(rows.astype(">i4")).view(f"V{self.size * 4}").ravel().tolist()
            self.root = self._put(self.root, rows, keys, counts.tolist(), 0)

    def _put(self, node: Counter | dict, rows: np.ndarray, keys: list[bytes], counts: list[int], depth: int) -> Counter | dict:
        """Count ``keys``, the bytes of ``rows``; sorted, and alike in the first ``depth`` numbers."""
        if isinstance(node, Counter):
            before, skip, held = len(node), depth * 4, node.get
            for key, n in zip(keys, counts, strict=True):
                rest = key[skip:]
                node[rest] = held(rest, 0) + n
            self.entries += len(node) - before
            return self._burst(node) if len(node) > self.burst and depth < self.shallow else node
        borders = [0, *(np.flatnonzero(np.diff(rows[:, depth])) + 1).tolist(), len(rows)]
        for word, begin, end in zip(rows[borders[:-1], depth].tolist(), borders, borders[1:]):
            node[word] = self._put(node.get(word) or Counter(), rows[begin:end], keys[begin:end], counts[begin:end], depth + 1)
        return node

    @staticmethod
    def _burst(container: Counter) -> dict:
        node: dict[int, Counter] = {}
        for rest, n in container.items():
            node.setdefault(int.from_bytes(rest[:4], "big"), Counter())[rest[4:]] = n
        return node

    def _walk(self, node: Counter | dict, prefix: bytes, rows: list[bytes], counts: list[int]) -> None:
        if isinstance(node, Counter):
            keys = sorted(node)
            rows.extend([prefix + rest for rest in keys])
            counts.extend([node[rest] for rest in keys])
        else:
            for word in sorted(node):
                self._walk(node[word], prefix + word.to_bytes(4, "big"), rows, counts)

    def _held(self, node: Counter | dict) -> int:
        return len(node) if isinstance(node, Counter) else sum(map(self._held, node.values()))

    def spill(self, left: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out subtrees of the root, the largest first, until ``left`` entries stay. They come by their first number,
        as sorted runs of rows and their counts; small subtrees share a run, as a run has a cost of its own."""
        if isinstance(self.root, Counter):
            subtrees = [(b"", self.root)]
            self.root = Counter()
        else:
            sizes = {word: self._held(node) for word, node in self.root.items()}
            chosen, held = [], self.entries
            for word in heapq.nlargest(len(sizes), sizes, key=sizes.get):
                if held <= left:
                    break
                held -= sizes[word]
                chosen.append(word)
            subtrees = [(word.to_bytes(4, "big"), self.root.pop(word)) for word in sorted(chosen)]
        rows, counts = [], []
        for nth, (prefix, node) in enumerate(subtrees):
            self._walk(node, prefix, rows, counts)
            if rows and (len(rows) >= ROWS or nth == len(subtrees) - 1):
                self.entries -= len(rows)
                yield np.frombuffer(b"".join(rows), ">i4").reshape(-1, self.size).astype(np.int64), np.array(counts, np.int64)
                rows, counts = [], []


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix of numbers from 0, sorted, and how often each is there. Several numbers are packed
    into one of 63 bits: most rows are one such number, which sorts faster than columns."""
    bits = max(1, int(rows.max()).bit_length())
    each, size = 63 // bits, rows.shape[1]
    packs = []
    for begin in range(0, size, each):
        pack = rows[:, begin].copy()
        for k in range(begin + 1, min(begin + each, size)):
            pack = pack << bits | rows[:, k]
        packs.append(pack)
    if len(packs) == 1:
        values, counts = np.unique(packs[0], return_counts=True)
        return np.stack([values >> bits * (size - 1 - k) & (1 << bits) - 1 for k in range(size)], axis=1), counts
    order = np.lexsort(packs[::-1])
    packs = [pack[order] for pack in packs]
    first = np.flatnonzero(np.concatenate([[True], np.any([pack[1:] != pack[:-1] for pack in packs], axis=0)]))
    return rows[order[first]], np.diff(np.append(first, len(rows)))


class Words(dict):
    """Numbers of words, given as they are met; number 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({END: 0})
        self.words, self.hashes, self.seed = [END], array("Q", [0]), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return number


def hashes(numbers: np.ndarray, of_word: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    n = max(0, len(numbers) - size + 1)
    one = of_word[numbers]
    return hashes_of([one[k:n + k] for k in range(size)])


def hashes_of(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their first words, second words and so on."""
    out = words[0].copy()
    for word in words[1:]:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def buckets(found: np.ndarray) -> np.ndarray:
    """The bits of hashes that pairs are counted and looked up by."""
    return found >> np.uint64(64 - BUCKET_BITS)


def passed(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the hashes."""
    place = buckets(found) & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit values, as steps, and 32-bit counts; byte planes, of which most are nearly all zero."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zlib.compress(steps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(12, -1)
    values = np.ascontiguousarray(planes[:8].T).view("<u8").ravel().astype(np.uint64).cumsum(dtype=np.uint64)
    return values, np.ascontiguousarray(planes[8:].T).view("<u4").ravel().astype(np.int64)


class Pairs:
    """Counts of the buckets of pairs, sent by ranges of buckets."""

    def __init__(self, range_bits: int):
        self.shift, self.parts, self.held = np.uint64(BUCKET_BITS - range_bits), [], 0

    def add(self, found: np.ndarray) -> None:
        self.parts.append(buckets(found))
        self.held += len(found)

    def rows(self) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(self.parts or [np.zeros(0, np.uint64)]), return_counts=True)
        ranges = (values >> self.shift).astype(np.int64)
        borders = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(values)]
        spans = list(zip(borders, borders[1:])) if len(values) else []
        self.parts, self.held = [], 0
        return _batch([""] * len(spans), ranges[borders[:-1]] if spans else ranges, [packed(values[b:e], np.minimum(counts[b:e], 2**32 - 1)) for b, e in spans], [0] * len(spans), PAIRS, [0] * len(spans))


class _Task:
    """Tries of one task, one for each language and number of words; all share the bounds on entries and words.
    ``bits`` tells which phrases of ``part`` words have passed."""

    def __init__(self, sizes: list[int], part: int, bits: np.ndarray | None, range_bits: int | None):
        self.sizes, self.part, self.bits = sizes, part, bits
        self.words: dict[str, Words] = {}
        self.tries: dict[tuple[str, int], HatTrie] = {}
        self.totals: Counter = Counter()
        self.pairs = Pairs(range_bits) if range_bits is not None else None

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.words:
            self.words[lang] = Words(lang)
        words = self.words[lang]
        numbers = np.array(list(map(words.__getitem__, text.translate(SHAPE).replace(b"\n", b" . ").split())), np.int64)
        here = numbers > 0
        self.totals[lang] += int(here.sum())
        of_word = np.array(words.hashes, np.uint64)
        if self.pairs is not None:
            self.pairs.add(hashes(numbers, of_word, 2)[here[:-1] & here[1:]])
        good = passed(hashes(numbers, of_word, self.part), self.bits) if self.bits is not None else here
        inside = np.concatenate([[0], np.cumsum(~here)])
        for size in self.sizes:
            n = len(numbers) - size + 1
            if n > 0:
                fits = inside[size:] == inside[:n]
                for k in range(size - self.part + 1):
                    fits &= good[k:n + k]
                at = np.flatnonzero(fits)
                self.tries.setdefault((lang, size), HatTrie(size)).add(np.stack([numbers[at + k] for k in range(size)], axis=1))

    def full(self) -> bool:
        return sum(t.entries for t in self.tries.values()) > MOST_ENTRIES or sum(map(len, self.words.values())) > MOST_WORDS

    def runs(self, share: float) -> Iterator[pa.RecordBatch]:
        """Subtrees written out until a share of the entries stays; with 0, words and totals too."""
        for (lang, size), trie in self.tries.items():
            words, of_word, start = self.words[lang].words, np.array(self.words[lang].hashes, np.uint64), min(2, size)
            for rows, counts in trie.spill(int(trie.entries * share)):
                for at in range(0, len(rows), ROWS):
                    part = rows[at:at + ROWS]
                    each = [of_word[part[:, k]] for k in range(size)]
                    prefix, found = (hashes_of(each[:k]).view(np.int64) for k in (start, size))
                    phrase = list(map(b" ".join, zip(*[[words[w] for w in part[:, k].tolist()] for k in range(size)], strict=True)))
                    yield _batch([lang] * len(part), prefix, phrase, found, size, counts[at:at + ROWS])
        if not share:
            langs = [(lang, n) for lang, n in self.totals.items()]
            yield _batch([lang for lang, _ in langs], [0] * len(langs), [b""] * len(langs), [0] * len(langs), 0, [n for _, n in langs])
            self.words, self.tries, self.totals = {}, {}, Counter()


def _batch(langs, prefix, phrases, found, size: int, counts) -> pa.RecordBatch:
    columns = [langs, prefix, phrases, found, np.full(len(langs), size, np.int32), counts]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RUNS.names)


def _runs(texts: DataFrame, sizes: list[int], part: int = 1, bitmap=None, range_bits: int | None = None) -> DataFrame:
    """What the tasks count: phrases of ``sizes`` words, the words of each language (size 0) and, with ``range_bits``,
    buckets of pairs (size ``PAIRS``)."""

    def run(batches):
        task = _Task(sizes, part, np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None, range_bits)
        for batch in batches:
            for some in slices(batch, 1):
                langs: dict[str, list[bytes]] = {}
                for lang, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if text:
                        langs.setdefault(lang, []).append(text)
                for lang, part_texts in langs.items():
                    task.add(lang, b"\n".join(part_texts))
                if task.full():
                    yield from task.runs(0.5 if sum(map(len, task.words.values())) <= MOST_WORDS else 0)
                if task.pairs is not None and task.pairs.held > MOST_PAIRS:
                    yield task.pairs.rows()
        yield from task.runs(0)
        if task.pairs is not None:
            yield task.pairs.rows()

    return texts.mapInArrow(run, RUNS)


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """Phrases with at least ``least`` places, merged by prefix, and the words of each language."""
    merged = (runs.where(F.col("size") >= 0).repartition("lang", "prefix").groupBy("lang", "prefix", "phrase", "size")
              .agg(F.any_value("hash").alias("hash"), F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0)))
    return merged.select("lang", F.col("phrase").cast("string").alias("phrase"), "hash", "size", "n")


def _passing(runs: DataFrame, least: int) -> DataFrame:
    """Buckets of pairs with at least ``least`` places."""

    def sums(group: pa.Table) -> pa.Table:
        values, counts = (np.concatenate(x) for x in zip(*[unpacked(b) for b in group["phrase"].to_pylist()], strict=True))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return pa.table({"bucket": values[first][np.add.reduceat(counts, first) >= least].astype(np.int64)})

    return runs.where(F.col("size") == PAIRS).select("prefix", "phrase").groupBy("prefix").applyInArrow(sums, "bucket long")


def _bitmap(found: DataFrame) -> bytes:
    """Bitmap of the column ``bucket``."""
    bits = min(MOST_BITS, max(1 << 18, 1 << (found.count() * BITS_EACH).bit_length()))
    place = F.col("bucket").bitwiseAND(F.lit(bits - 1)) + 1  # Spark numbers bits from 1
    parts = found.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(bits // 8)
    for r in parts.collect():  # at most MOST_BITS bits
        begin = (r["part"] - 1) * len(r["bits"])
        out[begin:begin + len(r["bits"])] = r["bits"]
    return bytes(out)


def frequent(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``phrase``, ``size`` and ``n`` of every phrase of up to ``longest`` words with ``least`` places or more,
    and with size 0 the number of words of each language. Writes its counts and runs jobs when the frame is built."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"), quoted(text).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = min(24, max(6, int(size // RANGE_BYTES).bit_length()))
    runs, runs_at = table(spark, _runs(texts, [1], range_bits=range_bits), "word-runs")
    every, _ = table(spark, _merged(runs, least), "words")
    found, _ = table(spark, _passing(runs, least), "pairs")
    discard(spark, runs_at)
    for part, sizes in ((2, [2, 3]), (3, list(range(4, longest + 1)))):
        if sizes := [s for s in sizes if s <= longest]:
            bitmap = spark.sparkContext.broadcast(_bitmap(found))
            counts, _ = table(spark, _merged(_runs(texts, sizes, part, bitmap), least).where("size > 0"), "phrases")
            found = counts.where(F.col("size") == part + 1).select(F.shiftrightunsigned("hash", 64 - BUCKET_BITS).alias("bucket"))
            every = every.unionByName(counts)
    return every.select("lang", "phrase", "size", "n")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, per_lang: int = PER_LANG, within: int = 100,
) -> DataFrame:
    """The ``per_lang`` best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a`` (its places), ``l`` and ``r``
    (those of the parts at its weakest cut), ``n`` (words of the language) and ``score`` = floor(1000 a n / (l r)).
    A phrase inside a longer one with at least ``within`` percent of its places is left out."""
    counts, _ = table(df.sparkSession, frequent(df, text, lang, least, longest), "phrase-counts")
    words = F.split("phrase", " ", -1)
    total = counts.where("size = 0").select("lang", F.col("n").alias("total"))
    known = counts.where("size > 0")
    candidates = known.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    join = lambda w, begin, n: F.array_join(F.slice(w, begin, n), " ")
    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", join(words, F.lit(1), F.col("cut")).alias("head"), join(words, F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    score = F.expr("1000BD * CAST(a AS DECIMAL(19,0)) * CAST(total AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "a", "total")).alias("m")).select("lang", "phrase", "m.*")
    # parts of longer candidates with their places
    spans = [(begin, n) for n in range(2, longest) for begin in range(1, longest - n + 2)]
    inner = F.array(*[F.when((F.col("size") > n) & (F.col("size") >= begin + n - 1), join(words, F.lit(begin), F.lit(n))) for begin, n in spans]) if spans else F.array(F.lit(None).cast("string"))
    holders = (candidates.where("size > 2").select("lang", "a", F.explode(inner).alias("phrase")).where(F.col("phrase").isNotNull())
               .groupBy("lang", "phrase").agg(F.max("a").alias("held")))
    stays = scored.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < within * F.col("a")))
    # the best of each language, first among a share of its phrases, so that a language with very many is split
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = stays.withColumn("share", share).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("nth") <= per_lang)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= per_lang)
            .select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))
