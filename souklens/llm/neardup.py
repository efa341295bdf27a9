"""Near duplicates: MinHash banding over word 5-grams, then exact verification.

1. Texts whose words agree are copies; their class has one representative. It gets a MinHash signature,
   cut into the labels of ``TREES`` tries.
2. All labels have one length: the longest at which two texts at the threshold share one in some trie with
   probability ``RECALL`` or more. It follows from these parameters, not from the data, so no label is shortened
   text by text, and a trie is a single level: texts with the same label are a node.
3. Nodes of several tries with the same few members are looked at once. Large nodes are cut into blocks,
   and each pair of blocks is a unit of work of bounded size, so that a node may hold a third of all texts.
4. A unit computes the exact Jaccard similarity of its pairs. A pair counts in the first trie in which
   its labels share the prefix, hence once. A unit returns, for each of its texts, the number of its links
   and one member of its linked group (not the pairs themselves).
5. Groups are united over all units by components, in rounds of joins written to the shared folder.

Words are runs of letters, digits and characters beyond ASCII, in lower case; fewer than five words are a
single shingle. A NULL or empty text, and a row without id, is a class of its own without links. Texts
without words are copies if they are equal. Rows that share an id are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from souklens.llm.common import Substrings, expand_texts, mixed, quoted, row_id, store, word_places
from souklens.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES = 10
LONGEST = 8
RECALL = 0.999
#: A node of up to so many texts and bytes is one unit; larger ones are cut into blocks of about half as much.
UNIT = 512
UNIT_BYTES = 32 << 20

#: Separators become blanks; letters (lower case by then), digits and all bytes from 128 stay.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def depth(threshold: float, recall: float, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which a pair at the threshold meets in some trie with probability ``recall``."""
    for d in range(longest, 0, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} tries cannot reach a recall of {recall}")


class Shingles:
    """Sets of hashed word n-grams and their signatures."""

    def __init__(self, words: int = WORDS, values: int = 0, seed: int = 11):
        self.words, self.hashes = words, Substrings()
        random = np.random.default_rng(seed)
        self.odd = random.integers(0, 1 << 63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = random.integers(0, 1 << 63, values, dtype=np.uint64)

    @staticmethod
    def words_of(text: str) -> bytes:
        return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())

    def of(self, line: bytes) -> np.ndarray:
        """Distinct shingles of words with single blanks between them; none without words."""
        data = np.frombuffer(line, np.uint8)
        begins, ends = word_places(data)
        n = min(self.words, len(begins))
        if not n:
            return np.zeros(0, np.uint64)
        return np.unique(self.hashes.of(self.hashes.sums(data), begins[:len(begins) - n + 1], ends[n - 1:]))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        return np.array([(mixed(shingles * a + b) >> np.uint64(32)).min() for a, b in zip(self.odd, self.shift, strict=True)], "<u4")


MARKS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("signature", T.BinaryType()),
    T.StructField("bytes", T.LongType())])


def marks(df: DataFrame, doc: str, text: str, words: int, values: int) -> DataFrame:
    """For each row its class (equal words; NULL if it is alone) and signature (NULL without words)."""
    rows = df.select(quoted(doc).cast("long").alias("doc"), row_id(text).alias("row"), quoted(text).alias("text"))

    def make():
        shingles = Shingles(words, values)

        def work(docs, rows, texts):
            classes, signatures, sizes = [], [], []
            for text in texts:
                line = shingles.words_of(text or "")
                sizes.append(len(line))
                classes.append(hashlib.blake2b(line or (text or "").encode("utf-8", "surrogatepass"), digest_size=16, person=b"words" if line else b"raw").digest() if text else None)
                signatures.append(shingles.signature(shingles.of(line)).tobytes() if line else None)
            yield pa.RecordBatch.from_arrays([docs, rows, pa.array(classes, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int64())], MARKS.names)
        return work

    return expand_texts(rows, "text", ["doc", "row"], MARKS, make)


def nodes(classes: DataFrame, trees: int, deep: int) -> DataFrame:
    """A row for each representative and trie, with the prefix of its label."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("signature", t * (4 * deep) + 1, F.lit(4 * deep)))).alias("tree", "prefix")
    return classes.where(F.col("signature").isNotNull()).select(at, "doc", "row", "bytes")


def units(found: DataFrame, size: int, size_bytes: int) -> DataFrame:
    """Members of all units of work: ``unit``, ``tree``, ``doc``, ``row``, ``side`` (0: of the first block,
    1: of the second; -1: the unit is one block or a whole node). ``found`` are written nodes."""
    half = F.greatest(F.ceil(F.col("n") / (size // 2)), F.ceil(F.col("bytes") / (size_bytes // 2)))
    whole = (F.col("n") <= size) & (F.col("bytes") <= size_bytes)
    counts = store(found.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1").select(
        "tree", "prefix", F.when(~whole, half).cast("int").alias("blocks")), "near-nodes")
    member = found.drop("bytes").join(counts, ["tree", "prefix"])
    small = member.where("blocks IS NULL").groupBy("tree", "prefix").agg(F.sort_array(F.collect_list(F.struct("doc", "row"))).alias("members"))
    # copies of a group meet in most tries: one unit, of the first of them
    small = small.groupBy("members").agg(F.min("tree").alias("tree"))
    small = small.select(F.sha2(F.to_json("members"), 256).alias("unit"), "tree", F.explode("members").alias("m")).select("unit", "tree", "m.doc", "m.row", F.lit(-1).alias("side"))
    large = (member.where("blocks IS NOT NULL").withColumn("mine", F.pmod(F.xxhash64("doc", "row"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    first, second = F.least("mine", "other"), F.greatest("mine", "other")
    large = large.select(F.concat_ws(":", "tree", F.hex("prefix"), first, second).alias("unit"), "tree", "doc", "row",
                         F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    return small.unionByName(large)


def linked(sets: list[np.ndarray], signatures: np.ndarray, tree: int, sides: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of a unit are linked, as a symmetric matrix. ``signatures`` is (members, tries, depth)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, flat = np.unique(flat, return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    present, out = np.zeros(int(flat.max()) + 1, np.int64), np.zeros((len(sets), len(sets)), bool)
    for i in range(len(sets)):
        same = (signatures == signatures[i]).all(2)
        pairs = same.any(1) & (same.argmax(1) == tree)
        pairs[i] = False
        pairs &= (sides < 0) | (sides != sides[i])
        if not pairs.any():
            continue
        mine = flat[begins[i]:begins[i] + sizes[i]]
        present[mine] = 1
        common = np.add.reduceat(present[flat], begins)
        present[mine] = 0
        out[i] = pairs & (common >= threshold * (sizes + sizes[i] - common) - 1e-9)
    return out


LINKS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()), T.StructField("links", T.LongType()), T.StructField("other", T.LongType())])


def verified(members: DataFrame, trees: int, deep: int, words: int, threshold: float) -> DataFrame:
    """For each text with links in a unit, how many, and the least document of its linked group there."""

    def verify(unit: pa.Table) -> pa.Table:
        docs, rows = unit.column("doc").to_pylist(), unit.column("row").to_pylist()
        shingles = Shingles(words)
        sets = [shingles.of(shingles.words_of(t)) for t in unit.column("text").to_pylist()]
        signatures = np.frombuffer(b"".join(unit.column("signature").to_pylist()), "<u4").reshape(len(docs), trees, deep)
        found = linked(sets, signatures, unit.column("tree")[0].as_py(), unit.column("side").to_numpy(), threshold)
        root = np.array(docs, np.int64)
        while True:  # the least document spreads along links
            least = np.minimum(root, np.where(found, root[None, :], np.iinfo(np.int64).max).min(1))
            if (least == root).all():
                break
            root = least
        out = [(docs[i], rows[i], n, int(root[i])) for i, n in enumerate(found.sum(1).tolist()) if n]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=LINKS.names)

    return members.groupBy("unit").applyInArrow(verify, LINKS)


def near_duplicates(
    df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, unit: int = UNIT, unit_bytes: int = UNIT_BYTES,
) -> DataFrame:
    """For each row ``doc`` (its id), ``row`` (see ``row_id``), ``copy_of`` (least id with the same words),
    ``class`` (least id of all that links lead to) and ``n_links`` (other texts at the threshold or above).
    Of linked texts each pair is found with probability ``recall`` or more, at the threshold; none is wrong."""
    deep = depth(threshold, recall, trees)
    marked = store(marks(df, doc, text, words, trees * deep), "near-marks")
    classes = store(marked.where(F.col("doc").isNotNull() & F.col("class").isNotNull()).groupBy("class").agg(
        F.min(F.struct("doc", "row")).alias("first"), F.any_value("signature").alias("signature"), F.any_value("bytes").alias("bytes")).select(
            "class", "first.doc", "first.row", "signature", "bytes"), "near-classes")
    members = store(units(store(nodes(classes, trees, deep), "near-tries"), unit, unit_bytes), "near-units")
    # texts and signatures of all that have a partner, each once; then to their units
    needed = members.select("doc", "row").distinct().join(classes.select("doc", "row", "signature"), ["doc", "row"])
    texts = df.select(quoted(doc).cast("long").alias("doc"), row_id(text).alias("row"), quoted(text).cast("string").alias("text")).where("doc IS NOT NULL")
    held = store(texts.join(needed, ["doc", "row"]).dropDuplicates(["doc", "row"]), "near-texts")
    links = store(verified(members.join(held, ["doc", "row"]), trees, deep, words, threshold), "near-links")
    roots = components(links.where("doc <> other").select(F.col("doc").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("doc", "row").agg(F.sum("links").alias("n_links"))
    reached = (classes.select("class", "doc", "row").join(counts, ["doc", "row"], "left").join(roots.withColumnRenamed("node", "doc"), "doc", "left")
               .select(F.col("class"), F.col("doc").alias("copy_of"), F.coalesce("root", "doc").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    reached = store(reached, "near-classes-linked")
    joined = marked.select("doc", "row", "class").join(reached, F.when(marked["doc"].isNotNull(), marked["class"]) == reached["class"], "left")
    return joined.select("doc", "row", F.coalesce("copy_of", "doc").alias("copy_of"), F.coalesce("root", "doc").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
