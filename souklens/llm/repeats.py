"""Removal of repeated passages by prefix-free parsing.

A text is cut at triggers: places whose rolling hash of ``GRAM`` bytes is the least among the places of
some ``MATCH``-byte window. A trigger depends on the bytes of its window alone, so equal windows are cut
alike, and every window holds one. Of adjacent equal hashes only the first and the last count. A window that equals
the one ``period`` bytes before it (up to ``MOST_PERIOD``: rules, padding, blanks) is a repeat by that alone: it is
told in its text, both when triggers are sought, which it then needs none of, and when the text is cut; the first
window of its content in a text keeps its triggers. Long texts are parsed in pieces of ``PIECE`` bytes that overlap by
all that a trigger and its phrase depend on, so a text takes memory for a piece besides its bytes. A phrase is a trigger with all bytes that a window around it may reach;
equal phrases stand for equal windows. The dictionary has every distinct phrase with its first place.

1. Parse: phrases of all texts, in the order (trigger, phrase, place). Every place of a phrase but its first
   is repeated with all windows around the trigger. Phrases of a trigger that has no other are settled.
2. The others (borders of passages, edits) are compared in parts: the windows around a trigger are dealt to
   ``PARTS`` groups by their begin; in the order (bytes common to a group, bytes of the group, place) a group
   is settled if it is not the first of its bytes, or if no other group shares the common bytes.
3. The windows of groups that are left, each counted at its own trigger, in the order (content, place).
4. The spans of each document are united and cut from its text.

Corpus order is thus the sorted order of the dictionary and of its windows, cut at ``MATCH`` bytes, computed
by Spark's range partitioning; no suffix array of the corpus lies in one task. A phrase of very many places
spreads over partitions. Contents are compared by hashes of 64 bits twice over. Nothing is capped; work
grows with the bytes, and with borders in steps 2 and 3. Each step is written to the shared folder, and
deleted when the next one has read it.

NULL is an empty text. A row without id comes after all others. Rows that share an id are ordered place
by place and told apart by the 64-bit hash of their text; rows that also share it are cut alike. Texts below ``MATCH`` bytes stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from souklens.llm.common import Substrings, discard, expand_texts, fresh, mixed, quoted, release, row_id, table

MATCH = 100
GRAM = 32
PARTS = 4
#: Periods of repetition that are told inside a text.
MOST_PERIOD = 32
#: Probes of periods that are compared at once.
PROBES = 1 << 16
#: Bytes of a text that are parsed at once.
PIECE = 4 << 20
#: ``place`` is a byte offset, then the number of the part; ``row`` tells rows with the same id apart.
PART_BITS = 3

#: Places of one content: ``key`` and ``part`` are hashes, and rows with an equal ``part`` of a key are equal.
PLACES = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "part", "doc", "place", "row")])
#: What a sorted pass says of a place: it is a repeat, the first of its part in a key of several parts, or it
#: stands at the edge of a partition; a mark is a copy of the head of a partition's last run.
REPEAT, HEAD, EDGE, MARK = 0, 1, 2, 3
FOUND = T.StructType([T.StructField("kind", T.IntegerType()), *PLACES.fields])


def sliding(x: np.ndarray, width: int, better) -> np.ndarray:
    """``better`` (minimum or maximum) of every ``width`` adjacent values."""
    size = 1
    while 2 * size <= width:
        x = better(x[:-size], x[size:])
        size *= 2
    return better(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def likely_periods(data: np.ndarray, match: int) -> np.ndarray:
    """All periods up to ``MOST_PERIOD`` at which some ``match`` bytes may repeat: at one of the probed places the
    bytes of a word are the same that much later. Any stretch of ``match`` equal bytes holds a whole probed word."""
    width = 8 if match >= 16 else 1
    most, step = min(MOST_PERIOD, len(data) - match), match - width + 1
    padded, found = np.concatenate([data, np.zeros(most + width, np.uint8)]), np.zeros(most, bool)
    words = np.ndarray(((len(data) - 1) // step + 1, most + 1), f"<u{width}", padded, 0, (step, 1))
    for begin in range(0, len(words), PROBES):
        block = words[begin:begin + PROBES]
        found |= (block[:, 1:] == block[:, :1]).any(0)
    return np.flatnonzero(found) + 1


def periodic(data: np.ndarray, match: int) -> list[tuple[int, int]]:
    """Ranges of begins of windows that equal the window some ``MOST_PERIOD`` bytes or less before them."""
    out = []
    if len(data) <= match:
        return out
    for period in likely_periods(data, match).tolist():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], data[period:] == data[:-period], [False]]).astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= match
        out += zip((begins[long] + period).tolist(), (ends[long] - match + 1 + period).tolist(), strict=True)
    return out


class Parser:
    """Triggers, phrases and windows of single texts of at least ``match`` bytes."""

    def __init__(self, match: int = MATCH, gram: int = GRAM):
        self.match, self.gram, self.hashes = match, gram, Substrings()

    def hashed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash at every offset, the least hash of every window, running sums."""
        sums, at = self.hashes.sums(data), np.arange(len(data) - self.gram + 1)
        found = self.hashes.of(sums, at, at + self.gram)
        return found, sliding(found, self.match - self.gram + 1, np.minimum), sums

    def triggers(self, data: np.ndarray, found: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Offsets of the triggers of all windows that do not repeat periodically."""
        width = self.match - self.gram + 1
        edge, wanted = np.zeros(width - 1, np.uint64), least
        for begin, end in periodic(data, self.match):
            wanted = least.copy() if wanted is least else wanted
            wanted[begin:end] = 0
        at = np.flatnonzero(sliding(np.concatenate([edge, wanted, edge]), width, np.maximum) == found)
        border = np.r_[True, found[1:] != found[:-1], True]
        return at[border[at] | border[at + 1]]

    def pieces(self, data: np.ndarray):
        """Parts of a text for each of which all about its own triggers can be told, where they begin, and the first and end of its own offsets in them."""
        margin = 2 * self.match
        for begin in range(0, max(1, len(data)), PIECE):
            low, high = max(0, begin - margin), min(len(data), begin + PIECE + margin)
            if high - low >= self.match:
                yield data[low:high], low, begin - low, min(begin + PIECE, len(data)) - low

    def reach(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the bytes that windows around triggers ``at`` cover in a text of ``n`` bytes."""
        return np.maximum(at - (self.match - self.gram), 0), np.minimum(at + self.match, n)

    def phrases(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset, trigger hash and phrase hash of all phrases."""
        out = []
        for part, low, begin, end in self.pieces(data):
            found, least, sums = self.hashed(part)
            at = self.triggers(part, found, least)
            at = at[(at >= begin) & (at < end)]
            first, final = self.reach(at, len(part))
            out.append((at + low, found[at], mixed(self.hashes.of(sums, first, final) + (at - first).astype(np.uint64))))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def groups(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Groups of windows around the triggers ``at`` that hold a window of its own: offset, number, hash
        of the bytes that all windows of such a group share, hash of all bytes of the group."""
        out = []
        for part, low, begin, end in self.pieces(data):
            own = at[(at >= begin + low) & (at < end + low)] - low
            if len(own):
                p, *more = self._groups(part, own)
                out.append((p + low, *more))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _groups(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        found, least, sums = self.hashed(data)
        out = []
        for number, (first, last) in enumerate(self.parts()):
            lo, hi = np.maximum(at - last, 0), np.minimum(at - first, len(least) - 1)
            own = lo <= hi
            own[own] = self._least_at(least, found, at[own], lo[own], hi[own])
            p, lo, hi = at[own], lo[own], hi[own]
            common = self.hashes.of(sums, p - first, p - last + self.match)
            whole = self.hashes.of(sums, lo, hi + self.match) + (p - lo).astype(np.uint64)
            out.append((p, np.full(len(p), number), mixed(common ^ mixed(found[p] + np.uint64(number))), mixed(whole)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def parts(self) -> list[tuple[int, int]]:
        """Least and largest number of bytes before the trigger in the windows of each group."""
        total = self.match - self.gram
        edges = [total * i // PARTS for i in range(PARTS)] + [total + 1]
        return [(a, b - 1) for a, b in zip(edges, edges[1:]) if a < b]

    def _least_at(self, least: np.ndarray, found: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether some window that begins in ``lo`` to ``hi`` has its least hash at the trigger."""
        width = int((hi - lo).max()) + 1 if len(at) else 1
        starts = np.minimum(lo[:, None] + np.arange(width), hi[:, None])
        return (least[starts] == found[at][:, None]).any(1)

    def windows(self, data: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows of the groups (``at``, ``number``) whose least hash stands at the trigger,
        that hash, and the hash of their content."""
        out = []
        for part, low, begin, end in self.pieces(data):
            own = (at >= begin + low) & (at < end + low)
            if own.any():
                starts, *more = self._windows(part, at[own] - low, number[own])
                out.append((starts + low, *more))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _windows(self, data: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, least, sums = self.hashed(data)
        first, last = np.array(self.parts(), np.int64)[number].T
        width = int((last - first).max()) + 1 if len(at) else 1
        starts = (at - last)[:, None] + np.arange(width)
        inside = (starts >= 0) & (starts < len(least)) & (starts <= (at - first)[:, None])
        inside[inside] = least[starts[inside]] == np.broadcast_to(found[at][:, None], starts.shape)[inside]
        starts = np.unique(starts[inside])
        return starts, least[starts], self.hashes.of(sums, starts, starts + self.match)


def texts_of(df: DataFrame, doc: str, text: str, *more: Column) -> DataFrame:
    """Rows with ``doc`` (never NULL), ``row`` (the hash of the text) and ``text``."""
    return df.select(F.coalesce(quoted(doc).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), row_id(text).alias("row"),
                     quoted(text).cast("string").alias("text"), *more)


def _places(doc: int, row: int, at: np.ndarray, number: np.ndarray | int = 0) -> tuple[np.ndarray, ...]:
    """``doc``, ``place`` and ``row`` of places in one text."""
    return np.full(len(at), doc, np.int64), at.astype(np.int64) << PART_BITS | np.asarray(number, np.int64), np.full(len(at), row, np.int64)


def parse(texts: DataFrame, match: int, gram: int) -> DataFrame:
    """A row for each phrase of each text."""

    def make():
        parser = Parser(match, gram)

        def work(docs, rows, texts):
            parts = []
            for doc, row, text in zip(docs.to_pylist(), rows.to_pylist(), texts, strict=True):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) >= match:
                    at, trigger, phrase = parser.phrases(data)
                    parts.append((trigger.view(np.int64), phrase.view(np.int64), *_places(doc, row, at)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], PLACES.names)
        return work

    return expand_texts(texts, "text", ["doc", "row"], PLACES, make)


def _sorted_pass(batches):
    """``FOUND`` rows of a partition of places in order; see the kinds."""
    before, first_key, head_key, head, waiting = None, None, None, None, None

    def made(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, np.int32)), *rows.columns], FOUND.names)

    def taken(batch: pa.RecordBatch, chosen: np.ndarray) -> pa.RecordBatch:
        return batch.take(pa.array(np.flatnonzero(chosen)))

    for batch in batches:
        # a place that is there twice (a repeated row of the input) is there once
        columns = [c.to_numpy() for c in batch.columns]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        if batch.num_rows and before is not None:
            new[0] = any(c[0] != x for c, x in zip(columns, before, strict=True))
        if not new.any():
            continue
        batch = taken(batch, new)
        key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same_key = np.r_[before is not None and key[0] == before[0], key[1:] == key[:-1]]
        same = same_key & np.r_[before is not None and part[0] == before[1], part[1:] == part[:-1]]
        if before is None:
            first_key = key[0]
            yield made(EDGE, batch.slice(0, 1))
        if same.any():
            yield made(REPEAT, taken(batch, same))
        heads = np.flatnonzero(~same)
        if len(heads):
            of = key[heads]
            again = of[1:] == of[:-1]
            # several parts of a key, or maybe another one in the partition before
            several = np.r_[of[0] == head_key if head_key is not None else False, again] | np.r_[again, False] | (of == first_key)
            if waiting is not None and of[0] == head_key:
                yield made(HEAD, waiting)
            chosen = several.copy()
            chosen[0] &= before is not None  # the edge is no head yet
            if chosen.any():
                yield made(HEAD, batch.take(pa.array(heads[chosen])))
            head_key, head = of[-1], batch.slice(int(heads[-1]), 1)
            waiting = None if several[-1] else head
        before = [c.to_numpy()[-1] for c in batch.columns]
    if waiting is not None:
        yield made(HEAD, waiting)  # another part may follow in the next partition
    if head is not None:
        yield made(MARK, head)


def sorted_pass(places: DataFrame, name: str) -> tuple[DataFrame, DataFrame, str]:
    """The repeats, and the heads of keys with several parts (or that might have several), as rows of
    ``PLACES``, and the path of the table they are read from."""
    order = PLACES.names
    ordered = places.repartitionByRange(*order).sortWithinPartitions(*order)
    found, path = table(places.sparkSession, ordered.mapInArrow(_sorted_pass, FOUND), name)
    release(places.sparkSession)
    # at most two rows a partition
    edges = found.where(F.col("kind").isin(EDGE, MARK))
    first = edges.groupBy("key", "part").agg(F.min(F.struct("doc", "place", "row")).alias("first"))
    edges = edges.where(F.col("kind") == EDGE).join(F.broadcast(first), ["key", "part"])
    is_first = F.struct("doc", "place", "row") == F.col("first")
    repeats = found.where(F.col("kind") == REPEAT).select(*order).unionByName(edges.where(~is_first).select(*order))
    heads = found.where(F.col("kind") == HEAD).select(*order).unionByName(edges.where(is_first).select(*order))
    return repeats, heads, path


def compared(texts: DataFrame, heads: DataFrame, match: int, gram: int, windows: bool) -> DataFrame:
    """Places of the groups of windows, or of single windows, at the places of ``heads``."""
    number, at = _fields()
    wanted = heads.select("doc", "row", F.struct(at.cast("int").alias("at"), number.cast("int").alias("number")).alias("p")).groupBy("doc", "row").agg(F.collect_list("p").alias("wanted"))

    def make():
        parser = Parser(match, gram)

        def work(docs, rows, wanted, texts):
            parts, lists = [], numbers_of(wanted)
            for doc, row, (at, number), text in zip(docs.to_pylist(), rows.to_pylist(), lists, texts, strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                at, number = np.divmod(np.unique(at << PART_BITS | number), 1 << PART_BITS)
                if windows:
                    begins, key, part = parser.windows(data, at, number)
                    places = _places(doc, row, begins)
                else:
                    begins, numbers, key, part = parser.groups(data, at)
                    places = _places(doc, row, begins, numbers)
                parts.append((key.view(np.int64), part.view(np.int64), *places))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], PLACES.names)
        return work

    return expand_texts(texts.join(wanted, ["doc", "row"]), "text", ["doc", "row", "wanted"], PLACES, make)


def numbers_of(lists: pa.ListArray) -> list[tuple[np.ndarray, ...]]:
    """The fields of the structs in each list as arrays; empty ones for NULL."""
    flat = lists.flatten()
    fields = [flat.field(i).to_numpy().astype(np.int64) for i in range(flat.type.num_fields)]
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    ends = np.cumsum(sizes)
    return [tuple(f[a:b] for f in fields) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _fields() -> tuple[Column, Column]:
    """Part and offset of a place."""
    return F.col("place").bitwiseAND((1 << PART_BITS) - 1).alias("number"), F.shiftright("place", PART_BITS)


def repeated_spans(df: DataFrame, doc: str = "doc_id", text: str = "text", match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """``doc``, ``row`` and an array ``spans`` of (begin, end) bytes that stand in repeated windows, but those
    that ``periodic`` tells; spans may overlap, and reach over a text's ends. A row for each text that has any. Writes to the shared folder."""
    spark, texts, (number, at) = df.sparkSession, texts_of(df, doc, text), _fields()

    def spans(rows: DataFrame, begin: Column, end: Column) -> DataFrame:
        return rows.select("doc", "row", F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")).alias("span"))

    repeats, heads, _ = sorted_pass(parse(texts, match, gram), "repeat-phrases")
    whole = spans(repeats, at - (match - gram), at + match)

    groups, path = table(spark, compared(texts, heads, match, gram, windows=False), "repeat-groups")
    release(spark)
    repeats, heads, _ = sorted_pass(groups, "repeat-parts")
    discard(spark, path)
    bounds = Parser(match, gram).parts()
    bound = lambda i: F.element_at(F.array(*[F.lit(b[i]) for b in bounds]), (number + 1).cast("int"))
    partly = spans(repeats, at - bound(1), at - bound(0) + match)

    windows, path = table(spark, compared(texts, heads, match, gram, windows=True), "repeat-windows")
    release(spark)
    repeats, _, _ = sorted_pass(windows, "repeat-contents")
    discard(spark, path)
    single = spans(repeats, at, at + match)
    return whole.unionByName(partly).unionByName(single).groupBy("doc", "row").agg(F.collect_list("span").alias("spans"))


def united(begins: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of maximal runs of bytes covered by spans in a text of ``n`` bytes."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, reached = np.maximum(begins[order], 0), np.maximum.accumulate(np.minimum(ends[order], n))
    new = np.r_[True, begins[1:] > reached[:-1]]
    return begins[new], reached[np.r_[new[1:], True]]


def remove_repeats(df: DataFrame, keep: list[str] | None = None, doc: str = "doc_id", text: str = "text", match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """Columns ``keep`` of every row with ``n_bytes``, the removed ``runs`` (begin, end) and ``kept``, the
    remaining bytes (a run may cut through a letter, so these need not be UTF-8). Names that ``keep`` has get
    underscores behind them."""
    keep = df.columns if keep is None else keep
    n_bytes, runs, kept = fresh(keep, "n_bytes", "runs", "kept")
    passed = [quoted(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    joined = texts_of(df, doc, text, *passed).join(repeated_spans(df, doc, text, match, gram), ["doc", "row"], "left")
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(n_bytes, T.LongType()), T.StructField(runs, T.ArrayType(T.StructType([
        T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField(kept, T.BinaryType())])

    def make():
        def work(*columns):
            sizes, firsts, lasts, kept = [], [], [], []
            for (begins, ends), text in zip(numbers_of(columns[-2]), columns[-1], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                inside = np.array(periodic(np.frombuffer(data, np.uint8), match), np.int64).reshape(-1, 2)
                begins, ends = united(np.r_[begins, inside[:, 0]], np.r_[ends, inside[:, 1] + match - 1], len(data))
                sizes.append(len(data))
                firsts.append(begins)
                lasts.append(ends)
                kept.append(b"".join([data[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True)]))
            offsets = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (firsts, lasts)], ["begin", "end"])
            runs = pa.ListArray.from_arrays(pa.array(offsets), structs)
            yield pa.RecordBatch.from_arrays([*columns[:-2], pa.array(sizes, pa.int64()), runs, pa.array(kept, pa.binary())], schema.names)
        return work

    return expand_texts(joined, "text", [*[f"keep_{i}" for i in range(len(keep))], "spans"], schema, make)
