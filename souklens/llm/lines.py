"""Line dedup: long lines held by many documents stay in the document with the largest id only.

Line keys are hashed (128 bits) and range-partitioned by hash and document, each partition sorted by
hash, document (largest first) and position. A stream over a partition counts documents and finds the
first occurrence of every hash with a bounded buffer. A hash that a third of all rows share spreads over
many partitions; only the first and last hash of a partition can reach over its ends, so their counts
are summed in a table of at most two rows a partition. The result is a compressed bitmap of kept lines
for each document that loses lines; texts meet their bitmaps in one join.

NULL or empty text is one empty line. A row without id neither counts nor loses lines. Rows that share
an id count as one document; each has its own bitmap. Repeated rows are all cut alike.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from souklens.llm.common import expand_texts, fresh, quoted, row_id, store

LEAST_CHARS = 40
LEAST_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"

KEYS = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()),
    T.StructField("n_lines", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
#: ``kind``: a row to drop, a row whose hash may go on in another partition, or the count of such a hash.
DROP, OPEN, COUNT = 0, 1, 2
FOUND = T.StructType([T.StructField("kind", T.IntegerType()), *KEYS.fields, T.StructField("docs", T.LongType())])
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc", pa.int64()), ("row", pa.int64()), ("n_lines", pa.int32()),
                         ("places", pa.list_(pa.int32())), ("docs", pa.int64())])


def line_keys(df: DataFrame, doc: str, text: str, least_chars: int) -> DataFrame:
    """A row for each document and distinct long line key, with the places of its lines."""
    rows = df.where(quoted(doc).isNotNull()).select(quoted(doc).cast("long").alias("doc"), row_id(text).alias("row"), quoted(text).alias("text"))

    def make():
        def work(docs, row_ids, texts):
            out: list[tuple] = []
            for d, r, text in zip(docs.to_pylist(), row_ids.to_pylist(), texts, strict=True):
                lines = (text or "").split("\n")
                places: dict[str, list[int]] = {}
                for i, line in enumerate(lines):
                    if len(line) >= least_chars and len(line := line.strip(BLANKS)) >= least_chars:
                        places.setdefault(line, []).append(i)
                keys: dict[bytes, list[int]] = {}
                for line, at in places.items():
                    keys.setdefault(hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest(), []).extend(at)
                out.extend((k, d, r, len(lines), at) for k, at in keys.items())
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, FOUND_ARROW.field(n).type) for c, n in zip(cols, KEYS.names, strict=True)], KEYS.names)
        return work

    return expand_texts(rows, "text", ["doc", "row"], KEYS, make)


def _stream(least_docs: int):
    """Function over the batches of one sorted partition; see the module's description."""

    def run(batches):
        out: list[tuple] = []
        key, first, last, docs, edge, held = None, None, None, 0, True, []

        def close(at_end: bool) -> None:
            # rows still held belong to a hash with too few documents here
            if key is not None and (edge or at_end):
                out.extend((OPEN, *r, None) for r in held)
                out.append((COUNT, key, first, None, None, None, docs))

        def flush():
            cols = list(zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, FOUND_ARROW, strict=True)], schema=FOUND_ARROW)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != key:
                    close(False)
                    edge, key, first, last, docs, held = key is None, row[0], row[1], row[1], 1, []
                elif row[1] != last:
                    last, docs = row[1], docs + 1
                if edge:
                    out.append((OPEN, *row, None))
                elif docs < least_docs:
                    held.append(row)
                else:
                    out.extend((DROP, *r, None) for r in [*held, row] if r[1] != first)
                    held = []
                if len(out) >= 20_000:
                    yield flush()
        close(True)
        if out:
            yield flush()

    return run


def keep_bitmaps(
    df: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """``doc``, ``row`` (see ``row_id``), ``n_lines``, ``n_dropped`` and the compressed ``bitmap`` of
    kept lines, for each document that loses lines. Writes its keys and findings to the shared folder."""
    keys = store(line_keys(df, doc, text, least_chars), "line-keys")
    ordered = keys.repartitionByRange("key", F.desc("doc")).sortWithinPartitions("key", F.desc("doc"), "row")
    found = store(ordered.mapInArrow(_stream(least_docs), FOUND), "line-drops")
    edges = (found.where(F.col("kind") == COUNT).groupBy("key").agg(F.sum("docs").alias("docs"), F.max("doc").alias("largest"))
             .where(F.col("docs") >= least_docs).select("key", "largest"))
    opened = (found.where(F.col("kind") == OPEN).join(F.broadcast(edges), "key")  # at most two rows a partition
              .where(F.col("doc") < F.col("largest")))
    dropped = found.where(F.col("kind") == DROP).select("doc", "row", "n_lines", "places").unionByName(opened.select("doc", "row", "n_lines", "places"))
    of_doc = dropped.groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("places")).alias("places"))
    schema = T.StructType([*KEYS.fields[1:4], T.StructField("n_dropped", T.IntegerType()), T.StructField("bitmap", T.BinaryType())])

    def pack(batches):
        for batch in batches:
            maps, lost = [], []
            for n, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept = np.ones(n, bool)
                kept[places] = False
                maps.append(zlib.compress(np.packbits(kept).tobytes()))
                lost.append(int(n - kept.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lost, pa.int32()), pa.array(maps, pa.binary())], schema.names)

    return of_doc.select("doc", "row", "n_lines", "places").mapInArrow(pack, schema)


def kept_lines(bitmap: bytes, n: int) -> np.ndarray:
    """Numbers of the kept lines of a text of ``n`` lines."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n))


def apply_bitmaps(
    df: DataFrame, bitmaps: DataFrame, keep: list[str] | None = None, doc: str = "doc_id", text: str = "text",
    n_lines: str = "n_lines", n_dropped: str = "n_dropped", kept: str = "kept_text",
) -> DataFrame:
    """Columns ``keep`` of every row with its number of lines, of dropped lines, and the kept text."""
    keep = df.columns if keep is None else keep
    d, r, b, t, n_lines, n_dropped, kept = fresh(keep, "of_doc", "of_row", "bitmap", "text_in", n_lines, n_dropped, kept)
    left = df.select(*[quoted(c) for c in keep], quoted(text).alias(t), quoted(doc).cast("long").alias(d), row_id(text).alias(r))
    right = bitmaps.select(F.col("doc").alias(d), F.col("row").alias(r), F.col("bitmap").alias(b))
    joined = left.join(right.hint("merge"), [d, r], "left")  # one plan at every size: bitmaps grow with the documents

    def cut(pairs: list[str | None], maps: list[bytes | None]) -> list[list]:
        out = []
        for text, bitmap in zip(pairs, maps, strict=True):
            lines = (text or "").split("\n")
            stays = lines if bitmap is None else [lines[i] for i in kept_lines(bitmap, len(lines))]
            out.append((len(lines), len(lines) - len(stays), "\n".join(stays)))
        return list(zip(*out, strict=True)) if out else [[], [], []]

    types = [pa.int64(), pa.int64(), pa.string()]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType()), T.StructField(kept, T.StringType())])

    def make():
        def work(*columns):
            made = cut(columns[-1], columns[len(keep)].to_pylist())
            yield pa.RecordBatch.from_arrays([*columns[:len(keep)], *[pa.array(m, k) for m, k in zip(made, types, strict=True)]], schema.names)
        return work

    return expand_texts(joined, t, [*keep, b], schema, make)


def dedupe(df: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows of ``df`` with the text cut to the kept lines."""
    n, d, kept = fresh(df.columns, "n_lines", "n_dropped", "kept_text")
    cut = apply_bitmaps(df, keep_bitmaps(df, doc, text, least_chars, least_docs), None, doc, text, n, d, kept)
    return cut.select(*[F.when(quoted(c).isNotNull(), F.col(kept)).alias(c) if c == text else quoted(c) for c in df.columns])
