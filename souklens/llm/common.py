"""Helpers that the operators share: texts in bounded slices, substring hashes, row identity, files."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from souklens.session import delete, free_with_scope, new_path

#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, lengthened where a column of ``taken`` has the name (letter case aside)."""
    used, out = {n.lower() for n in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``most`` bytes of text, or a single row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def map_texts(
    df: DataFrame, text: str, keep: list[str], fields: list[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[[list[str | None]], list[list]]],
) -> DataFrame:
    """Columns ``keep`` and new ``fields`` computed from whole texts, a bounded slice of rows at a time.

    ``make`` runs once in each task and returns the function from the texts of a slice to the lists
    of its fields. A field whose name a kept column has, letter case aside, gets underscores behind it. No shuffle; a lost
    task is simply run again.
    """
    fields = [(name, *kinds) for name, (_, *kinds) in zip(fresh(keep, *[f[0] for f in fields]), fields, strict=True)]
    chosen = df.select(*[quoted(c) for c in keep], quoted(text).cast("string").alias("_text"))
    schema = T.StructType([*chosen.schema.fields[:-1], *[T.StructField(n, t) for n, t, _ in fields]])
    kinds, names = [k for *_, k in fields], [*keep, *[f[0] for f in fields]]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, len(keep)):
                made = work(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names)

    return chosen.mapInArrow(run, schema)


def expand_texts(
    df: DataFrame, text: str, keep: list[str], schema: T.StructType, make: Callable[[], Callable[..., Iterator[pa.RecordBatch]]],
) -> DataFrame:
    """Rows of ``schema`` that ``make()`` yields for slices of the columns ``keep`` and the text."""
    chosen = df.select(*[quoted(c) for c in keep], quoted(text).cast("string").alias("_text"))

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, len(keep)):
                yield from work(*[part.column(i) for i in range(len(keep))], part.column(len(keep)).to_pylist())

    return chosen.mapInArrow(run, schema)


def row_id(text: str) -> Column:
    """Tells rows that share a document id apart by their text; equal rows stay equal."""
    return F.xxhash64(F.coalesce(quoted(text).cast("string"), F.lit("")))


def table(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path, for ``discard``; it goes with the open scope."""
    path = new_path(spark, name)
    free_with_scope(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage."""
    return table(df.sparkSession, df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no frame in use reads any more."""
    delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that are gone; it learns of them only when
    the driver collects its garbage, which a driver with little to do seldom does by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_name(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}"


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Substrings:
    """64-bit hashes of any substrings of a byte string, each in constant time.

    Bytes are first replaced by random values of 64 bits; the polynomial over them is taken modulo
    2^64 with an odd base, whose inverse makes the hash independent of the place.
    """

    def __init__(self, seed: int = 1):
        random = np.random.default_rng(seed)
        self.values = random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(random.integers(1 << 40, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << max(16, (n - 1).bit_length())
            grown = []
            for base in (self.base, self.inverse):
                steps = np.full(size, base % (1 << 64), np.uint64)
                steps[0] = 1
                grown.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = grown

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums of ``data`` (uint8), from which ``of`` takes the hashes."""
        n = len(data)
        self._powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.down[:n], out=out[1:])
        return out

    def of(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((sums[hi] - sums[lo]) * self.up[lo] + (hi - lo).astype(np.uint64))


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte string whose words stand between single spaces."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = np.flatnonzero(data == 32)
    return np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
