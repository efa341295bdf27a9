"""Approximate nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves. Each half has its own centres, fitted on a bounded
sample (``SAMPLE`` vectors with the least hashes); every vector is filed in the cell (i, j) of its nearest
centres. A query walks the cells by the sum of its distances to both centres, from a heap, until the cells
walked hold a given number of entries; these entries are compared exactly, in double precision.

That number is not a constant: the neighbours of a bounded number of queries (``PROBES``) are found by brute
force over all entries, and the number is the least with which the walk reaches the share ``recall`` of them.
So the recall holds at every size; where vectors have no structure, the walk becomes long.

The index holds every row: equal vectors are one entry with its ``k + 1`` smallest ids, which is exact, since
ties go to smaller ids and a query leaves out at most its own. Entries are compared in units of a first centre,
a block of its entries and a block of queries, all of bounded size, so neither a full cell nor a vector that
very many rows share meets one task.

Vectors that are NULL, all zero, or hold NULL, NaN or infinite components take no part, nor do rows without id.
Shorter vectors count as filled up with zeros. A repeated row (same id, same vector) counts once; a query's own
id is never its neighbour. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from souklens.llm.common import discard, mixed, quoted, table

#: Vectors that centres are fitted on, and queries that the length of the walk is fitted on.
SAMPLE = 16_384
PROBES = 256
#: Mean entries of a cell, and the most centres of a half.
CELL = 64
CENTRES = 512
#: Entries and queries of a unit, and queries compared at once.
ENTRY_BLOCK = 16_384
QUERY_BLOCK = 4_096
AT_ONCE = 256

FOUND = T.StructType([T.StructField("key", T.LongType()), T.StructField("sign", T.LongType()),
                      T.StructField("score", T.DoubleType()), T.StructField("id", T.LongType())])


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, initial=1e-300, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def fit(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres by Lloyd's rounds, begun from evenly spread rows of a sample that is ordered by hash."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = distances(x, centres).argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.add.reduceat(np.vstack([x[order], np.zeros(x.shape[1])]), np.minimum(np.cumsum(n) - n, len(x)), axis=0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Centres:
    """Centres of both halves; ``dims`` is the length of whole vectors."""

    first: np.ndarray
    second: np.ndarray
    dims: int

    @classmethod
    def of(cls, sample: np.ndarray, k: int) -> Centres:
        half = sample.shape[1] // 2
        return cls(fit(sample[:, :half], k), fit(sample[:, half:], k), sample.shape[1])

    def away(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of each row's halves to all centres."""
        half = self.dims // 2
        return distances(x[:, :half], self.first), distances(x[:, half:], self.second)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Cells with entries by rising sum of the distances ``first[i] + second[j]``, until they hold ``budget``.

    Both halves are sorted; the heap holds the border of the pairs taken so far: pair (r, s) enters when
    (r - 1, s) has been taken (for s = 0) or (r, s - 1) has.
    """
    rows, cols = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b, held = first[rows].tolist(), second[cols].tolist(), counts[np.ix_(rows, cols)].tolist()
    rows, cols = rows.tolist(), cols.tolist()
    heap, out, seen = [(a[0] + b[0], 0, 0)], [], 0
    while heap and seen < budget:
        _, r, s = heapq.heappop(heap)
        if held[r][s]:
            out.append((rows[r], cols[s]))
            seen += held[r][s]
        if s + 1 < len(b):
            heapq.heappush(heap, (a[r] + b[s + 1], r, s + 1))
        if s == 0 and r + 1 < len(a):
            heapq.heappush(heap, (a[r + 1] + b[0], r + 1, 0))
    return out


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(quoted(key).cast("long").alias("id"), quoted(vector).alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False))).dropDuplicates(["id", "vec"])


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """A row for each different vector with its ``k + 1`` smallest ids. The limit by rank is applied in each
    task before the shuffle as well, so a vector of very many rows costs a few rows per task."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _filed(entries: DataFrame, centres) -> DataFrame:
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), *entries.schema.fields])

    def run(batches):
        c = centres.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                one, two = c.away(unit(matrix(part.column(0), c.dims)))
                yield pa.RecordBatch.from_arrays([pa.array(one.argmin(axis=1), pa.int32()), pa.array(two.argmin(axis=1), pa.int32()), *part.columns], schema.names)

    return entries.mapInArrow(run, schema)


def _top(scores: np.ndarray, most: int) -> np.ndarray:
    """Columns of the ``most`` largest of each row, in no order."""
    return np.argpartition(-scores, most - 1, axis=1)[:, :most] if most < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices of unit rows, always summed in the same order."""
    return np.clip((a * b).sum(axis=1), -1.0, 1.0)


def _needed(index: DataFrame, probes: np.ndarray, centres: Centres, counts: np.ndarray, k: int, recall: float) -> int:
    """Entries to walk until the share ``recall`` of the nearest ``k`` entries of ``probes`` has been seen.

    Each task sends the ``k + 1`` best of its entries for each probe (the best is the probe itself)."""
    shared = index.sparkSession.sparkContext.broadcast(probes)

    def run(batches):
        best = np.full((len(shared.value), 0), 0.0), np.zeros((len(shared.value), 0), np.int64)
        for batch in batches:
            cells = batch.column(0).to_numpy().astype(np.int64) * CENTRES + batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, ENTRY_BLOCK):
                scores = shared.value @ unit(matrix(batch.column(2).slice(at, ENTRY_BLOCK), shared.value.shape[1])).T
                scores = np.hstack([best[0], scores])
                where = np.hstack([best[1], np.broadcast_to(cells[at:at + ENTRY_BLOCK], (len(scores), scores.shape[1] - best[0].shape[1]))])
                top = _top(scores, k + 1)
                best = np.take_along_axis(scores, top, 1), np.take_along_axis(where, top, 1)
        n, m = best[0].shape
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), m)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], ["probe", "score", "cell"])

    rows = index.select("i", "j", "vec").mapInArrow(run, "probe long, score double, cell long")
    nth = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "cell"))
    true = rows.withColumn("nth", nth).where(F.col("nth").between(2, k + 1)).select("probe", "cell").collect()  # k rows a probe, without itself
    one, two = centres.away(probes)
    needs = []
    by_probe: dict[int, list[int]] = {}
    for r in true:
        by_probe.setdefault(r["probe"], []).append(r["cell"])
    for p, cells in by_probe.items():
        order = np.argsort((one[p][:, None] + two[p]).ravel(), kind="stable")
        seen = np.empty(len(order), np.int64)
        seen[order] = np.cumsum(counts.ravel()[order])
        needs.extend(seen[c // CENTRES * counts.shape[1] + c % CENTRES] for c in cells)
    return int(np.quantile(needs, recall, method="higher")) if needs else 0


def _compare(dims: int, k: int):
    """Entries and queries of one unit to the ``k + 1`` best ids of each query, exactly."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "sign": [], "score": [], "id": []}
        if entries.num_rows and queries.num_rows:
            columns = entries["j"].to_numpy()
            ids = entries["ids"].combine_chunks()
            starts, every = ids.offsets.to_numpy(), ids.values.to_numpy()
            x = unit(matrix(entries["vec"].combine_chunks(), dims))
            for at in range(0, queries.num_rows, AT_ONCE):
                part = queries.slice(at, AT_ONCE).combine_chunks()
                y = unit(matrix(part["vec"].combine_chunks(), dims))
                taken = np.zeros((len(y), CENTRES), bool)
                for r, cells in enumerate(part["cells"].to_pylist()):
                    taken[r, cells] = True
                scores = np.where(taken[:, columns], y @ x.T, -np.inf)
                top = _top(scores, k + 3)  # a few more, as sums in another order differ in the last digits
                q, e = np.nonzero(np.take_along_axis(scores, top, 1) > -np.inf)
                e = top[q, e]
                exact = cosines(y[q], x[e])
                n = starts[e + 1] - starts[e]
                q, exact = np.repeat(q, n), np.repeat(exact, n)
                found = every[np.repeat(starts[e] - (np.cumsum(n) - n), n) + np.arange(len(q))]
                order = np.lexsort((found, -exact, q))
                q, exact, found = q[order], exact[order], found[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                best = nth <= k
                out["key"].append(part["key"].to_numpy()[q[best]])
                out["sign"].append(part["sign"].to_numpy()[q[best]])
                out["score"].append(exact[best])
                out["id"].append(found[best])
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    return run


def _best(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most)


def nearest(
    df: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = 0.97,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for each row whose id is
    divisible by ``every``. Writes its index to the shared folder and runs jobs when the frame is built."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, rows_at = table(spark, _vectors(df, key, vector), "vectors")
    entries, entries_at = table(spark, _entries(rows, k), "entries")
    n, dims = entries.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    dims += dims % 2
    sample = entries.orderBy(F.xxhash64("vec"), F.element_at("ids", 1)).limit(SAMPLE).select("vec").toArrow()
    centres = Centres.of(unit(matrix(sample["vec"].combine_chunks(), dims)), min(CENTRES, max(2, round((n / CELL) ** 0.5))))
    shared = spark.sparkContext.broadcast(centres)
    index, _ = table(spark, _filed(entries, shared), "multi-index")
    discard(spark, entries_at)
    counts = np.zeros((len(centres.first), len(centres.second)), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # at most CENTRES ** 2 rows
        counts[r["i"], r["j"]] = r["count"]

    asked = rows.where(F.col("id") % every == 0).withColumn("sign", F.xxhash64("vec"))
    queries = asked.groupBy("vec").agg(F.min("id").alias("key"), F.first("sign").alias("sign"))
    queries, _ = table(spark, queries, "queries")
    probes = queries.orderBy(F.xxhash64("sign"), "key").limit(PROBES).select("vec").toArrow()
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], schema)
    budget = max(k + 1, _needed(index, unit(matrix(probes["vec"].combine_chunks(), dims)), centres, counts, k, recall))
    held = spark.sparkContext.broadcast(counts)
    probing = T.StructType([*queries.schema.fields, T.StructField("i", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def walks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                one, two = shared.value.away(unit(matrix(part.column(0), dims)))
                of, first, cells = [], [], []
                for r in range(part.num_rows):
                    shelves: dict[int, list[int]] = {}
                    for i, j in walk(one[r], two[r], held.value, budget):
                        shelves.setdefault(i, []).append(j)
                    of.extend([r] * len(shelves))
                    first.extend(shelves)
                    cells.extend(shelves.values())
                yield pa.RecordBatch.from_arrays(
                    [*part.take(pa.array(of, pa.int64())).columns, pa.array(first, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], probing.names)

    # units: a first centre, a block of its entries, a block of queries
    blocks = F.array(*[F.lit(int(-(-c // ENTRY_BLOCK)) or 1) for c in counts.sum(axis=1)])
    n_blocks = F.element_at(blocks, F.col("i") + 1)
    query_blocks = -(-n_queries // QUERY_BLOCK)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (index.withColumn("block", F.pmod(F.xxhash64("vec"), n_blocks).cast("int"))
            .withColumn("part", numbers(F.lit(query_blocks))))
    right = (queries.mapInArrow(walks, probing).withColumn("part", F.pmod(F.xxhash64("sign", "key"), F.lit(query_blocks)).cast("int"))
             .withColumn("block", numbers(n_blocks)))
    by = ["i", "block", "part"]
    found = (left.select(*by, "j", "vec", "ids").groupBy(*by).cogroup(right.select(*by, "key", "sign", "cells", "vec").groupBy(*by))
             .applyInArrow(_compare(dims, k), FOUND))
    best = _best(found, ["key", "sign"], k + 1).select("key", "sign", "score", "id")
    best, _ = table(spark, best, "nearest")
    # every query row with the result of its vector: its own id goes
    keys = queries.select("vec", "key", "sign")
    mine = asked.select("id", "sign", "vec").join(keys, ["sign", "vec"]).select(F.col("id").alias("query_id"), "key", "sign")
    pairs = mine.join(best, ["key", "sign"]).where(F.col("id") != F.col("query_id"))
    ranked = _best(pairs, ["query_id", "key", "sign"], k)
    return ranked.select("query_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
