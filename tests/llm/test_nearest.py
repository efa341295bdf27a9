"""Nearest neighbours against brute force."""

import math
import random

import numpy as np

from souklens.llm import nearest
from souklens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    """query -> [(id, score)] over different (id, vector) rows."""
    valid = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dims = max((len(v) for _, v in valid), default=0)
    valid = [(i, np.array([*v, *[0.0] * (dims - len(v))], np.float64)) for i, v in valid]
    out = {}
    for q, x in valid:
        if q % every == 0:
            scores = sorted((-round(float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)), 9), i) for i, y in valid if i != q)
            out.setdefault(q, []).append([(i, -s) for s, i in scores[:k]])
    return out


def found(df, **options):
    out = {}
    for r in sorted(nearest.nearest(df, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    return out


def test_whole_recall_equals_brute_force(spark):
    """Copies, a vector of a third of the rows, opposite and unusable vectors, short ones, repeated rows."""
    random_ = random.Random(3)
    vector = lambda: [round(random_.gauss(0, 1), 3) for _ in range(7)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector()) for i in range(900)]
    rows += [(i + 1_000, rows[i][1]) for i in range(0, 900, 10)] + rows[::11]
    rows += [(2_000, None), (2_050, [0.0] * 7), (2_100, [float("nan")] + hot[1:]), (2_150, [float("inf")] + hot[1:]), (2_200, [None] + hot[1:]), (None, hot), (2_250, []),
             (2_300, [-x for x in hot]), (2_350, [1.0, 2.0]), (2_400, [1e-30] * 7), (2_450, [1e30] * 7)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", nearest.F.lit("x")).repartition(6)
    want = {q: lists[0] for q, lists in brute(rows, 50, 5).items()}
    assert found(df, recall=1.0) == want


def test_blocks_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ENTRY_BLOCK", 16)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 8)
    random_ = random.Random(4)
    rows = [(i, [random_.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, every=10, k=3, recall=1.0) == {q: lists[0] for q, lists in brute(rows, 10, 3).items()}
    for few in ([], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (50, [1.0, 0.0])], [(1, [1.0])]):
        assert found(spark.createDataFrame(few, SCHEMA)) == {q: lists[0] for q, lists in brute(few, 50, 5).items() if lists[0]}


def test_walk_goes_by_rising_sums():
    random_ = np.random.default_rng(1)
    one, two, counts = random_.random(9), random_.random(7), random_.integers(0, 3, (9, 7))
    cells = nearest.walk(one, two, counts, 10**9)
    sums = [one[i] + two[j] for i, j in cells]
    assert sums == sorted(sums) and sorted(cells) == sorted(zip(*np.nonzero(counts), strict=True))
    assert sum(counts[c] for c in nearest.walk(one, two, counts, 12)[:-1]) < 12 <= sum(counts[c] for c in nearest.walk(one, two, counts, 12))


def test_recall_of_the_query(spark):
    """At least 0.9 of the true neighbours, measured on given data with the query's parameters."""
    path = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), nearest.unit(np.array([v for _, v in rows], np.float64))
    got = {}
    for r in QUERIES["op13_multi_index"](spark, path).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[q]
        true = [j for j in np.lexsort((ids, -scores)) if j != q][:5]
        hits += sum(int(ids[j]) in got[int(ids[q])] for j in true)
        total += 5
        assert all(abs(scores[np.flatnonzero(ids == i)[0]] - s) < 1e-12 for i, s in got[int(ids[q])].items())
    assert hits / total >= 0.9
