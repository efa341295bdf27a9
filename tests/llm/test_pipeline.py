"""Every stage of the pipeline against a plain version, each on what the stage before it kept."""

import hashlib
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from souklens.llm import contamination, language
from souklens.llm.queries import WORD_BPE
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_neardup import brute

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, score int, `Row_Key` int"


def rows_of():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM read_parquet('{SMALL}/documents.parquet') ORDER BY doc_id").fetchall()
    item = duckdb.sql(f"SELECT text FROM read_parquet('{SMALL}/benchmark.parquet') ORDER BY item_id LIMIT 1").fetchall()[0][0]
    text = rows[3][1]
    shared = "This sentence stands in many of the documents, word for word."
    more = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34", None), (1003, text, "en"), (1003, text, "en"), (None, text, "en"), (1004, text + " end", "fr"),
            (1005, "the " + text + "\n" + item, None), *[(1010 + i, rows[i][1] + "\n" + shared, "en") for i in range(8)], (1030, "of the and " * 40_000, "en")]
    return [(*r, "x", 1, 2) for r in rows] + [(d, t, lang, "s", None if t is None else len(t), None, None, None) for d, t, lang in more], item


@pytest.fixture(scope="module")
def steps(spark):
    rows, item = rows_of()
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(4)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(corpus_pipeline.store(stage(spark, frames[-1], SMALL), "test-stage"))
    return frames, item


def texts(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)


def test_names_and_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(f.columns == steps[0][0].columns for f in steps[0])


def test_language(steps):
    before, after = texts(steps[0][0]), texts(steps[0][1])
    network = language.train(steps[0][0], pick=F.xxhash64("doc_id"))
    shares = language.pooled(network, [t for _, t in before])
    want = [r for r, s in zip(before, shares.max(1), strict=True) if r[1] and language.has_letter(r[1]) and s >= corpus_pipeline.LEAST_SCORE]
    assert after == want and {1000, 1001, 1002}.isdisjoint(d for d, _ in after)
    assert len(after) >= len(before) - 5


def test_lines(steps):
    before, after = texts(steps[0][1]), steps[0][2]
    want = sorted([(d if d != -1 else None, kept) for d, _, _, kept in plain_lines(before, 40, 5)], key=str)
    assert texts(after) == want
    assert after.where("n_chars <> length(text)").count() == 0


def test_near_duplicates(steps):
    before, after = texts(steps[0][2]), texts(steps[0][3])
    found = brute([r for r in dict.fromkeys(before) if r[0] is not None])
    assert after == sorted([r for r in dict.fromkeys(before) if r[0] is None or found[r[0]][1] == r[0]], key=str)
    assert len(after) < len(before)


def test_decontamination(steps):
    frames, item = steps
    before, after = texts(frames[3]), texts(frames[4])
    items = [contamination.normalized(t) for t, in duckdb.sql(f"SELECT text FROM read_parquet('{SMALL}/benchmark.parquet')").fetchall()]
    assert after == [r for r in before if not any(i in contamination.normalized(r[1]) for i in items)]
    assert 1005 not in {d for d, _ in after}


def test_codes(spark, steps):
    library = Tokenizer.from_file(WORD_BPE)
    got = sorted([(r["doc_id"], r["lang"], bytes(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.coded(spark, steps[0][4], SMALL).collect()], key=str)
    want = []
    for r in steps[0][4].collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], r["lang"], np.array(ids, "<u4").tobytes(), len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).collect() == []
    one = spark.createDataFrame([(1, "some text", None, None, None, None, None, None)], SCHEMA)
    assert corpus_pipeline.known_language(spark, one, SMALL).count() == 1


def test_run_is_registered():
    entry = sys.modules.get("__spark_entry__") or __import__("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in entry.queries()}
