"""Language network: gradients, accuracy on held-out documents, odd texts."""

import numpy as np
from pyspark.sql import functions as F

from souklens.llm import language
from souklens.llm.queries import QUERIES

QUICK = language.Sample(documents=200, steps=60, batch=128)


def trained(spark):
    rows = [(i, lang, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(40))) for i in range(60) for lang, words in
            (("aa", ["bako", "toma", "kalo", "moba"]), ("ee", ["sen", "reß", "eint", "zer"]))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    return language.train(df, sample=QUICK)


def test_gradients():
    network = language.Network(["a", "b", "c"], 5, 3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    random = np.random.default_rng(2)
    data, target = random.integers(97, 103, (7, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, gradients = network.gradients(data, target)
    for name, g in gradients.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, sides = network.p[name][at], []
        for step in (1e-4, -1e-4):
            network.p[name][at] = kept + step
            sides.append(network.gradients(data, target)[0])
        network.p[name][at] = kept
        assert abs((sides[0] - sides[1]) / 2e-4 - g[at]) < 1e-3 * max(abs(g[at]), 1e-3) + 1e-6, name


def test_odd_texts(spark):
    network = trained(spark)
    text = "toma bako kalo"
    df = spark.createDataFrame([(1, text, 5.0), (1, text, 5.0), (2, None, 0.0), (3, "", 0.0), (4, "12 ½ !?", 0.0), (None, "zer sen reß", 0.0), (5, text * 20_000, 0.0)], "doc_id long, text string, score double")
    rows = language.predict(df, network, keep=["doc_id"]).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in rows] == [(1, "aa"), (1, "aa"), (2, "und"), (3, "und"), (4, "und"), (None, "ee"), (5, "aa")]
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0.5) == (r["lang_pred"] != "und") for r in rows) and rows[0] == rows[1]
    assert language.predict(df.limit(0), network, keep=["doc_id"]).collect() == []
    labels = network.label(text)
    assert len(labels) == len(text.encode()) and labels.count("aa") > len(labels) / 2


def test_whole_texts_count(spark):
    network = trained(spark)
    text = "toma bako " * 60 + "zer sen reß eint " * 400
    assert language.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), network).first()["lang_pred"] == "ee"


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.train(df) is None
    assert language.predict(df, None).first()["lang_pred"] == "und"


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    found = QUERIES["op3_language_network"](spark, path)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.95


def test_sample_of_usable_rows(spark):
    """Few labelled rows with text among very many, a rare language, and letters that only the end of a text has."""
    few = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("aa").alias("lang"), F.when(F.col("id") % 20_000 == 7, "toma bako kalo").alias("text"))
    assert language.train(few, pick=F.xxhash64("doc_id"), sample=QUICK).languages == ["aa"]
    rare = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5_000 == 3, "ee").otherwise("aa").alias("lang"),
                                      F.when(F.col("id") % 5_000 == 3, "zer sen reß eint " * 9).otherwise("toma bako kalo moba " * 9).alias("text"))
    network = language.train(rare, pick=F.xxhash64("doc_id"), sample=QUICK)
    assert network.languages == ["aa", "ee"] and network.label("sen reß zer eint sen").count("ee") > 10
    late = spark.createDataFrame([(i, "aa", "1 " * 9_000 + "toma bako kalo " * 900) for i in range(9)] + [(i, "ee", "sen reß zer ") for i in range(9)], "doc_id long, lang string, text string")
    assert language.predict(late.limit(1), language.train(late, sample=QUICK)).columns == ["doc_id", "lang", "text", "lang_pred", "score"]
    assert language.train(spark.createDataFrame([(1, "aa", "12 !")], "doc_id long, lang string, text string")) is None


def test_pooled_equals_a_plain_pass(spark):
    """Probabilities of a text from the cell's equations, a byte and a window at a time."""
    network = trained(spark)
    text = ("toma bako kalo zer " * 30).encode()
    pieces = [text[i:i + language.WINDOW] for i in range(0, len(text), language.WINDOW)]
    plain = sum(network.probabilities(np.frombuffer(piece.ljust(language.WINDOW, b"\0"), np.uint8).reshape(-1, 1))[:len(piece), 0].sum(0) for piece in pieces) / len(text)
    assert np.allclose(language.pooled(network, [text.decode(), "", None])[0], plain, atol=1e-5)
