"""Inputs that have columns named like an operator's outputs keep them; the outputs get underscores."""

import pytest

from souklens import session
from souklens.llm import bpe, language, licences, lines, quality, repeats
from souklens.llm.queries import PIECE_BPE, WORD_BPE

OUTPUTS = {
    "language": (lambda df: language.predict(df, None), ["lang_pred", "score"]),
    "licences": (licences.scan, ["n_words", "places", "base_labels", "labels", "score", "unread"]),
    "bpe": (lambda df: bpe.round_trip(df, WORD_BPE), ["n_tokens", "ids", "decoded"]),
    "quality": (lambda df: quality.measure(df, PIECE_BPE), [f[0] for f in quality.FIELDS]),
    "repeats": (repeats.remove_repeats, ["n_bytes", "runs", "kept"]),
    "lines": (lambda df: lines.apply_bitmaps(df, lines.keep_bitmaps(df)), ["n_lines", "n_dropped", "kept_text"]),
}


@pytest.mark.parametrize("name", OUTPUTS)
def test_clashing_names(spark, name):
    build, outputs = OUTPUTS[name]
    plain = spark.createDataFrame([(1, "Some words of a text. MIT License"), (2, None), (2, "")], "doc_id long, text string")
    clash = plain.selectExpr("*", *[f"'own' AS `{o.upper() if i % 2 else o}`" for i, o in enumerate(outputs)])
    found = build(clash)
    assert found.columns[:len(clash.columns)] == clash.columns and found.columns[len(clash.columns):] == [o + "_" for o in outputs]
    rows = [tuple(r) for r in found.collect()]
    assert all(set(r[2:2 + len(outputs)]) == {"own"} for r in rows)
    assert sorted((r[:2] + r[2 + len(outputs):] for r in rows), key=str) == sorted((tuple(r) for r in build(plain).collect()), key=str)


def test_tables_go_with_the_scope(spark):
    df = spark.createDataFrame([(i, "A line that is long enough to be counted in all documents") for i in range(9)], "doc_id long, text string")
    with session.scope(spark):
        lines.dedupe(df).collect()
        paths = list(session._scopes[-1])
    assert paths and not any(session.exists(spark, p) for p in paths)
