"""Ids and decoded texts against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from souklens.llm import bpe
from souklens.llm.queries import QUERIES, WORD_BPE

TEXTS = ["Hello  wörld!!", "aaaaaaaaaaaa aaa aa a", "I'll we're 'S 's don't", "<|endoftext|>a<|startoftext|> b<|endoftext", "ΑΣ ΟΔΟΣ Σ", "İstanbul ﬁ é é",
         "1234 ½ ² ٣", "日本語 テスト", "\U0001f600‍❤", "a\x1cb\x1f c\x85d e", "", None, " \n\t", "x" * 4000 + "!?" * 2000, "é" * 1500, "ab" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_equals_the_library(library):
    coder = bpe.Coder(bpe.Vocabulary.read(WORD_BPE))
    for _ in range(2):  # unseen and remembered
        for text, ids in zip(TEXTS, coder.encode(TEXTS), strict=True):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == want
            assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_all_letters_of_the_standard(library):
    import sys
    import unicodedata

    coder = bpe.Coder(bpe.Vocabulary.read(WORD_BPE))
    known = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")][::7]
    texts = [f"a{c}b {c}'S" for c in known]
    for text, ids, want in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text


def test_forgetting_changes_nothing(monkeypatch):
    coder = bpe.Coder(bpe.Vocabulary.read(WORD_BPE))
    first = [i.tolist() for i in coder.encode(TEXTS)]
    monkeypatch.setattr(bpe, "MOST_WORDS", 0)
    monkeypatch.setattr(bpe, "LONG_WORD", 2)
    small = bpe.Coder(bpe.Vocabulary.read(WORD_BPE))
    assert [small.encode([t])[0].tolist() for t in TEXTS] == first


def test_frames(spark):
    df = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x"), (None, None, None)], "doc_id long, text string, ids string")
    rows = bpe.round_trip(df, WORD_BPE, keep=["doc_id"]).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in rows)[0] == (0, 0, [], "")
    assert bpe.encode(df, WORD_BPE, keep=["doc_id"]).collect()[0]["ids"] == np.frombuffer(rows[0]["ids"], "<u4").tolist()
    assert bpe.round_trip(df.limit(0), WORD_BPE, keep=["doc_id"]).collect() == []


def test_query(spark, con, library):
    want = {}
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda data: hashlib.sha256(data).hexdigest()
        want[doc] = (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode()))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op6_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want
