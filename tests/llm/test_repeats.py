"""Repeated passages against a dictionary of all 100-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from souklens.llm import repeats
from souklens.llm.queries import QUERIES

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ñu", "re", "sta", "té") for b in ("n", "rd", "s", "bel", "ont", "", "mü")]


def brute(rows, match=100):
    """Result by doc_id: bytes, removed bytes, runs, kept bytes."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - match + 1):
            part = data[i:i + match]
            if part in seen:
                gone[i:i + match] = b"\1" * match
            seen.add(part)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out


def corpus(seed=3, n=60):
    draw = random.Random(seed)
    prose = lambda k: " ".join(draw.choice(WORDS) for _ in range(k))
    shared = [prose(k) for k in (18, 22, 30, 60, 200)]
    rows = [(i * 3, " ".join(draw.choice(shared) if draw.random() < 0.4 else prose(draw.randint(1, 60)) for _ in range(draw.randint(1, 6)))) for i in range(n)]
    near = prose(150).split()
    for i in range(12):
        words = list(near)
        for _ in range(i % 4):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, "a" * 500), (2001, "a" * 99), (2002, "a" * 100), (2003, "ab" * 300), (2004, ""), (2005, None), (2006, shared[4]), (2007, "\n".join(shared) * 40)]
    rows += [(3000 + i, shared[3]) for i in range(40)]
    return rows


def result(df):
    return {r[0]: (r["n_bytes"], sum(x["end"] - x["begin"] for x in r["runs"]), len(r["runs"]), bytes(r["kept"])) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(repeats.remove_repeats(df, keep=["doc_id"])) == brute(rows)


def test_runs_over_many_partitions(spark):
    rows = corpus(4, 20) + [(5000 + i, "the same passage of words that stands in all of these " * 3 + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(repeats.remove_repeats(df, keep=["doc_id"])) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_other_lengths(spark):
    rows = corpus(9, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeats.remove_repeats(df, keep=["doc_id"], match=40, gram=12)) == brute(rows, 40)


def test_nulls_repeated_rows_and_names(spark):
    text = "x".join(str(i) for i in range(80))
    df = spark.createDataFrame([(1, text, 1, 2), (1, text, 3, 4), (None, text, 5, 6), (7, None, 7, 8)], "doc_id long, text string, place long, low int")
    found = sorted((r["doc_id"] or 0, r["place"], r["n_bytes"], len(r["kept"])) for r in repeats.remove_repeats(df).collect())
    n = len(text)
    assert found == [(0, 5, n, 0), (1, 1, n, n), (1, 3, n, n), (7, 7, 0, 0)]


def test_many_texts_under_one_id(spark):
    """Among 4,000 texts, 20 bits of a hash would collide some eight times."""
    draw = random.Random(6)
    prose = lambda k: " ".join(draw.choice(WORDS) for _ in range(k))
    shared = prose(30)
    texts = [f"{i:04} {shared if i % 2 else ''}" if i % 8 < 4 else f"{prose(draw.randint(1, 25))} {shared if i % 2 else ''} {prose(4)}" for i in range(4000)]
    for doc in (None, 5):
        df = spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id long, n int, text string")
        got, whole = result(repeats.remove_repeats(df, keep=["n"])), 0
        for i, text in enumerate(texts):
            size, gone, runs, kept = got[i]
            assert size == len(text.encode()) == gone + len(kept)
            whole += shared in text and not runs
            if shared not in text:
                assert not runs and kept == text.encode()
            elif runs:  # some bytes around the passage are often shared too
                assert runs == 1 and len(shared.encode()) <= gone < len(shared.encode()) + 60
        assert whole == 1


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    want = {d: (n, g, k, hashlib.sha256(kept).hexdigest()) for d, (n, g, k, kept) in brute(rows).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op9_repeated_passages"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_rules_and_padding(spark):
    draw = random.Random(9)
    prose = lambda k: " ".join(draw.choice(WORDS) for _ in range(k))
    units = ["-", "=-", " ", "ab ", "\u2500", "|   |   ", "0123456789abcdefghijklmnopqrstu", "0123456789abcdefghijklmnopqrstuvwxyz+"]
    rows = [(i, prose(3) + draw.choice(units) * draw.randint(20, 400) + prose(draw.randint(0, 30)) + draw.choice(units) * draw.randint(5, 150)) for i in range(60)]
    rows += [(100 + i, "-" * n) for i, n in enumerate((99, 100, 101, 102, 131, 132, 133, 200))] + [(200 + i, "x" + "-" * n + "y") for i, n in enumerate((60, 98, 99, 100, 101, 140))]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string").repartition(4)
    assert result(repeats.remove_repeats(df, keep=["doc_id"])) == brute(rows)


def test_pieces(spark, monkeypatch):
    rows = corpus(5, 15) + [(4000, "a" * 3000 + "-" * 900 + "b"), (4001, "x" + "ab " * 700)]
    want, parser, data = brute(rows), repeats.Parser(), "".join(t or "" for _, t in corpus(6, 8)).encode()
    data = repeats.np.frombuffer(data, "u1")
    whole = parser.phrases(data)
    monkeypatch.setattr(repeats, "PIECE", 333)
    pieces = dict(zip(*[x.tolist() for x in parser.phrases(data)[::2]], strict=True))
    assert all(pieces[p] == h for p, h in zip(*[x.tolist() for x in whole[::2]], strict=True))
    # settings of this process do not reach Python workers, so the frames' functions are called here
    out = [(i, parser.phrases(repeats.np.frombuffer((t or "").encode(), "u1"))) for i, t in rows if len((t or "").encode()) >= 100]
    assert all((repeats.np.diff(at) > 0).all() for _, (at, *_) in out)
    monkeypatch.undo()
    assert result(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"])) == want


def test_constant_text_has_few_phrases():
    parser = repeats.Parser()
    for unit in (b"a", b"-=", b"abc "):
        data = repeats.np.frombuffer(unit * (9_000_000 // len(unit)), "u1")
        at, *_ = parser.phrases(data)
        assert len(at) < 1000 and repeats.periodic(data, 100)


@pytest.mark.parametrize("match", [2, 7, 15, 16, 17, 40, 100])
@pytest.mark.parametrize("probes", [3, 1 << 16])
def test_periods_against_all_windows(match, probes, monkeypatch):
    monkeypatch.setattr(repeats, "PROBES", probes)
    draw = np.random.default_rng(match)
    for _ in range(60):
        data = b"".join(bytes(draw.integers(97, 97 + draw.integers(1, 4), draw.integers(1, 40)).astype(np.uint8)) * int(draw.integers(1, 9)) for _ in range(4))
        told = {i for a, b in repeats.periodic(np.frombuffer(data, np.uint8), match) for i in range(a, b)}
        assert told == {i for i in range(len(data) - match + 1) for p in range(1, repeats.MOST_PERIOD + 1)
                        if i >= p and data[i:i + match] == data[i - p:i - p + match]}
