"""Phrase mining against plain counts."""

import random
import re
from collections import Counter

import numpy as np

from souklens.llm import phrases


def plain(rows, least, longest, per_lang, within=100):
    f, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i:i + k])
                    f[key] = f.get(key, 0) + 1
    found = {}
    many = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, words), a in many.items():
        cuts = [(1000 * a * total[lang] // (f[lang, words[:c]] * f[lang, words[c:]]), c, f[lang, words[:c]], f[lang, words[c:]]) for c in range(1, len(words))]
        score, _, l, r = min(cuts)
        inside = any(lang == other and len(w) > len(words) and any(w[i:i + len(words)] == words for i in range(len(w))) and 100 * b >= within * a for (other, w), b in many.items())
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, some in found.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:per_lang]))


def rows_of():
    random_ = random.Random(2)
    words = [f"w{i}" for i in range(25)] + ["Été", "DU", " x", "日本", "\x1f", "a\x00b"]
    rows = []
    for i in range(500):
        text = " ".join(random_.choices(words, [1 / (j + 1) for j in range(len(words))], k=random_.randint(0, 60)))
        text = re.sub(" ", lambda m: random_.choice([" "] * 12 + [". ", "\t", "\n", ", ", "  "]), text)
        rows.append((text + (" the Long common passage of words" if i % 3 == 0 else ""), random_.choice(["en", "en", "fr", None, "und", ""])))
    return rows + rows[:40] + [(None, "en"), ("", "fr"), ("...", "xx"), ("one", "yy"), ("of the " * 9_000, "en")]


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_plain_counts(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, n int, phrase string").repartition(6)
    want = plain(rows, 8, 5, 50)
    assert result(phrases.collocations(df, least=8, per_lang=50)) == want
    # containers that burst, tries and words that are written out again and again, a full bitmap
    for name, value in (("BURST", 8), ("MOST_ENTRIES", 50), ("MOST_WORDS", 12), ("MOST_BITS", 1 << 18)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr("souklens.llm.common.SLICE_BYTES", 500)
    assert result(phrases.collocations(df, least=8, per_lang=50)) == want
    assert result(phrases.collocations(df, least=20, longest=3, per_lang=7, within=60)) == plain(rows, 20, 3, 7, 60)
    assert result(phrases.collocations(df, least=5, longest=2)) == plain(rows, 5, 2, 2000)
    assert phrases.collocations(df.limit(0)).collect() == []


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Scores of counts whose products pass 64 bits."""
    a, l, r, n = 2_000_000_011, 3_000_000_019, 4_000_000_007, 9_000_000_000_000_037
    rows = [("en", "", 0, n), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)]
    monkeypatch.setattr(phrases, "frequent", lambda *args: spark.createDataFrame(rows, "lang string, phrase string, size int, n long"))
    assert result(phrases.collocations(spark.range(1))) == [("en", 1, "x y", a, l, r, n, 1000 * a * n // (l * r))]


def test_trie_counts_and_runs():
    random_ = np.random.default_rng(3)
    for size in (1, 2, 3, 5):
        trie, rows = phrases.HatTrie(size, burst=5), random_.integers(1, 12, (4_000, size))
        got: Counter = Counter()
        for part in np.array_split(rows, 9):
            trie.add(part)
            for run, counts in trie.spill(60):
                assert [tuple(r) for r in run] == sorted(tuple(r) for r in run)
                got.update({tuple(map(int, r)): int(n) for r, n in zip(run, counts, strict=True)})
            assert trie.entries <= 60 or size == 1
        for run, counts in trie.spill():
            got.update({tuple(map(int, r)): int(n) for r, n in zip(run, counts, strict=True)})
        assert trie.entries == 0 and got == Counter(map(tuple, rows.tolist()))


def test_small_subtrees_share_a_run():
    trie, rows = phrases.HatTrie(3, burst=5), np.random.default_rng(4).integers(1, 3_000, (20_000, 3))
    trie.add(rows)
    runs = list(trie.spill())
    assert len(runs) == 1 and trie.entries == 0
    run, counts = runs[0]
    assert counts.sum() == len(rows) and [tuple(r) for r in run] == sorted(set(map(tuple, rows.tolist())))


def test_distinct_rows():
    random_ = np.random.default_rng(5)
    for most in (1, 9, (1 << 20) - 1, 1 << 21, (1 << 31) - 1):
        for size in (1, 2, 3, 4, 5):
            rows = random_.integers(0, most + 1, (300, size))[random_.integers(0, 300, 2_000)]
            got, n = phrases.distinct(rows)
            want, times = np.unique(rows, axis=0, return_counts=True)
            assert (got == want).all() and (n == times).all()
