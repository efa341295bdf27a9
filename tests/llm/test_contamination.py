"""Decontamination: planted passages, edited ones, and the alignment against a full table."""

import random

from souklens.llm import contamination
from souklens.llm.queries import QUERIES

DRAW = random.Random(4)
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ñu", "re") for b in ("n", "rd", "s", "bel") for c in ("a", "ont", "é")]


def prose(n):
    return " ".join(DRAW.choice(WORDS) for _ in range(n))


def edited(text, n):
    letters = list(text)
    for _ in range(n):
        at, how = DRAW.randrange(len(letters)), DRAW.random()
        if how < 0.4:
            letters[at] = DRAW.choice("xyz")
        elif how < 0.7:
            del letters[at]
        else:
            letters.insert(at, DRAW.choice("xyz"))
    return "".join(letters)


def table(segment, region):
    """Least edits between the segment and a part of the region, by the full table."""
    row = [0] * (len(region) + 1)
    for i, a in enumerate(segment, 1):
        above, row = row, [i]
        for j, b in enumerate(region, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
    return min(row)


def test_alignment_equals_the_full_table():
    for k in range(120):
        segment = prose(6).encode()[:60]
        near = edited(segment.decode("utf-8", "ignore"), k % 9).encode() if k % 5 else prose(6).encode()[:60]
        region = prose(1).encode()[:k % 7] + near + prose(1).encode()[:k % 5]
        want = table(segment, region)
        got = contamination.alignment(segment, region, 6)
        assert got == (want if want <= 6 else None)


ITEMS = [(i, prose(DRAW.randint(8, 40))) for i in range(30)] + [(100, "one two three four"), (101, "a"), (102, None), (103, ""), (104, None), (None, prose(20))]


def documents():
    rows, want = [], {}
    for i in range(200):
        text, item = prose(DRAW.randint(5, 300)), None
        if i % 3 == 0:
            item = i % 30
            passage = contamination.normalized(ITEMS[item][1]).decode()
            passage = edited(passage, int(len(passage) * 0.05)) if i % 2 else ITEMS[item][1].upper().replace(" ", ",\n ")
            text = f"{text}. {passage} {prose(3)}"
        rows.append((i, text))
        want[i] = [] if item is None else [item]
    rows += [(900, None), (901, ""), (902, "x " * 100_000 + ITEMS[3][1]), (903, "One two, THREE four!"), (903, "One two, THREE four!")]
    return rows, want | {900: [], 901: [], 902: [3], 903: [100]}


def test_planted_passages(spark, monkeypatch):
    rows, want = documents()
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    result = lambda: {r["doc_id"]: [h["item"] for h in r["hits"]] for r in contamination.mark(df, bench, keep=["doc_id"]).collect()}
    assert result() == want
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 1500)  # several blocks
    assert result() == want


def test_excerpts_at_all_offsets():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9)))
    item = contamination.normalized(" ".join(word() for _ in range(60)))
    index = contamination.Index.of([(7, item), (8, contamination.normalized(" ".join(word() for _ in range(60))))])
    around = lambda part: "zz " * 40 + part.decode() + " qq" * 40
    for n in (75, 85, 100, 120):
        for at in range(len(item) - n + 1):
            assert [h["item"] for h in index.hits(around(item[at:at + n]))] == [7]
    for n in (60, 66):
        assert not any(index.hits(around(b"zz" + item[at:at + n] + b"zz")) for at in range(0, len(item) - n, 40) if item[at:at + n].count(b" ") < 12)


def test_words_in_a_row():
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("i", "on", "ut", "elk")]
    index = contamination.Index.of([(7, " ".join(words).encode())])
    for at in range(len(words) - 13):
        part = " ".join(words[at:at + 13])
        assert len(part) < 74
        for before in ("", "zz ", "zz " * 21_843, "zz " * 21_820):  # also at the edge of a piece
            assert [(h["item"], h["edits"]) for h in index.hits(f"{before}{part} zz")] == [(7, 0)]
        assert index.hits("zz " + " ".join(words[at:at + 12]) + " zz") == []


def test_one_index_at_a_time(spark, monkeypatch):
    rows, want = documents()
    df, bench, steps = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"), []
    of, store = contamination.Index.of, contamination.store
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 2500)
    monkeypatch.setattr(contamination.Index, "of", lambda items: steps.append("index") or of(items))
    monkeypatch.setattr(contamination, "store", lambda *args: steps.append("store") or store(*args))
    marked = contamination.mark(df, bench, keep=["doc_id"])
    assert len(steps) > 2 and steps == ["index", "store"] * (len(steps) // 2)
    assert {r["doc_id"]: [h["item"] for h in r["hits"]] for r in marked.collect()} == want


def test_empty(spark):
    rows, bench = spark.createDataFrame([(1, "text", 5)], "doc_id long, text string, hits int"), spark.createDataFrame([], "item_id long, text string")
    assert contamination.mark(rows, bench, keep=["doc_id"]).first()["hits"] == []
    assert contamination.mark(rows.limit(0), bench, keep=["doc_id"]).collect() == []


def test_query(spark, con):
    items = [(i, contamination.normalized(t)) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]
    got = {r["doc_id"]: r for r in QUERIES["op2_contamination"](spark, "/root/testdata/sf0.001").collect()}
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        whole = [i for i, t in items if t in contamination.normalized(text)]
        assert set(whole) <= set(got[doc]["items"]) and got[doc]["contaminated"] == bool(got[doc]["items"]) and got[doc]["n_items"] == len(got[doc]["items"])
        assert bool(whole) == got[doc]["contaminated"]


PHRASE = "which of the following is the correct answer to the question about"


def test_common_phrases_in_bounded_memory(monkeypatch):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 8)))
    items = [(i, contamination.normalized(f"{PHRASE} {word()} {word()} {word()} {word()} {word()}")) for i in range(300)]
    monkeypatch.setattr(contamination, "PAIRS", 1 << 17)
    index, most = contamination.Index.of(items), []
    paired = contamination.Index._paired
    monkeypatch.setattr(contamination.Index, "_paired", lambda self, out, data, at, *rest: most.append(len(at)) or paired(self, out, data, at, *rest))
    text = f"{PHRASE} " * 900
    assert index.hits(text) == []
    assert [h["item"] for h in index.hits(f"{text} {items[77][1].decode()} {text}")] == [77]
    assert most and max(most) <= contamination.PAIRS


def test_equal_letters():
    index = contamination.Index.of([(1, b"a" * 1000), (2, b"b" * 90 + b"a" * 5000)])
    assert [h["item"] for h in index.hits("a" * 65_000)] == [1, 2]
    assert [(h["item"], h["edits"]) for h in index.hits("c" * 70_000 + "a" * 74)] == [(1, 6), (2, 6)]
    assert index.hits("a" * 73 + " " + "c" * 70_000) == []


def test_boxes_find_the_same(monkeypatch):
    rows, _ = documents()
    items = sorted({(i, contamination.normalized(t)) for i, t in ITEMS if i is not None and t}) + [(200, b"ab " * 400), (201, (b"ab " * 30 + b"kan ") * 20)]
    texts = [t for _, t in rows] + ["ab " * 500, ("ab " * 30 + "kan ") * 40, ("ab " * 29 + "kon ") * 40]
    index = contamination.Index.of(items)
    want = [index.hits(t) for t in texts]
    assert sum(map(len, want)) > 60
    for pairs in (30_000,):
        monkeypatch.setattr(contamination, "PAIRS", pairs)
        got = [index.hits(t) for t in texts]
        assert [[(h["item"], h["edits"]) for h in hs] for hs in got] == [[(h["item"], h["edits"]) for h in hs] for hs in want]


def test_edited_excerpts_by_brute_force():
    """Every excerpt that the full table finds within the edits of a segment is found, and nothing else."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9)))
    item = contamination.normalized(" ".join(word() for _ in range(20)))
    index, seen = contamination.Index.of([(7, item)]), set()
    for k in range(28):
        at = draw.randrange(len(item) - 90)
        part = edited(item[at:at + 90].decode(), k % 14)
        text = contamination.normalized(f"zz qq {part} rr tt")
        least = min(table(item[i:i + 80], text) for i in range(len(item) - 79))
        hits = index.hits(text.decode())
        run = max((len(c.split()) for c in (item[i:j].decode() for i in range(0, len(item), 1) for j in range(i + 25, len(item) + 1) if (i == 0 or item[i - 1] == 32) and (j == len(item) or item[j] == 32)) if f" {c} " in f" {text.decode()} "), default=0)
        assert bool(hits) == (least <= 6 or run >= 13)
        seen.add(bool(hits))
    assert seen == {True, False}


def test_texts_of_one_item(spark, monkeypatch):
    passages = [prose(30) for _ in range(6)]
    bench = spark.createDataFrame([(5, p) for p in passages], "item_id long, text string")
    df = spark.createDataFrame([(1, " zz ".join(passages)), (2, edited(passages[0], 3) + " qq " + passages[3])], "doc_id long, text string")
    result = lambda: {r["doc_id"]: [(h["item"], h["edits"]) for h in r["hits"]] for r in contamination.mark(df, bench, keep=["doc_id"]).collect()}
    one = result()
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 200)
    assert one == result() == {1: [(5, 0)], 2: [(5, 0)]}
