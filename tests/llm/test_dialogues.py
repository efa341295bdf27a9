"""Conversation repair against a plain search over all edits, and rows against a plain reading of the rules."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from souklens.llm import dialogues

GOOD = re.compile("(s?(ua)+)?")


def search(rows, most=12):
    """Least cost and ASCII-least audit of (initial, must go, cut off), by cheapest-first search over edited prefixes."""
    import heapq
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, initials = heapq.heappop(heap)
        tail = initials[-1:]  # what may follow depends on the last initial alone
        if (i, tail) in done:
            continue
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, audit
        done.add((i, tail))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
        steps = [(2, "I", i, c) for c in follows if c != "s"]
        if i < len(rows):
            letter, gone, cut = rows[i]
            steps.append((3, "D", i + 1, ""))
            if not gone:
                steps += [(cut, "K", i + 1, letter)] * (letter != "" and letter in follows) + [(2 + cut, "R", i + 1, c) for c in follows if c != "s"]
        for more, name, to, c in steps:
            heapq.heappush(heap, (cost + more, audit + name, to, initials + c))
    raise AssertionError


def symbol(row):
    letter, gone, cut = row
    return 0 if gone else 1 + 2 * ("sua".find(letter) if letter in "sua" else 3) + cut


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_tables_equal_search(block):
    tables, random_ = dialogues.Tables(block), random.Random(block)
    for _ in range(1_500):
        weights = [random_.random() ** 2 for _ in range(9)]
        rows = [("sua_"[max(0, s - 1) // 2], s == 0, int(s > 0 and s % 2 == 0)) for s in random_.choices(range(9), weights, k=random_.choice([0, 1, 2, 3, 5, 6, 7, 12]))]
        assert tables.audit(np.array([symbol(r) for r in rows], np.int64)) == search(rows)


def plain(rows):
    """Conversation -> report and hash, from rows (conv, turn, role, text)."""
    shown = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        after = out.setdefault(conv, [])
        dice, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if dice == 0:
            continue
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        after += [(turn, "user" if dice == 4 else role, text)] * (2 if dice == 3 else 1)
    reports = {}
    for conv, after in out.items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, edited, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in after:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            edited.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = search(edited)
        turns = {t for t, *_ in after if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(edited, edited[1:]))
        lines, i, last = [], 0, ""
        for letter in audit:
            following = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if letter == "I":
                lines.append((following, ""))
            elif letter != "D":
                lines.append((after[i][1] if letter == "K" else following, after[i][2]))
            i += letter != "I"
            last = lines[-1][0][:1] if lines else ""
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        reports[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n.values(), illegal, cost, audit, digest)
    return reports


def rows_of():
    random_ = random.Random(5)
    words = ["Yes.", "no", "Why? ", "What", " \t\n", "", "Fine!\n", "é.", None, "Ok. Then"]
    rows = []
    for conv in [*range(120), None, -5]:
        for turn in range(random_.choice([0, 1, 2, 3, 5, 8, 20])):
            role = random_.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, turn * random_.choice([1, 1, 3]) if random_.random() > 0.05 else None, role, random_.choice(words) if random_.random() < 0.7 else f"Text {turn}."))
    keyed = {(c, t): (c, t, r, x) for c, t, r, x in rows}  # one row a turn
    rows = list(keyed.values())
    return rows + rows[::7] + [(900, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(3_000)]


def test_queries_rows(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv int").repartition(5)
    for after in (4, 23):
        spark.conf.set("spark.sql.shuffle.partitions", str(after))
        damaged, found = dialogues.repair(df)
        got = {r["conv"]: tuple(r)[1:] for r in dialogues.digests(damaged, found).collect()}
        assert got == plain(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    # rows and digests agree
    lines = {}
    for r in sorted(dialogues.repaired(damaged, found).collect(), key=lambda r: r["nth"]):
        assert r["nth"] == len(lines.setdefault(r["conv"], []))
        assert (r["edit"] == "I") <= (r["text"] == "")
        lines[r["conv"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in got} == {c: v[-1] for c, v in got.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows, found = dialogues.repair(df)
    assert dialogues.digests(rows, found).collect() == [] and dialogues.repaired(rows, found).collect() == []


def test_one_turn_with_several_rows(spark):
    """Rows of one turn stand by role; every one is damaged alike; a long text stays whole."""
    long = "x" * 3_000_000 + "."
    df = spark.createDataFrame([(8, 1, "user", "b."), (8, 1, "assistant", long), (8, 1, "system", "a.")], "conv_id long, turn long, role string, text string")
    assert zlib.crc32(b"8:1") % 20 > 4
    rows, found = dialogues.repair(df)
    assert [(r["edit"], r["role"]) for r in sorted(dialogues.repaired(rows, found).collect(), key=lambda r: r["nth"])][0][1] in ("user", "system")
    report = dialogues.digests(rows, found).collect()[0]
    assert (report["illegal"], report["cost"]) == (1, search([("a", False, 0), ("s", False, 0), ("u", False, 0)])[0])
