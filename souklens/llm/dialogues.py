"""Conversation structure repair: the cheapest edits that make a conversation alternate, by Four-Russians tables.

A row of a conversation becomes one of nine symbols: it must go (blank, or role and text seen earlier), or its role
begins with s, u, a or another letter, with or without a cut-off end. The repaired roles must match ``(s?(ua)+)?``.
The costs of the four places of that pattern (nothing yet, after s, after u, after a) are a vector; with its least
entry taken off, and entries that can never win again set to ``FAR``, only a few dozen vectors exist. They are
found once, and for every vector and every block of ``BLOCK`` symbols the next vector and the added cost are put in
a table. A conversation is then processed a block at a time by lookup, which keeps the vectors at block borders.
Tracing expands blocks from the last to the first and marks every edit that lies on some cheapest way; a walk from
the first row takes the least letter marked, so ties go to the ASCII-least audit.

Rows are ordered by turn (nulls first), rows of one turn by role and the hash of their text. Spark deals rows without
their texts by conversation, sorted and streamed: a conversation of very many rows costs some bytes a row there. What
was seen earlier is told by an aggregate over hashes. Texts are dealt once, sorted alike, behind the audit of their
conversation, and streamed: no conversation's texts are held together.

A NULL in any column counts as one space, in ``turn`` also as the first turn; rows without id are one conversation.
Empty texts are blank. Repeated rows are duplicates. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from souklens.llm.common import quoted, store

#: Symbols of a block.
BLOCK = 3
#: Cost of a place that no cheapest way uses.
FAR = 99
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The place that a letter of the pattern leads to, and the place that an inserted or renamed row leads to.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
WRITTEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Symbol 0 must be deleted; symbol 1 + 2 * letter + cut is a row whose role begins with that letter.
LETTERS = ["s", "u", "a", ""]
SYMBOLS = 1 + 2 * len(LETTERS)
EDITS = "DIKR"


def edits(symbol: int, place: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row at a place of the pattern: letter, place reached, cost."""
    yield "D", place, DELETE
    if symbol:
        letter, cut = LETTERS[(symbol - 1) // 2], (symbol - 1) % 2 * CUT
        if place in NEXT[letter]:
            yield "K", NEXT[letter][place], KEEP + cut
        yield "R", WRITTEN[place], REROLE + cut


def inserted(costs: list[int]) -> list[int]:
    """Costs when rows may be inserted: three rounds of insertions reach every place."""
    out = list(costs)
    for _ in range(3):
        for place, to in WRITTEN.items():
            out[to] = min(out[to], out[place] + INSERT)
    return out


def shrunk(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """A vector less its least entry. Whatever follows a place can also follow ``ASSISTANT``, but for a kept system
    row, which is deleted there; so a place that is dearer than that by more than a deletion never wins again."""
    least, bound = min(costs), costs[ASSISTANT] + DELETE
    return tuple(c - least if c <= bound and c < FAR + least else FAR for c in costs), least


def step(vector: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
    costs = [2 * FAR] * 4
    for place, cost in enumerate(vector):
        if cost < FAR:
            for _, to, more in edits(symbol, place):
                costs[to] = min(costs[to], cost + more)
    return shrunk(inserted(costs))


class Tables:
    """All vectors that occur, and their transitions by symbol and by block."""

    def __init__(self, block: int = BLOCK):
        first, base = shrunk(inserted([0, 2 * FAR, 2 * FAR, 2 * FAR]))
        assert base == 0
        self.block, self.vectors, number = block, [first], {first: 0}
        one: list[list[tuple[int, int]]] = []
        for vector in self.vectors:  # grows while it is walked
            row = []
            for symbol in range(SYMBOLS):
                to, cost = step(vector, symbol)
                if to not in number:
                    number[to] = len(self.vectors)
                    self.vectors.append(to)
                row.append((number[to], cost))
            one.append(row)
        self.one = one
        to1, cost1 = np.array([[t for t, _ in r] for r in one]), np.array([[c for _, c in r] for r in one])
        to, cost = np.arange(len(one))[:, None], np.zeros((len(one), 1), np.int64)
        for _ in range(block):  # blocks one symbol longer each time; the first symbol counts most
            cost = (cost[:, :, None] + cost1[to]).reshape(len(one), -1)
            to = to1[to].reshape(len(one), -1)
        self.to, self.cost = to.tolist(), cost.tolist()

    def blocks(self, symbols: np.ndarray) -> tuple[list[int], int]:
        """Vectors at the borders of whole blocks, and the cost taken off so far."""
        whole = len(symbols) // self.block
        codes = symbols[:whole * self.block].reshape(whole, self.block) @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))
        at, total, borders = 0, 0, [0]
        for code in codes.tolist():
            total += self.cost[at][code]
            at = self.to[at][code]
            borders.append(at)
        return borders, total

    def audit(self, symbols: np.ndarray) -> tuple[int, str]:
        """The least cost and the ASCII-least audit of a conversation."""
        borders, total = self.blocks(symbols)
        tail, at = [], borders[-1]
        for symbol in symbols[(len(borders) - 1) * self.block:].tolist():
            tail.append(at)
            at, more = self.one[at][symbol]
            total += more
        vector = self.vectors[at]
        least = min(vector[START], vector[ASSISTANT])
        wanted = sum(1 << p for p in (START, ASSISTANT) if vector[p] == least)
        # from the last block to the first: vectors inside a block anew, then marks from its end
        marks: list[tuple] = [None] * len(symbols)
        ends = []
        for block in range(len(borders) - 1, -1, -1):
            begin = block * self.block
            part = symbols[begin:begin + self.block].tolist()
            if block == len(borders) - 1:
                inside = tail
            else:
                inside, at = [], borders[block]
                for symbol in part:
                    inside.append(at)
                    at = self.one[at][symbol][0]
            for i in range(len(inside) - 1, -1, -1):
                after = self.one[inside[i]][part[i]][0]
                marks[begin + i], ends_here, wanted = _marks(self.vectors[inside[i]], part[i], self.vectors[after], wanted)
                ends.append(ends_here)
        ends.reverse()  # insertions that follow each row
        before = _insertions(self.vectors[0], wanted)
        out, place = [], START
        for i in range(len(symbols) + 1):
            more = before if i == 0 else ends[i - 1]
            row = marks[i] if i < len(symbols) else None
            while True:
                choices = [*(row[place] if row else ()), *(("I",) if more >> place & 1 else ())]
                if not choices:
                    break  # the end of the conversation
                letter = min(choices)
                out.append(letter)
                if letter == "I":
                    place = WRITTEN[place]
                    continue
                place = next(to for name, to, _ in edits(int(symbols[i]), place) if name == letter)
                break
        return total + least, "".join(out)


@cache
def _closed(vector: tuple[int, ...], wanted: int) -> int:
    """``wanted`` and the places from which insertions lead there on a cheapest way."""
    for _ in range(3):
        for place, to in WRITTEN.items():
            if wanted >> to & 1 and vector[place] < FAR and vector[place] + INSERT == vector[to]:
                wanted |= 1 << place
    return wanted


@cache
def _insertions(vector: tuple[int, ...], wanted: int) -> int:
    """Places (bits) at which an insertion lies on a cheapest way to ``wanted``."""
    closed = _closed(vector, wanted)
    return sum(1 << p for p, to in WRITTEN.items() if closed >> to & 1 and vector[p] < FAR and vector[p] + INSERT == vector[to])


@cache
def _marks(vector: tuple[int, ...], symbol: int, after: tuple[int, ...], wanted: int) -> tuple[tuple[tuple[str, ...], ...], int, int]:
    """For each place before a row its edits on cheapest ways, the places after it where an insertion lies on one,
    and the places before it that such ways use."""
    closed, (_, off) = _closed(after, wanted), step(vector, symbol)
    rows, used = [], 0
    for place in range(4):
        good = tuple(letter for letter, to, cost in edits(symbol, place)
                     if vector[place] < FAR and closed >> to & 1 and vector[place] + cost - off == after[to])
        rows.append(good)
        used |= bool(good) << place
    return tuple(rows), _insertions(after, wanted), used


@cache
def tables() -> Tables:
    return Tables()


# --- rows ---------------------------------------------------------------------------------------------------------

SPACE = r"[\x20\x09-\x0D]"
REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role`` and ``text`` of the damaged rows; a dropped row stays with ``gone`` true, so that its
    conversation is known."""
    shown = lambda name: F.coalesce(quoted(name).cast("string"), F.lit(" "))
    dice = F.crc32(F.encode(F.concat(shown(conv), F.lit(":"), shown(turn)), "UTF-8")) % 20
    rows = df.select(
        quoted(conv).alias("conv"), quoted(turn).cast("long").alias("turn"), F.when(dice == 4, "user").otherwise(shown(role)).alias("role"),
        F.when(dice == 1, "").when(dice == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text)).alias("text"),
        (dice == 0).alias("gone"), F.when(dice == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with the hash that orders those of one turn."""
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(1), "role")})


ORDER = ["turn", "role", "h1", "h2"]  # nulls first
BLANKS = " \t\n\x0b\x0c\r"


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows without their texts: letter of the role, whether blank or cut off, and whether seen in an earlier turn."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    letter = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    light = _ordered(rows).select("conv", "gone", *ORDER, letter.alias("letter"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = (light.where(~F.col("gone")).groupBy("conv", "h1", "h2").agg(F.count("*").alias("n"), F.min(turn).alias("first"))
             .where(F.col("n") > 1).select(*[F.col(c).alias(f"{c}_") for c in ("conv", "h1", "h2")], "first"))
    joined = light.join(first, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")), "left")
    return joined.select("conv", "gone", *ORDER, "letter", "blank", "cut", F.coalesce(turn > F.col("first"), F.lit(False)).alias("later"))


class _Conversation:
    """The rows of one conversation so far, in order."""

    def __init__(self) -> None:
        self.symbols: list[np.ndarray] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turns: np.ndarray, known: np.ndarray, h1: np.ndarray, h2: np.ndarray, letter: np.ndarray, blank: np.ndarray, cut: np.ndarray, later: np.ndarray) -> None:
        """Rows that are left after damage; ``known`` tells turns from NULL."""
        if not len(turns):
            return
        before = self.last or (0, False, h1[0] + np.int64(1), 0, -1)
        prior = lambda i, x: np.concatenate([[before[i]], x[:-1]])
        same_turn = (prior(0, turns) == turns) & (prior(1, known) == known)
        same = same_turn & (prior(2, h1) == h1) & (prior(3, h2) == h2)
        duplicate = ~blank & (later | same)
        truncated = ~blank & ~duplicate & cut
        pairs = prior(4, letter) * 4 + letter  # s u, u a, a u
        self.illegal += int((~np.isin(pairs, (1, 6, 9))).sum()) - (self.last is None)
        self.blank += int(blank.sum())
        self.duplicate += int(duplicate.sum())
        self.truncated += int(truncated.sum())
        self.turns += int((known & ~same_turn).sum())
        if known.any():
            self.low = int(turns[known][0]) if self.low is None else self.low
            self.high = int(turns[-1])
        self.symbols.append(np.where(blank | duplicate, 0, 1 + 2 * letter + truncated).astype(np.int8))
        self.last = (turns[-1], known[-1], h1[-1], h2[-1], letter[-1])

    def report(self) -> tuple:
        symbols = np.concatenate(self.symbols) if self.symbols else np.zeros(0, np.int8)
        cost, audit = tables().audit(symbols.astype(np.int64) if len(symbols) < 1 << 16 else symbols)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    """Begins and ends of the runs of equal values, NULL included."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    borders = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return list(zip(borders, borders[1:])) if len(codes) else []


def reports(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (see ``damaged``) with its faults, the least cost and the audit."""
    schema = T.StructType([rows.schema["conv"], *[T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in REPORT]])
    dealt = _symbols(rows).repartition("conv").sortWithinPartitions("conv", *ORDER)

    def run(batches):
        name, now, done = None, None, []

        def flush():
            columns = list(zip(*done, strict=True))
            made = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(columns[1:], REPORT, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(made, schema.names)

        for batch in batches:
            kind = batch.column(0).type
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            turns = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            there = ~batch.column(1).to_numpy(zero_copy_only=False)
            h1, h2, letter, blank, cut, later = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, 10))
            for begin, end in _runs(batch.column(0)):
                value = batch.column(0)[begin].as_py()
                if now is None or value != name:
                    if now is not None:
                        done.append((name, *now.report()))
                    name, now = value, _Conversation()
                keep = np.flatnonzero(there[begin:end]) + begin
                now.add(*(x[keep] for x in (turns, known, h1, h2, letter, blank, cut, later)))
            if len(done) >= 5_000:
                yield flush()
        if now is not None:
            done.append((name, *now.report()))
            yield flush()

    return dealt.select("conv", "gone", "turn", "role", "h1", "h2", "letter", "blank", "cut", "later").mapInArrow(run, schema)


def _texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Reports and, behind each, the rows of its conversation in order."""
    texts = _ordered(rows.where(~F.col("gone"))).select("conv", F.lit(1).alias("kind"), *ORDER, "text")
    heads = found.select("conv", F.lit(0).alias("kind"), *[F.col(n) for n, _ in REPORT])
    both = texts.unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER).select("conv", "kind", "role", "text", *[n for n, _ in REPORT])


def _written(audit: Iterator[str], role: str | None, text: str | None, place: int) -> Iterator[tuple[str, str, str, int]]:
    """Edit, role and text of what stands for one row (or, without a row, of the end), and the place reached."""
    for letter in audit:
        if letter == "I":
            place = WRITTEN[place]
            yield "I", ROLE[place], "", place
            continue
        if letter == "K":
            place = NEXT[role[0]][place]
        elif letter == "R":
            place = WRITTEN[place]
            role = ROLE[place]
        if letter != "D":
            yield letter, role, text, place
        return


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that stand after repair: ``conv``, ``nth`` (from 0), ``edit`` (K, R or I), ``role`` and ``text``."""
    schema = T.StructType([rows.schema["conv"], T.StructField("nth", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]])

    def run(batches):
        audit, name, place, nth = iter(()), None, START, 0
        for batch in batches:
            out: list[tuple] = []

            def write(role=None, text=None):
                nonlocal place, nth
                for edit, said, words, place in _written(audit, role, text, place):
                    out.append((name, nth, edit, said, words))
                    nth += 1

            for conv, kind, role, text, letters in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 10)), strict=True):
                if kind == 0:
                    write()
                    audit, name, place, nth = iter(letters), conv, START, 0
                else:
                    write(role, text)
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)
        last = [(name, nth + i, *x[:3]) for i, x in enumerate(_written(audit, None, None, place))]
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*last, strict=True), kinds, strict=True)], schema.names)

    return _texts(rows, found).mapInArrow(run, schema)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The reports with the SHA-256 of each repaired conversation: ``role:text``, joined by line feeds."""
    schema = T.StructType([*found.schema.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        audit, head, place, digest, begun = iter(()), None, START, hashlib.sha256(), False
        for batch in batches:
            done: list[tuple[dict, str]] = []

            def write(role=None, text=None):
                nonlocal place, begun
                for _, said, words, place in _written(audit, role, text, place):
                    digest.update(f"{chr(10) if begun else ''}{said}:{words}".encode("utf-8", "surrogatepass"))
                    begun = True

            heads = batch.select([0, *range(4, 11)])
            for i, (kind, role, text, letters) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 10)), strict=True)):
                if kind == 0:
                    write()
                    if head is not None:
                        done.append((head, digest.hexdigest()))
                    audit, place, digest, begun = iter(letters), START, hashlib.sha256(), False
                    head = heads.slice(i, 1).to_pylist()[0]
                else:
                    write(role, text)
            like = heads.schema
            if done:
                yield _reported(done, like, schema.names)
        if head is not None:
            write()
            yield _reported([(head, digest.hexdigest())], like, schema.names)

    return _texts(rows, found).mapInArrow(run, schema)


def _reported(done: list[tuple[dict, str]], like: pa.Schema, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([h[f.name] for h, _ in done], f.type) for f in like]
    return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done], pa.string())], names)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The damaged rows of ``df`` and the reports on them, which are written to the shared folder."""
    rows = damaged(df, conv, turn, role, text)
    return rows, store(reports(rows), "conversations")
