"""Byte-pair encoding and decoding in batched merge rounds.

All distinct words of a slice that are not known yet lie in one flat array of symbols. A round finds
the rank of every adjacent pair by binary search in the sorted pair keys, takes the lowest rank of
each word, merges its places from the left and drops finished words; rounds end when no pair is left.

The vocabulary is read on the driver (tens of thousands of entries, refused beyond ``MOST_ENTRIES``)
and broadcast. Texts are only mapped, without a shuffle.

NULL is an empty text: no ids, and an empty decoded text. Strings of special tokens are cut out of the
raw text first and become their ids. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from souklens.llm.common import map_texts

MOST_ENTRIES = 1 << 20
#: Words whose ids a task remembers; beyond that it forgets all and starts again.
MOST_WORDS = 500_000
#: Words longer than this many bytes are not remembered.
LONG_WORD = 200


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding needs: symbols of bytes inside and at the end of a word, pair keys in order with
    their rank and merged symbol, token texts by id, the pattern of words, special tokens."""

    inner: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    joined: np.ndarray
    tokens: list[str]
    pattern: str
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a tokenizer file with a BPE model over byte letters with a word-end suffix."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, ids = spec["model"], spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(ids) + len(special) > MOST_ENTRIES:
            raise ValueError(f"a vocabulary of {len(ids)} entries is too large to broadcast")
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if model["type"] != "BPE" or len(splits) != 1 or spec["pre_tokenizer"]["pretokenizers"][-1]["type"] != "ByteLevel":
            raise ValueError("not a BPE file whose words are split by one pattern and written as byte letters")
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for text, i in [*ids.items(), *special.items()]:
            tokens[i] = text
        letters, end = byte_letters(), model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * len(tokens) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(np.array([ids[x] for x in letters], np.int64), np.array([ids[x + end] for x in letters], np.int64), keys[order],
                   order.astype(np.int64), np.array([ids[a + b] for a, b in pairs], np.int64)[order], tokens, splits[0]["pattern"]["Regex"], special)


def merge_rounds(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids of each non-empty word, as little-endian unsigned 32-bit integers."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    symbols, ends = vocabulary.inner[flat], np.cumsum(sizes) - 1
    symbols[ends] = vocabulary.last[flat[ends]]
    owner = np.repeat(np.arange(len(words)), sizes)
    none, width, done = len(vocabulary.keys), len(vocabulary.tokens), []

    def found(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at ``left``."""
        wanted = symbols[left] * width + symbols[left + 1]
        at = np.minimum(np.searchsorted(vocabulary.keys, wanted), none - 1)
        known = (vocabulary.keys[at] == wanted) & (owner[left] == owner[left + 1])
        return np.where(known, vocabulary.ranks[at], none), vocabulary.joined[at]

    ranks, joined = np.full(len(symbols), none, np.int64), np.zeros(len(symbols), np.int64)
    ranks[:-1], joined[:-1] = found(np.arange(len(symbols) - 1))
    while len(symbols):
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        counts = np.diff(np.r_[begins, len(owner)])
        lowest = np.repeat(np.minimum.reduceat(ranks, begins), counts)
        finished = lowest == none
        if finished.any():
            done.append((owner[finished], symbols[finished]))
        places = np.flatnonzero((ranks == lowest) & ~finished)
        # equal letters in a row: every second place from the left of the run
        first = np.r_[True, np.diff(places) != 1] if len(places) else np.zeros(0, bool)
        run = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))] if len(places) else places
        places = places[(places - run) % 2 == 0]
        symbols[places] = joined[places]
        stays = ~finished
        stays[places + 1] = False
        moved = (np.cumsum(stays) - 1)[places]
        symbols, owner, ranks, joined = symbols[stays], owner[stays], ranks[stays], joined[stays]
        # only pairs beside a merged symbol have changed
        changed = np.zeros(len(symbols) + 1, bool)
        changed[moved] = changed[moved - 1] = True
        beside = np.flatnonzero(changed[:-1])
        ranks[beside] = none
        beside = beside[beside < len(symbols) - 1]
        ranks[beside], joined[beside] = found(beside)
    owners = np.concatenate([o for o, _ in done])
    order = np.argsort(owners, kind="stable")
    ids = np.concatenate([s for _, s in done])[order]
    flat = ids.astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(owners, minlength=len(words)))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def normalized(text: str) -> str:
    """NFC, then lower case letter by letter (a capital sigma at a word's end is a sigma like any other)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def letters_of(kind: str) -> str:
    """Ranges of all letters (``L``) or numbers (``N``), to stand inside brackets of a pattern."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


#: The characters with the White_Space property.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def word_pattern(pattern: str) -> re.Pattern:
    """The vocabulary's pattern, its classes spelt out as ranges."""
    return re.compile(pattern.replace(r"\p{L}", letters_of("L")).replace(r"\p{N}", letters_of("N")).replace(r"\s", SPACES))


class Coder:
    """Encodes and decodes lists of texts with one vocabulary.

    No word of the pattern reaches over white space, so texts are cut there and the ids of a cut are
    remembered. Only unseen cuts are normalized and split into words, only their words are merged.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = word_pattern(vocabulary.pattern)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        self.known: dict[str, bytes] = {}

    def _cuts(self, part: str) -> list[str]:
        # the separators 1C to 1F are blank for Python only
        return [part] if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()

    def _learn(self, cuts: list[str]) -> dict[str, bytes]:
        split = [self.words.findall(normalized(c)) for c in cuts]
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, merge_rounds(self.vocabulary, [w.encode() for w in words]), strict=True)) if words else {}
        return {c: b"".join([ids[w] for w in ws]) for c, ws in zip(cuts, split, strict=True)}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        special, known = self.vocabulary.special, self.known
        parts = [[(p, None) if i % 2 else (None, self._cuts(p)) for i, p in enumerate(self.special.split(text or "") if self.special else [text or ""])] for text in texts]
        if len(known) > MOST_WORDS:
            known.clear()
        found = self._learn(list({c for part in parts for _, cuts in part for c in cuts or () if c not in known}))
        known.update((c, i) for c, i in found.items() if len(c) <= LONG_WORD)
        found = {c: i for c, i in found.items() if len(c) > LONG_WORD}
        lookup = known.__getitem__ if not found else lambda c: found[c] if c in found else known[c]
        out = []
        for part in parts:
            ids = b"".join([np.uint32(special[mark]).astype("<u4").tobytes() if mark else b"".join(map(lookup, cuts)) for mark, cuts in part])
            out.append(np.frombuffer(ids, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Texts of the tokens with a blank between them, as the library shows them for a file without a decoder."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


def _mapped(df: DataFrame, path: str, text: str, keep: list[str], fields, shown: Callable) -> DataFrame:
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def make():
        coder = Coder(vocabulary.value)
        return lambda texts: shown(coder, coder.encode(texts))

    return map_texts(df, text, keep, fields, make)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """Columns ``keep`` (all by default) and the ids of each text as an array."""
    keep = df.columns if keep is None else keep
    return _mapped(df, path, text, keep, [(out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))],
                   lambda coder, ids: [[i.astype(np.int32) for i in ids]])


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` text."""
    keep = df.columns if keep is None else keep
    return _mapped(df, path, text, keep, [
        ("n_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())],
        lambda coder, ids: [[len(i) for i in ids], [i.tobytes() for i in ids], [coder.decode(i) for i in ids]])


def round_trip_digests(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As ``round_trip``, with SHA-256 of ids and decoded text in their place."""
    keep = df.columns if keep is None else keep
    digest = lambda data: hashlib.sha256(data).hexdigest()
    return _mapped(df, path, text, keep, [
        ("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())],
        lambda coder, ids: [[len(i) for i in ids], [digest(i.tobytes()) for i in ids], [digest(coder.decode(i).encode()) for i in ids]])
