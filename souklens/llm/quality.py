"""Quality rules: repetition counts and the fertility of public vocabularies.

For each text: words, characters in words, symbols, repeated lines and words in repeated windows; and,
from a public vocabulary with byte fallback, the characters per token, the share of byte-fallback
tokens, the entropy of its tokens and the share of symbol tokens in or at words. A verdict compares these
four with the bands of the text's script; a text without letters has none.

Words are tokenized one by one (a vocabulary of this kind never joins words), and remembered, so that
line breaks are not counted as byte fallback. NULL is a text without words and fails the base rules.
Rows are mapped independently, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from souklens.llm.common import Substrings, map_texts, word_places

SYMBOLS = "#*$%&|<>"
IS_SYMBOL = frozenset(SYMBOLS)
#: Fixed value: what the vocabulary writes for the blank before a word.
WORD_MARK = "\u2581"
WINDOW = 5
LEAST_WORDS = 10
#: In hundredths of the words.
MOST_REPEATED = 20
MOST_WORDS = 300_000
LONG_WORD = 200
BLANKS = b" \t\n\x0b\x0c\r"
TO_BLANKS = bytes(32 if b in BLANKS else b for b in range(256))


@dataclass(frozen=True)
class Band:
    """What passes: characters per token, byte-fallback share at most, entropy in bits at least (the
    entropy of short texts is limited by their number of tokens, hence as a share of log2 of that), and
    the share of symbol tokens in or at words at most (prose of any script has next to none)."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    most_symbols: float = 0.10


#: Bands by script, around what prose of it measures (latin 1.23 characters per token for Vietnamese
#: to 4.1 for English, cyrillic 2.2, greek 0.8, han 0.6, arabic 0.8 to 1.0, hebrew 0.8, devanagari 0.7, hangul 0.6, thai 0.9;
#: entropy from 0.45 in texts of 20,000 words; byte share to 0.1 in devanagari, 0.2 in hangul). Digits, encoded data, a few
#: words over and over, a letter typed on and on, wrong encodings, rare characters and words hung with symbols lie outside.
#: Scripts whose letters the vocabulary lacks (in ``other``, such as ethiopic at 0.82) may be all bytes.
BANDS = {
    "latin": Band(1.2, 8.0, 0.10, 0.40),
    "cyrillic": Band(1.2, 7.0, 0.15, 0.40),
    "greek": Band(0.5, 5.0, 0.40, 0.40),
    "han": Band(0.3, 3.0, 0.60, 0.40),
    "arabic": Band(0.5, 5.0, 0.20, 0.40),
    "hebrew": Band(0.5, 5.0, 0.20, 0.40),
    "devanagari": Band(0.4, 4.0, 0.35, 0.40),
    "hangul": Band(0.3, 3.0, 0.60, 0.40),
    "thai": Band(0.4, 4.0, 0.30, 0.40),
    "other": Band(0.3, 6.0, 1.00, 0.35),
}
NO_LETTERS = "none"
#: Ranges of code points that tell a script (first, last).
SCRIPTS = {"latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "greek": ((0x370, 0x3FF),), "cyrillic": ((0x400, 0x52F),),
           "han": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x323AF)), "arabic": ((0x620, 0x6FF), (0x750, 0x77F)), "hebrew": ((0x590, 0x5FF),),
           "devanagari": ((0x900, 0x97F),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "thai": ((0xE00, 0xE7F),)}
#: For each code point the place of its script, from 1; 0 in none. The last entry stands for all beyond.
SCRIPT_AT = np.zeros(max(b for ranges in SCRIPTS.values() for _, b in ranges) + 2, np.uint8)
for _at, _ranges in enumerate(SCRIPTS.values(), 1):
    for _first, _last in _ranges:
        SCRIPT_AT[_first:_last + 1] = _at


def script_of(points: np.ndarray) -> str:
    """The script that most letters belong to, the first named of several with as many; ``other`` if none of the
    known ones has a letter, ``none`` if there are none."""
    counts = np.bincount(SCRIPT_AT[np.minimum(points, len(SCRIPT_AT) - 1)], minlength=len(SCRIPTS) + 1)[1:]
    if counts.any():
        return list(SCRIPTS)[int(counts.argmax())]
    return "other" if any(chr(p).isalpha() for p in np.unique(points).tolist()) else NO_LETTERS


def repeated_words(words: list[bytes], hashes: Substrings) -> int:
    """Words that stand in a window of five words found twice or more."""
    if len(words) <= WINDOW:
        return 0
    data = np.frombuffer(b" ".join(words), np.uint8)
    begins, ends = word_places(data)
    found = hashes.of(hashes.sums(data), begins[:-WINDOW + 1], ends[WINDOW - 1:])
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(found), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:len(found)] += again
    edges[WINDOW:WINDOW + len(found)] -= again
    return int((np.cumsum(edges)[:-1] > 0).sum())


class Fertility:
    """Tokens of words by a vocabulary with byte fallback, remembered up to ``MOST_WORDS`` words."""

    def __init__(self, path: str):
        self.vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = [self.vocabulary.is_byte(i) for i in range(self.vocabulary.vocab_size())]
        pieces = [self.vocabulary.id_to_piece(i).lstrip(WORD_MARK) for i in range(len(self.is_byte))]
        self.is_symbol = [bool(p) and not p.strip(SYMBOLS) for p in pieces]
        self.known: dict[str, tuple[int, ...]] = {}

    def tokens(self, words: list[list[str]]) -> list[Counter]:
        """Counts of the tokens of each list of words."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        new = list({w for ws in words for w in ws if w not in self.known})
        found = dict(zip(new, map(tuple, self.vocabulary.encode(new, num_threads=1)), strict=True)) if new else {}
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= LONG_WORD)
        known = self.known
        return [Counter([i for w in ws for i in (known[w] if w in known else found[w])]) for ws in words]

    def symbol_tokens(self, words: list[str]) -> int:
        """Tokens of symbols alone in or at words; a word of symbols alone (a rule, a table's bar) has none."""
        counts, = self.tokens([[w for w in words if not IS_SYMBOL.isdisjoint(w) and w.strip(SYMBOLS)]])
        return sum(c for i, c in counts.items() if self.is_symbol[i])

    def measures(self, counts: Counter, chars: int) -> tuple[float, float, float]:
        """Characters per token, byte-fallback share, entropy as a share of the largest possible; 0 without tokens."""
        n = sum(counts.values())
        if not n:
            return 0.0, 0.0, 0.0
        spread = -sum(c / n * math.log2(c / n) for c in counts.values())
        fallback = sum(c for i, c in counts.items() if self.is_byte[i])
        return chars / n, fallback / n, max(0.0, spread / math.log2(min(n, len(self.is_byte)))) if n > 1 else 1.0


def verdict(script: str, n: int, chars_per_token: float, byte_share: float, entropy: float, symbol_share: float = 0.0) -> str:
    """Why the bands reject a text of ``n`` words, or an empty string."""
    if not n:
        return "no words"
    if script == NO_LETTERS:
        return "no letters"
    band = BANDS[script]
    if symbol_share > band.most_symbols:
        return "symbol runs"
    if not band.least_chars <= chars_per_token <= band.most_chars:
        return "characters per token"
    if byte_share > band.most_bytes:
        return "byte fallback"
    return "" if entropy >= band.least_entropy else "entropy"


FIELDS = [
    ("n_words", T.LongType(), pa.int64()), ("word_chars", T.LongType(), pa.int64()), ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()), ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()), ("kept", T.BooleanType(), pa.bool_()), ("script", T.StringType(), pa.string()),
    ("chars_per_token", T.DoubleType(), pa.float64()), ("byte_share", T.DoubleType(), pa.float64()),
    ("entropy", T.DoubleType(), pa.float64()), ("symbol_share", T.DoubleType(), pa.float64()), ("rejected_by", T.StringType(), pa.string()),
]


def measure(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with the fields above. ``path`` names the vocabulary file, which every executor
    must be able to open. ``kept`` is false if the base rules or the bands of the script reject a text."""
    keep = df.columns if keep is None else keep

    def make():
        hashes, fertility = Substrings(), Fertility(path)

        def work(texts):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            words = [d.translate(TO_BLANKS).split(b" ") for d in data]
            words = [[w for w in ws if w] for ws in words]
            shown = [b" ".join(ws).decode("utf-8", "surrogatepass").split(" ") if ws else [] for ws in words]
            out = []
            for text, ws, ss, counts in zip(texts, words, shown, fertility.tokens(shown), strict=True):
                text = text or ""
                n, chars, symbols = len(ws), sum(map(len, ss)), sum(text.count(c) for c in SYMBOLS)
                lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                repeated = repeated_words(ws, hashes)
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                script, (per, share, spread) = script_of(points), fertility.measures(counts, chars)
                failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
                hung = fertility.symbol_tokens(ss) / counts.total() if symbols else 0.0
                why = "base rules" if failed else verdict(script, n, per, share, spread, hung)
                out.append((n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, not why, script, per, share, spread, hung, why))
            return list(zip(*out, strict=True)) if out else [[] for _ in FIELDS]
        return work

    return map_texts(df, text, keep, FIELDS, make)
