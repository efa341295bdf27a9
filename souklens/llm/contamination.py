"""Benchmark decontamination by the q-gram lemma.

Benchmark items and documents are compared as lower-case words with single blanks between them, as bytes.
A document is contaminated by an item if it holds, within ``allowed`` edits, any ``SEGMENT`` bytes of it (all of a
shorter item), wherever they begin, or ``WORDS`` whole words of it in a row. As missing letters are edits, an excerpt
of ``SEGMENT - allowed(SEGMENT)`` bytes (74) is found at every offset; shorter ones by their words.

A region within e edits of a segment of m bytes shares at least m + 1 - q(e + 1) q-grams with it, all on diagonals
no further than e apart. Shared q-grams are counted in diagonal bands twice as wide that overlap by half, so each such
region lies whole in one band; in bands that reach the bound, the segments that hold as many of the q-grams are
verified by an alignment inside the band, all of them at once. Words in a row are runs of q-grams on one diagonal.

Items of which no stretch as long as a segment holds enough q-grams of the text are left out before places are paired.
Of places whose surroundings, as wide as any region, are equal, the first in a text or item stands for all. What is left
is paired in boxes (some items or a part of one, by a part of the text) of at most ``PAIRS`` pairs, which overlap by a
region where one item is cut; so memory is bounded however common a phrase is, and nothing is dropped. Time still grows
with the pairs: of n items that share a phrase and a text that has it m times in different surroundings, n times m.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text; the index of a block is broadcast.
Documents are mapped once for each block, without a shuffle; with several blocks the hits of each are written
to the shared folder before the next block is read, so the driver holds one index at a time, and then joined.
Several texts under one item are one item, found once, with its least edits, in one block or several.

NULL or empty texts hold nothing and are not contaminated; items without ``Q`` bytes of words are left
out, as they would match anywhere. Rows are independent; repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from souklens.llm.common import Substrings, fresh, map_texts, quoted, store, word_places

Q = 8
SEGMENT = 80
#: Edits allowed, as a share of the bytes of a segment.
EDIT_SHARE = 0.08
#: Whole words in a row that are contamination by themselves.
WORDS = 13
#: Segments that are aligned at once.
AT_ONCE = 4096
BLOCK_BYTES = 1 << 20
#: A normalized text is searched in pieces of this many bytes, which overlap by more than a region.
PIECE = 1 << 16
#: Places of q-grams of text and items that are paired at once.
PAIRS = 1 << 21

#: Separators become blanks; letters (lower case by then), digits and all bytes from 128 stay.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("edits", T.IntegerType())]))
HITS_ARROW = pa.list_(pa.struct([("item", pa.int64()), ("begin", pa.int64()), ("edits", pa.int32())]))


def normalized(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())


def grams(data: bytes) -> np.ndarray:
    """All q-grams of 8 bytes as integers, in order."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(min(Q, n)):
        part = np.frombuffer(data, "<u8", (len(data) - i) // 8, i)
        out[i::Q] = part
    return out


def allowed(m: int) -> int:
    """Edits allowed in a segment of ``m`` bytes; as many as leave the bound above one q-gram."""
    return max(0, min(int(m * EDIT_SHARE), (m - Q) // Q - 1))


def alignments(segments: np.ndarray, regions: np.ndarray, most: int) -> np.ndarray:
    """Least number of edits between each segment and any part of its region (rows of bytes); ``most + 1`` if more.

    Cells are kept by diagonal; a region is a band, so its diagonals are all that is computed.
    """
    n, m = segments.shape
    out, rows = np.full(n, most + 1, np.int64), np.arange(n)
    width = regions.shape[1] - m + 1 + 2 * most  # diagonals -most .. regions - m + most
    if width <= 0 or not n:
        return out
    padded = np.pad(regions, ((0, 0), (most, most)))
    ramp = np.arange(width, dtype=np.int32)
    cells = np.tile(np.where(ramp < most, most - ramp, 0).astype(np.int32), (n, 1))  # a part may begin anywhere in the region
    for i in range(m):
        step = cells + (padded[rows, i:i + width] != segments[rows, i, None])
        step[:, :-1] = np.minimum(step[:, :-1], cells[:, 1:] + 1)
        cells = np.minimum.accumulate(step - ramp, axis=1) + ramp
        near = cells.min(1) <= most
        if not near.all():
            rows, cells = rows[near], cells[near]
            if not len(rows):
                return out
    out[rows] = cells.min(1)
    return out


def alignment(segment: bytes, region: bytes, most: int) -> int | None:
    """Least number of edits between ``segment`` and any part of ``region``, if at most ``most``."""
    if segment in region:
        return 0
    found = int(alignments(np.frombuffer(segment, np.uint8)[None], np.frombuffer(region, np.uint8)[None], most)[0])
    return found if found <= most else None


def whole_words(item: bytes, data: bytes, offset: int, at: int, n: int, first: bool, last: bool) -> int:
    """Words that stand whole in both texts in ``n`` equal bytes; ``first`` and ``last`` tell whether the edges of ``data`` are those of its text."""
    begins = (offset == 0 or item[offset - 1] == 32) and (first if at == 0 else data[at - 1] == 32)
    ends = (offset + n == len(item) or item[offset + n] == 32) and (last if at + n == len(data) else data[at + n] == 32)
    parts = item[offset:offset + n].split(b" ")
    return sum(1 for p in parts[not begins:len(parts) - (not ends)] if p)


def longest_words(text: bytes) -> int:
    """Bytes of the longest ``WORDS`` words in a row; none if the text has fewer."""
    begins, ends = word_places(np.frombuffer(text, np.uint8))
    return int((ends[WORDS - 1:] - begins[:len(begins) - WORDS + 1]).max()) if len(begins) >= WORDS else 0


def first_places(data: np.ndarray, at: np.ndarray, reach: int, hashes: Substrings) -> np.ndarray:
    """Which of the ascending places ``at`` are the first with their surroundings of ``reach`` bytes; those near an edge all are."""
    out = np.ones(len(at), bool)
    inside = np.flatnonzero((at >= reach) & (at + Q + reach <= len(data)))
    if len(inside):
        found = hashes.of(hashes.sums(data), at[inside] - reach, at[inside] + Q + reach)
        out[inside] = False
        out[inside[np.unique(found, return_index=True)[1]]] = True
    return out


def places_of(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``begins`` and hold ``counts``."""
    return np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


@dataclass
class Index:
    """A block of items and the places of their q-grams, sorted by q-gram. A place is the number of a q-gram in all items, one after the other."""

    items: np.ndarray
    texts: list[bytes]
    #: All texts one after the other, and where each begins.
    body: np.ndarray
    base: np.ndarray
    codes: np.ndarray
    begins: np.ndarray
    places: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    maybe: np.ndarray
    #: Bytes around a q-gram that hold every region or row of words that it is part of.
    reach: int
    #: Bytes of each item and of a segment of it, edits allowed in it, and the q-grams that a region must share with it.
    length: np.ndarray
    size: np.ndarray
    most: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, bytes]]) -> Index:
        found = [(item, text) for item, text in items if len(text) >= Q]
        codes, hashes = [grams(text) for _, text in found], Substrings()
        reach = max([2 * SEGMENT, *[longest_words(text) + 2 * Q for _, text in found]])
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        first = [first_places(np.frombuffer(text, np.uint8), np.arange(len(c)), reach, hashes) for (_, text), c in zip(found, codes, strict=True)]
        places = np.flatnonzero(np.concatenate(first)) if first else np.zeros(0, np.int64)
        flat = flat[places]
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(found)), [len(c) for c in codes]) if codes else np.zeros(0, np.int64)
        offset = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        distinct, begins = np.unique(flat[order], return_index=True)
        bits = max(16, int(max(1, len(distinct))).bit_length() + 4)
        maybe = np.zeros(1 << bits, bool)
        maybe[cls.slot(distinct, bits)] = True
        lengths = np.array([len(t) for _, t in found], np.int64)
        sizes = np.minimum(lengths, SEGMENT)
        most = np.array([allowed(m) for m in sizes.tolist()], np.int64)
        return cls(np.array([i for i, _ in found], np.int64), [t for _, t in found], np.frombuffer(b"".join(t for _, t in found), np.uint8),
                   np.cumsum(lengths) - lengths, distinct, np.r_[begins, len(flat)], places[order], owner, offset,
                   maybe, reach, lengths, sizes, most, sizes + 1 - Q * (most + 1))

    @staticmethod
    def slot(codes: np.ndarray, bits: int) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def known(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``data`` of q-grams that the index has, and their numbers there."""
        found, bits = grams(data), len(self.maybe).bit_length() - 1
        at = np.flatnonzero(self.maybe[self.slot(found, bits)])
        known = np.searchsorted(self.codes, found[at])
        right = (known < len(self.codes)) & (self.codes[np.minimum(known, len(self.codes) - 1)] == found[at])
        return at[right], known[right]

    def promising(self, places: np.ndarray) -> np.ndarray:
        """Items of which some stretch holds as many of ``places`` as a segment, or words in a row, must share."""
        places = np.sort(places)
        owner = self.owner[places]
        need = np.minimum(self.least[owner], 2 * WORDS - Q)
        last = np.arange(len(places)) + need - 1
        inside = last < len(places)
        last = np.minimum(last, len(places) - 1)
        inside &= (owner[last] == owner) & (places[last] - places <= np.maximum(self.size[owner] - Q, need - 1))
        out = np.zeros(len(self.texts), bool)
        out[owner[inside]] = True
        return out

    def search(self, data: bytes, first: bool = True, last: bool = True) -> dict[int, tuple[int, int]]:
        """Verified items of a piece of text: begin of the region and edits, the first best of each."""
        out: dict[int, tuple[int, int]] = {}
        if len(data) < Q or not len(self.codes):
            return out
        at, known = self.known(data)
        if not len(at):
            return out
        codes, of_text = np.unique(known, return_inverse=True)
        counts = self.begins[codes + 1] - self.begins[codes]
        places, of_item = self.places[places_of(self.begins[codes], counts)], np.repeat(np.arange(len(codes)), counts)
        some = self.promising(places)[self.owner[places]]
        places, of_item = places[some], of_item[some]
        if np.bincount(of_item, minlength=len(codes))[of_text].sum() > PAIRS:
            some = first_places(np.frombuffer(data, np.uint8), at, self.reach, Substrings())
            at, of_text = at[some], of_text[some]
        self._box(out, data, at, of_text, places, of_item, len(codes), first, last)
        return out

    def _box(self, out: dict[int, tuple[int, int]], data: bytes, at: np.ndarray, of_text: np.ndarray, places: np.ndarray, of_item: np.ndarray, n: int, first: bool, last: bool) -> None:
        """Pair places of the text with places of items that have the same of ``n`` q-grams (``of_text``, ``of_item`` in order), in parts if there are many."""
        counts = np.bincount(of_item, minlength=n)
        begins, pairs = np.cumsum(counts) - counts, counts[of_text]
        if not len(at) or not len(places) or not pairs.any():
            return
        if pairs.sum() <= PAIRS:
            chosen = places[places_of(begins[of_text], pairs)]
            self._paired(out, data, np.repeat(at, pairs), self.owner[chosen], self.offset[chosen], first, last)
            return
        owner = self.owner[places]
        low, high = int(owner.min()), int(owner.max())
        if low < high:  # items apart, half of the pairs in each part
            weight = np.cumsum(np.bincount(owner - low, weights=np.bincount(of_text, minlength=n)[of_item]))
            cut = low + min(int(np.searchsorted(weight, weight[-1] / 2)), high - low - 1)
            parts = [(slice(None), owner <= cut), (slice(None), owner > cut)]
        elif out.get(int(self.items[low]), (0, 1))[1] == 0:
            return
        else:  # one item: its longer side in halves that overlap by a region
            spans = [int(x.max() - x.min()) for x in (at, places)]
            if max(spans) <= 4 * self.reach:
                chosen = places[places_of(begins[of_text], pairs)]
                self._paired(out, data, np.repeat(at, pairs), self.owner[chosen], self.offset[chosen], first, last)
                return
            side = at if spans[0] >= spans[1] else places
            middle = int(side.min() + side.max()) // 2
            halves = side <= middle + self.reach, side >= middle - self.reach
            parts = [(half, slice(None)) if side is at else (slice(None), half) for half in halves]
        for text, item in parts:
            self._box(out, data, at[text], of_text[text], places[item], of_item[item], n, first, last)

    def _paired(self, out: dict[int, tuple[int, int]], data: bytes, at: np.ndarray, owner: np.ndarray, offset: np.ndarray, first: bool, last: bool) -> None:
        """Put into ``out`` what is found by the shared q-grams at ``at`` in the text and ``offset`` in item ``owner``."""
        self._words(out, data, at, owner, offset, first, last)
        shift = int(self.length.max())
        band = (at - offset + shift) // (self.most[owner] + 1)
        # a diagonal lies in the upper half of one band and in the lower half of the next
        keys = np.concatenate([(owner << 32) + band, (owner << 32) + band + 1])
        known, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        enough = np.flatnonzero((counts >= self.least[known >> 32])[inverse])
        if not len(enough):
            return
        keys, offsets = keys[enough], np.concatenate([offset, offset])[enough]
        order = np.lexsort((offsets, keys))
        keys, offsets = keys[order], offsets[order]
        # the offsets of as many q-grams as a segment needs, and the segments that hold them
        item = keys >> 32
        final = np.arange(len(keys)) + self.least[item] - 1
        inside = final < len(keys)
        final = np.minimum(final, len(keys) - 1)
        inside &= (keys[final] == keys) & (offsets[final] - offsets <= self.size[item] - Q)
        low = np.maximum(offsets[final] + Q - self.size[item], 0)
        high = np.minimum(offsets, self.length[item] - self.size[item])
        inside &= low <= high
        keys, low, high = keys[inside], low[inside], high[inside]
        if len(keys):
            self._align(out, data, keys >> 32, (keys & 0xFFFFFFFF) - 1, shift, low, high)

    def _align(self, out: dict[int, tuple[int, int]], data: bytes, owner: np.ndarray, band: np.ndarray, shift: int, low: np.ndarray, high: np.ndarray) -> None:
        """Put into ``out`` the best of the segments that begin in ``low`` to ``high`` (ascending for each item and band) of an item, in a band of diagonals."""
        new = np.r_[True, (owner[1:] != owner[:-1]) | (band[1:] != band[:-1]) | (low[1:] > high[:-1] + 1)]
        owner, band, low, high = owner[new], band[new], low[new], high[np.r_[new[1:], True]]
        ends = np.cumsum(high - low + 1)
        body, exact = np.frombuffer(data, np.uint8), np.zeros(len(self.texts), bool)
        found = lambda k: out.get(int(self.items[k]), (0, 1 << 30))
        exact[[k for k in np.unique(owner).tolist() if not found(k)[1]]] = True
        for i in range(0, int(ends[-1]), AT_ONCE):
            number = np.arange(i, min(i + AT_ONCE, int(ends[-1])))
            stretch = np.searchsorted(ends, number, "right")
            left = ~exact[owner[stretch]]
            number, stretch = number[left], stretch[left]
            of, starts = owner[stretch], high[stretch] + 1 + number - ends[stretch]
            for size in np.unique(self.size[of]).tolist():
                rows = np.flatnonzero(self.size[of] == size)
                k, e = of[rows], allowed(size)
                begins = starts[rows] + band[stretch[rows]] * (e + 1) - shift - e  # the band's diagonals: band * (e + 1) - shift, and 2(e + 1) - 1 more
                at = begins[:, None] + np.arange(2 * (e + 1) + size + 2 * e)
                regions = np.where((at >= 0) & (at < len(body)), body[np.clip(at, 0, len(body) - 1)], np.uint8(0))
                edits = alignments(self.body[(self.base[k] + starts[rows])[:, None] + np.arange(size)], regions, e)
                near = np.flatnonzero(edits <= e)
                near = near[np.lexsort((near, edits[near], k[near]))]
                for j in near[np.r_[True, k[near][1:] != k[near][:-1]]].tolist() if len(near) else []:
                    if edits[j] < found(k[j])[1]:
                        out[int(self.items[k[j]])] = (max(0, int(begins[j])), int(edits[j]))
                        exact[k[j]] = not edits[j]

    def _words(self, out: dict[int, tuple[int, int]], data: bytes, at: np.ndarray, owner: np.ndarray, offset: np.ndarray, first: bool, last: bool) -> None:
        """Put into ``out`` the items of which ``WORDS`` whole words stand in a row."""
        order = np.lexsort((at, at - offset, owner))
        at, owner, offset = at[order], owner[order], offset[order]
        heads = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | (offset[1:] != offset[:-1] + 1)])
        sizes = np.diff(np.r_[heads, len(at)]) + Q - 1
        long = sizes >= 2 * WORDS - 1
        for head, n in zip(heads[long].tolist(), sizes[long].tolist(), strict=True):
            k, begin = int(owner[head]), int(at[head])
            item = int(self.items[k])
            if (item not in out or out[item][1]) and whole_words(self.texts[k], data, int(offset[head]), begin, n, first, last) >= WORDS:
                out[item] = (begin, 0)

    def hits(self, text: str | None) -> list[dict]:
        """Items found in a whole text, with the first byte of the searched region and the edits."""
        data, out = normalized(text), {}
        overlap = 2 * self.reach
        step = max(PIECE - overlap, overlap)
        for begin in range(0, max(1, len(data)), step):
            end = begin + step + overlap
            for item, (at, edits) in self.search(data[begin:end], begin == 0, end >= len(data)).items():
                if item not in out or edits < out[item][1]:
                    out[item] = (begin + at, edits)
        return [{"item": i, "begin": b, "edits": e} for i, (b, e) in sorted(out.items())]


def blocks(benchmark: DataFrame, item: str, text: str):
    """Items of the benchmark in blocks of bounded size, each read on its own."""
    rows = benchmark.where(quoted(item).isNotNull() & quoted(text).isNotNull()).select(quoted(item).cast("long").alias("item"), quoted(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else rows
        yield n, [(r["item"], normalized(r["text"])) for r in part.distinct().orderBy("item", "text").collect()]


def mark(
    df: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item: str = "item_id", item_text: str = "text", hits: str = "hits",
) -> DataFrame:
    """Columns ``keep`` of every row with ``hits``: the items found, sorted, each with the byte of the normalized
    text from which its region was searched, and the edits. An empty array for a clean text. With a benchmark of
    several blocks, jobs run while the frame is built, which write the hits to the shared folder."""
    keep = df.columns if keep is None else keep
    kinds = [(hits, HITS, HITS_ARROW)]

    def scanned(rows: DataFrame, kept: list[str], shared: Broadcast) -> DataFrame:
        return map_texts(rows, text, kept, kinds, lambda: lambda texts: [[shared.value.hits(t) for t in texts]])

    every, (key, other) = [], fresh([*keep, hits, text], "text_key", "text_key_found")
    one = df.select(quoted(text), F.sha2(F.coalesce(quoted(text), F.lit("")), 256).alias(other))
    for n, items in blocks(benchmark, item, item_text):
        shared = df.sparkSession.sparkContext.broadcast(Index.of(items))
        if n == 1:
            return scanned(df, keep, shared)
        # several blocks: hits of all, by text, joined back
        every.append(store(scanned(one, [other], shared).where(F.size(hits) > 0), "benchmark-hits"))
        shared.destroy()
    union = every[0]
    for more in every[1:]:
        union = union.unionByName(more)
    # an item with texts in several blocks is one hit, that with the least edits
    found = union.select(other, F.explode(hits).alias("hit")).groupBy(other, "hit.item").agg(F.min(F.struct("hit.edits", "hit.begin")).alias("best"))
    union = found.groupBy(other).agg(F.sort_array(F.collect_list(F.struct("item", "best.begin", "best.edits"))).cast(HITS).alias(hits))
    rows = df.select(*[quoted(c) for c in keep], F.sha2(F.coalesce(quoted(text), F.lit("")), 256).alias(key))
    joined = rows.join(union, F.col(key) == F.col(other), "left")
    return joined.select(*[quoted(c) for c in keep], F.coalesce(F.col(hits), F.array().cast(HITS)).alias(hits))
