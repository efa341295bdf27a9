"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read every window of ``WINDOW`` bytes, one forward and one backward. Together
they label every byte with a probability for each language; a document's probabilities are the mean over
all its bytes. The network is trained in numpy by backpropagation through time, on windows of a bounded
sample of labelled documents (``Sample``), and broadcast: some ten thousand numbers, whatever the input.
Prediction maps whole texts window by window; a text's length only adds windows.

A NULL text, or one without a letter, is ``und`` with score 0. Rows are independent of each other, and
repeated rows give repeated results. Without any labelled document every text is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from souklens.llm.common import map_texts, quoted

WINDOW = 128
UNDETERMINED = "und"
MAYBE_LETTER = re.compile(r"[^\W\d_]")


#: A letter, as SQL finds it; pieces of a long text; rows of a language that pass the bound on the hash at least.
LETTER = r"\p{L}"
PIECES = 4
LEAST_PASSED = 64


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learned from: documents of all languages, characters of each, and the course of training."""

    documents: int = 3000
    chars: int = 4000
    units: int = 8
    steps: int = 260
    batch: int = 384
    window: int = 48
    rate: float = 0.02
    seed: int = 7


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def squash(x: np.ndarray) -> np.ndarray:
    """The logistic function, by the hyperbolic tangent, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


class Network:
    """Parameters of the two directions (``f``, ``b``) and of the output; time comes first in all arrays."""

    def __init__(self, languages: list[str], units: int, seed: int):
        random, self.languages, self.units = np.random.default_rng(seed), languages, units
        draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"out": draw(2 * units, len(languages), scale=0.3), "bias": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"{d}_in": draw(256, 2 * units, scale=0.3), f"{d}_new": draw(256, units, scale=0.5), f"{d}_gate": draw(units, 2 * units, scale=0.3),
                       f"{d}_state": draw(units, units, scale=0.4), f"{d}_shift": np.zeros(units, np.float32)}
            self.p[f"{d}_in"][:, :units] += 1.0  # remembers at first

    def step(self, d: str, data: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One byte of every window: next state, and what the way back needs."""
        p, n = self.p, self.units
        gates = h @ p[f"{d}_gate"]
        gates += p[f"{d}_in"].take(data, axis=0)
        squash(gates)
        keep, reset = gates[:, :n], gates[:, n:]
        inner = h @ p[f"{d}_state"]
        inner += p[f"{d}_shift"]
        new = reset * inner
        new += p[f"{d}_new"].take(data, axis=0)
        np.tanh(new, out=new)
        out = h - new
        out *= keep
        out += new
        return out, keep, reset, inner, new

    def states(self, d: str, data: np.ndarray) -> np.ndarray:
        """States after each byte in one direction, without what training needs."""
        length, size = data.shape
        out, h = np.empty((length, size, self.units), np.float32), np.zeros((size, self.units), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            h = out[t] = self.step(d, data[t], h)[0]
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Of every language at every byte; ``data`` is (time, windows)."""
        n, forward, backward = self.units, self.states("f", data), self.states("b", data)
        scores = forward.reshape(-1, n) @ self.p["out"][:n]
        scores += backward.reshape(-1, n) @ self.p["out"][n:]
        scores += self.p["bias"]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores.reshape(*data.shape, -1)

    def label(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        data, owner, used = windows([text])
        best = self.probabilities(data).argmax(2)
        return [self.languages[i] for i in best.T[used.T].tolist()]

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows ``data`` whose bytes all have language ``target``."""
        (length, size), n, p = data.shape, self.units, self.p
        kept: dict[str, list] = {}
        for d in "fb":
            h, kept[d] = np.zeros((size, n), np.float32), [None] * length
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                after = self.step(d, data[t], h)
                kept[d][t], h = (h, *after), after[0]
        states = np.concatenate([np.stack([kept[d][t][1] for t in range(length)]) for d in "fb"], axis=2)
        scores = states @ p["out"] + p["bias"]
        scores = np.exp(scores - scores.max(2, keepdims=True))
        scores /= scores.sum(2, keepdims=True)
        right = scores[:, np.arange(size), target]
        loss = float(-np.log(right + 1e-9).mean())
        scores[:, np.arange(size), target] -= 1
        scores /= length * size
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"] = np.einsum("tbn,tbk->nk", states, scores, optimize=True), scores.sum((0, 1))
        back = scores @ p["out"].T
        for i, d in enumerate("fb"):
            carried = np.zeros((size, n), np.float32)
            gates_at, new_at = np.empty((length, size, 2 * n), np.float32), np.empty((length, size, n), np.float32)
            for t in range(length - 1, -1, -1) if d == "f" else range(length):
                h, _, keep, reset, inner, new = kept[d][t]
                dh = carried + back[t][:, i * n:(i + 1) * n]
                dnew = dh * (1 - keep) * (1 - new * new)
                dgates = np.concatenate([dh * (h - new) * keep * (1 - keep), dnew * inner * reset * (1 - reset)], axis=1)
                dinner = dnew * reset
                g[f"{d}_gate"] += h.T @ dgates
                g[f"{d}_state"] += h.T @ dinner
                g[f"{d}_shift"] += dinner.sum(0)
                gates_at[t], new_at[t] = dgates, dnew
                carried = dh * keep + dgates @ p[f"{d}_gate"].T + dinner @ p[f"{d}_state"].T
            order = np.argsort(data, axis=None, kind="stable")
            seen = data.reshape(-1)[order]
            begins = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])
            g[f"{d}_in"][seen[begins]] = np.add.reduceat(gates_at.reshape(-1, 2 * n)[order], begins)
            g[f"{d}_new"][seen[begins]] = np.add.reduceat(new_at.reshape(-1, n)[order], begins)
        return loss, g

    def train(self, texts: list[str], languages: list[str], sample: Sample) -> list[float]:
        """Adam over random windows, as many of each language; returns the losses."""
        random = np.random.default_rng(sample.seed)
        data = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
        of = [[i for i, x in enumerate(languages) if x == name] for name in self.languages]
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, sample.steps + 1):
            target = random.integers(0, len(of), sample.batch)
            batch = np.zeros((sample.window, sample.batch), np.uint8)
            for j, k in enumerate(target.tolist()):
                text = data[of[k][random.integers(len(of[k]))]]
                begin = random.integers(max(1, len(text) - sample.window + 1))
                part = text[begin:begin + sample.window]
                batch[:len(part), j] = part
            loss, g = self.gradients(batch, target)
            losses.append(loss)
            rate = sample.rate * (1 - 0.9 * step / sample.steps)
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                self.p[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
        return losses


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all windows (time, windows), the text of each window, and which bytes are no filling."""
    data = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    counts = np.array([-(-len(d) // WINDOW) for d in data], np.int64)
    flat, used = np.zeros(int(counts.sum()) * WINDOW, np.uint8), np.zeros(int(counts.sum()) * WINDOW, bool)
    for d, begin in zip(data, ((np.cumsum(counts) - counts) * WINDOW).tolist(), strict=True):
        flat[begin:begin + len(d)] = d
        used[begin:begin + len(d)] = True
    return np.ascontiguousarray(flat.reshape(-1, WINDOW).T), np.repeat(np.arange(len(texts)), counts), used.reshape(-1, WINDOW).T


def pooled(network: Network, texts: list[str | None], at_once: int = 2048) -> np.ndarray:
    """Mean probabilities of each text over all its bytes; zeros for an empty text."""
    data, owner, used = windows(texts)
    total, sizes = np.zeros((len(texts), len(network.languages))), np.bincount(owner, used.sum(0), len(texts))
    for i in range(0, data.shape[1], at_once):
        found = network.probabilities(np.ascontiguousarray(data[:, i:i + at_once]))
        found *= used[:, i:i + at_once, None]
        np.add.at(total, owner[i:i + at_once], found.sum(0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def train(df: DataFrame, text: str = "text", lang: str = "lang", pick: Column | None = None, sample: Sample = Sample()) -> Network | None:
    """A network for the labelled rows of ``df`` whose text has a letter; None if there are none.

    Every language gets an equal share of ``sample.documents`` rows, one at least: those with the least ``pick`` (a 64-bit
    hash, of the text by default), or all that it has. A bound on the hash, from the number of usable rows of the
    language, lets about twice as many through, so that tasks send few. Of a text longer than ``sample.chars``, as many
    characters are taken in ``PIECES`` pieces from places all over it, told by the hash.
    """
    body = quoted(text)
    usable = df.where(quoted(lang).isNotNull() & body.rlike(LETTER)).select(
        quoted(lang).cast("string").alias("lang"), body.cast("string").alias("text"), (F.xxhash64(body) if pick is None else pick).alias("pick"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    each = max(1, sample.documents // len(counts))
    bounds = {name: int(max(2 * each, LEAST_PASSED) / n * 2**64) - 2**63 for name, n in counts.items() if n > max(2 * each, LEAST_PASSED)}
    if bounds:
        bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
        usable = usable.where(bound.isNull() | (F.col("pick") < bound))
    piece = sample.chars // PIECES
    begin = lambda i: (F.pmod(F.xxhash64("pick", F.lit(i)), F.length("text") - piece) + 1).cast("int")
    pieces = F.concat_ws("\n", *[F.substring("text", begin(i), F.lit(piece)) for i in range(PIECES)])
    cut = usable.withColumn("text", F.when(F.length("text") <= sample.chars, F.col("text")).otherwise(pieces))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "text"))
    rows = cut.withColumn("nth", nth).where(F.col("nth") <= each).orderBy("lang", "nth").collect()
    network = Network(sorted({r["lang"] for r in rows}), sample.units, sample.seed)
    network.train([r["text"] for r in rows], [r["lang"] for r in rows], sample)
    return network


def predict(df: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` with the most probable language of each whole text and its probability."""
    keep = df.columns if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(network)

    def make():
        found = shared.value

        def work(texts):
            if found is None:
                return [[UNDETERMINED] * len(texts), [0.0] * len(texts)]
            shares = pooled(found, texts)
            known = [t is not None and has_letter(t) for t in texts]
            best = shares.argmax(1)
            return [[found.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known, strict=True)],
                    [min(1.0, s) if k else 0.0 for s, k in zip(shares[np.arange(len(texts)), best].tolist(), known, strict=True)]]
        return work

    return map_texts(df, text, keep, [(lang, T.StringType(), pa.string()), (score, T.DoubleType(), pa.float64())], make)
