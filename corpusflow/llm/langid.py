"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a window of bytes both ways and labels every position; a document's probabilities are the mean over all
positions of all its windows. A window is a word with the space before it (longer words in pieces), and the state starts
anew in each, so that equal windows have equal labels and a worker labels each different one once. It is trained by
backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, over_arrow, with_columns_of

#: Bounds of the fit: rows in all, characters of each (at a place chosen by hash), languages (the most frequent ones).
FIT_ROWS, FIT_CHARS = 3000, 240
WIDTH, UNITS, EMBED = 24, 16, 12
BLOCK, MEMO = 1 << 20, 300_000
LETTER = regex.compile(r"\p{L}")
PAD = 256


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def windows_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, each with a space before it, in pieces of at most WIDTH bytes."""
    words = [b" " + w for w in text.split()]
    if max(map(len, words), default=0) <= WIDTH:
        return words
    return [w[i : i + WIDTH] for w in words for i in range(0, len(w), WIDTH)]


def to_array(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths), padded after the end."""
    lengths = np.fromiter(map(len, windows), np.int64, len(windows))
    wide = int(lengths.max(initial=1))
    out = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in windows), np.uint8).reshape(-1, wide).astype(np.int64)
    out[np.arange(wide)[None, :] >= lengths[:, None]] = PAD
    return out, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """One gated recurrent unit each way; r and z gate the state, c is the candidate. Weights are float32."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @staticmethod
    def new(langs: list[str], seed: int = 4) -> Network:
        rng, h, e, c = np.random.default_rng(seed), UNITS, EMBED, len(langs)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"E": draw(PAD + 1, e) * np.float32(np.sqrt(PAD + 1) * 0.5), "O": draw(2 * h, c), "o": np.zeros(c, np.float32)}
        for d in "fb":
            w |= {f"W{d}": draw(e, 3 * h), f"U{d}": draw(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        return Network(langs, w)

    def read(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, rows, units) of one direction; padding leaves the state as it is, so that the backward one starts at the end."""
        h, n, wide = UNITS, *x.shape
        inputs = self.w["E"] @ self.w[f"W{d}"] + self.w[f"b{d}"]
        ur, uc = np.ascontiguousarray(self.w[f"U{d}"][:, : 2 * h]), np.ascontiguousarray(self.w[f"U{d}"][:, 2 * h :])
        state, out = np.zeros((n, h), np.float32), np.empty((wide, n, h), np.float32)
        for t in range(wide) if d == "f" else reversed(range(wide)):
            a = inputs[x[:, t]]
            gates = _sigmoid(a[:, : 2 * h] + state @ ur)
            r, z = gates[:, :h], gates[:, h:]
            candidate = np.tanh(a[:, 2 * h :] + (r * state) @ uc)
            on = (x[:, t] != PAD).astype(np.float32)[:, None]
            step = on * z
            new = state + step * (candidate - state)
            if keep is not None:
                keep.append((t, state, r, z, candidate, on))
            out[t] = state = new
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """(time, rows, langs): probabilities at every position."""
        both = np.concatenate([self.read(x, "f"), self.read(x, "b")], axis=2)
        logits = both @ self.w["O"] + self.w["o"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        return p / p.sum(2, keepdims=True)

    def pooled(self, windows: list[bytes], rows: int = 4096) -> np.ndarray:
        """Of each window the sum of its positions' probabilities; windows of like length go together."""
        out = np.zeros((len(windows), len(self.langs)), np.float32)
        order = np.argsort(np.fromiter(map(len, windows), np.int64, len(windows)), kind="stable")
        for i in range(0, len(order), rows):
            some = order[i : i + rows]
            x, _ = to_array([windows[j] for j in some])
            p = self.label(x)
            p[(x == PAD).T] = 0
            out[some] = p.sum(0)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its gradients, by backpropagation through time."""
        h, keep = UNITS, {"f": [], "b": []}
        both = np.concatenate([self.read(x, d, keep[d]) for d in "fb"], axis=2)
        logits = both @ self.w["O"] + self.w["o"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        on = (x != PAD).T
        total = max(1, int(on.sum()))
        truth = p[:, np.arange(len(y)), y]
        loss = -float(np.log(np.maximum(truth[on], 1e-12)).sum()) / total
        p[:, np.arange(len(y)), y] -= 1
        p = p * (on[:, :, None] / np.float32(total)).astype(np.float32)
        g = {"O": np.einsum("tnh,tnc->hc", both, p, optimize=True), "o": p.sum((0, 1)), "E": np.zeros_like(self.w["E"])}
        down = p @ self.w["O"].T
        for d, part in (("f", down[:, :, :h]), ("b", down[:, :, h:])):
            W, U = self.w[f"W{d}"], self.w[f"U{d}"]
            dW, dU, db = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * h, np.float32)
            back = np.zeros((len(y), h), np.float32)
            for t, state, r, z, candidate, live in reversed(keep[d]):
                dh = back + part[t]
                step = live * z
                dc = dh * step * (1 - candidate**2)
                dz = dh * live * (candidate - state) * z * (1 - z)
                dq = dc @ U[:, 2 * h :].T
                dr = dq * state * r * (1 - r)
                gates = np.concatenate([dr, dz], axis=1)
                back = dh * (1 - step) + dq * r + gates @ U[:, : 2 * h].T
                full = np.concatenate([gates, dc], axis=1)
                dU[:, : 2 * h] += state.T @ gates
                dU[:, 2 * h :] += (r * state).T @ dc
                e = self.w["E"][x[:, t]]
                dW += e.T @ full
                db += full.sum(0)
                np.add.at(g["E"], x[:, t], full @ W.T)
            g |= {f"W{d}": dW, f"U{d}": dU, f"b{d}": db}
        return loss, g


def train(texts: list[str], langs: list[str], epochs: int = 4, rows: int = 512, rate: float = 0.01, seed: int = 4) -> Network:
    """Adam over the windows of labelled texts; each language weighs alike by drawing as many windows of each."""
    names = sorted(set(langs))
    net = Network.new(names, seed)
    if not names:
        return net
    of = {name: [] for name in names}
    for text, lang in zip(texts, langs, strict=True):
        of[lang] += windows_of(text.encode())
    rng = np.random.default_rng(seed)
    each = min(8000, max(map(len, of.values())))
    windows, y = [], []
    for j, name in enumerate(names):
        if of[name]:
            windows += [of[name][i] for i in rng.integers(0, len(of[name]), each)]
            y += [j] * each
    if not windows:
        return net
    x, lengths = to_array(windows)
    y = np.array(y)
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), rows):
            some = order[i : i + rows]
            _, g = net.gradients(x[some, : lengths[some].max()], y[some])
            steps += 1
            for k, v in net.w.items():
                a, b = m[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                v -= (rate * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Network:
    """From a bounded sample of the rows that aren't held out and have text and lang: those of least hash, as many of each language, one at least."""
    known = with_columns_of(docs, ["doc_id", "text", "lang"]).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = known.select(F.col("lang").cast("string"), F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = hashed.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return train([], [])
    each = -(-rows // len(counts))
    # Rows of a language whose hash is in the lowest part of its range, where more than `each` are sure to be; of these the lowest.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * each + 40) / r["n"])) for r in counts], "lang string, share double")
    low = (F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)) < F.col("share")
    at = (F.pmod(F.col("h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1).cast("int")
    near = hashed.join(F.broadcast(shares), "lang").where(low).select("lang", "h", F.substring(F.col("text"), at, F.lit(chars)).alias("text"))
    sample = near.withColumn("at", F.expr("row_number() over (partition by lang order by h)")).where(F.col("at") <= each).collect()
    texts, langs = [], []
    for r in sorted(sample, key=lambda r: (r["h"], r["lang"], r["text"])):
        texts.append(r["text"])
        langs.append(r["lang"])
    return train(texts, langs)


class Memory:
    """Texts to languages. Numbers the different windows of a batch, labels the new ones together, sums rows of their table."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.table, self.sizes = np.empty((0, len(self.net.langs)), np.float32), np.empty(0, np.int64)

    def learn(self, windows: list[bytes]) -> np.ndarray:
        if new := list(dict.fromkeys(w for w in windows if w not in self.at)):
            if len(self.at) + len(new) > MEMO * 64 // max(64, len(self.net.langs)) and self.at:
                self.forget()
                new = list(dict.fromkeys(windows))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.net.pooled(new)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int64, len(new))])
        return np.fromiter(map(self.at.__getitem__, windows), np.int64, len(windows))

    def blocks(self, text: bytes) -> Iterator[bytes]:
        """Of about BLOCK bytes, cut at spaces."""
        start = 0
        while len(text) - start > BLOCK:
            end = text.find(b" ", start + BLOCK)
            end = len(text) if end < 0 else end
            yield text[start:end]
            start = end
        yield text[start:]

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sums, sizes = np.zeros((len(texts), len(self.net.langs))), np.zeros(len(texts), np.int64)
        owners, windows, held = [], [], 0

        def flush() -> None:
            nonlocal owners, windows, held
            if windows:
                idx, owner = self.learn(windows), np.repeat([o for o, _ in owners], [n for _, n in owners])
                for j in range(sums.shape[1]):
                    sums[:, j] += np.bincount(owner, self.table[idx, j], len(texts))
                np.add.at(sizes, owner, self.sizes[idx])
            owners, windows, held = [], [], 0

        for i, text in enumerate(texts):
            if self.net.langs and text and LETTER.search(text):
                for block in self.blocks(text.encode()):
                    some = windows_of(block)
                    owners.append((i, len(some)))
                    windows += some
                    held += len(block)
                    if held > BLOCK:
                        flush()
        flush()
        out = []
        for s, n in zip(sums, sizes.tolist(), strict=True):
            j = int(s.argmax()) if n else 0
            out.append((self.net.langs[j], min(1.0, float(s[j]) / n)) if n else ("und", 0.0))
        return out


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a row for each row of docs.

    lang_pred is the language of greatest mean probability (the first by name on a tie) and score that probability. A text
    that is null or has no letter, and any text if no language could be learned, is `und` with score 0. Whole texts of any
    length are read. Other columns are ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = with_columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
        memory = Memory(net)
        for b in batches:
            found = memory.batch(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return over_arrow(rows, partial(run, net=net), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """predict() by a network fitted to docs."""
    return predict(docs, fit(docs))
