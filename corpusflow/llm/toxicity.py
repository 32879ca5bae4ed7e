"""Toxicity as severity grades, by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w x): one weight vector, shared by ordered thresholds. Features are a document's words and
their first four and five letters, as 1 + log of their count. Labels say toxic or not; the fit grades the toxic rows by how
much of the evidence they hold: grades 1, 2, 3 are the thirds of their number of marker words, clean rows are grade 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, over_arrow, with_columns_of

#: Bounds of the fit: labelled rows of each class, characters of one of them, features. All are parameters of fit().
FIT_ROWS, FIT_CHARS, FEATURES = 3000, 10_000, 4096
GRADES = 4
WORD = re.compile(r"[^\W\d_]+")
BLOCK, MEMO = 1 << 20, 200_000


def words_of(text: str | None) -> Iterator[list[str]]:
    """Runs of letters in lower case; long texts in turn, cut at a character that isn't a letter."""
    text, at = text or "", 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield WORD.findall(text[at:end].lower())
        at = end
    yield WORD.findall(text[at:].lower())


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) >= n)]


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, counts: list[Counter]) -> np.ndarray:
        """(documents, grades - 1): P(grade > k) from the counts of known features."""
        score = np.array([sum(self.weights[j] * (1 + np.log(n)) for j, n in sorted(c.items())) for c in counts])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


class Counts:
    """Texts to counts of known features; remembers which of them a word has."""

    def __init__(self, model: Model) -> None:
        known = model.features

        class Memo(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                self[word] = found = tuple(known[f] for f in features_of(word) if f in known)
                return found

        self.new = Memo
        self.memo = Memo()

    def __call__(self, text: str | None) -> Counter:
        out: Counter = Counter()
        for words in words_of(text):
            for some in filter(None, map(self.memo.__getitem__, words)):
                out.update(some)
            if len(self.memo) > MEMO:
                self.memo = self.new()
        return out


def _likeness(text: str) -> int:
    """The least hash of a text's runs of five words: alike for most near copies, hardly ever for others."""
    words = [w for some in words_of(text) for w in some]
    runs = zip(*(words[i:] for i in range(5)), strict=False) if len(words) >= 5 else [words]
    return min(zlib.crc32(" ".join(r).encode()) for r in runs)


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> pd.DataFrame:
    """(text, toxic, weight) of at most `rows` labelled rows of each class, those of least hash; a bounded sample by rule.

    A doc_id with several labels counts as toxic if one says so, and of its texts the one of least hash is read. Of a text over
    `chars` characters the fit reads as many, from a place chosen by hash; scoring reads whole texts.
    """
    marks = with_columns_of(labels, ["doc_id", "toxic"]).where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    of = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(rows) for c in (0, 1)]
    ids = chosen[0].union(chosen[1])  # at most 2 * rows ids, so that they may be broadcast
    h = F.xxhash64("text")
    at = (F.pmod(F.shiftright(h, 8), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1).cast("int")
    read = with_columns_of(docs, ["doc_id", "text"]).where("text is not null").select(F.col("doc_id").cast("long").alias("id"), h.alias("h"), F.substring(F.col("text"), at, F.lit(chars)).alias("text"))
    found = read.join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min_by("text", "h").alias("text")).toPandas().sort_values("id")
    # Of near copies one is enough: their own rare words would pass for signs of their class.
    found = found.assign(like=[_likeness(t) for t in found["text"]])
    found = found.drop_duplicates(["like", "toxic"]).drop(columns="like").reset_index(drop=True)
    have = found["toxic"].value_counts()
    return found.assign(weight=[of[t] / have[t] for t in found["toxic"]])


def fit_model(found: pd.DataFrame, features: int = FEATURES, steps: int = 400, least: float = 3.5) -> Model:
    """Chooses features whose share of toxic and of clean rows differs most (z of the log odds, over `least`), grades the rows, fits by Adam."""
    y = found["toxic"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return Model({}, np.zeros(0), np.full(GRADES - 1, 60.0))
    seen = [Counter(), Counter()]
    for text, t in zip(found["text"], y, strict=True):
        seen[t].update({f for words in words_of(text) for w in set(words) for f in features_of(w)})
    n = [int((y == c).sum()) for c in (0, 1)]

    def z(f: str) -> float:
        a, b = seen[1][f] + 0.5, seen[0][f] + 0.5
        return float((np.log(a / (n[1] + 1 - a)) - np.log(b / (n[0] + 1 - b))) / np.sqrt(1 / a + 1 / b))

    often = (f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= 3 and seen[0][f] < n[0] and seen[1][f] < n[1])
    ranked = sorted(((z(f), f) for f in often), key=lambda x: (-abs(x[0]), x[1]))
    # A sign of a class is surely (z, by one bar for tables of any size) and much (six times) more frequent there.
    times = {f: (seen[1][f] + 0.5) / n[1] / ((seen[0][f] + 0.5) / n[0]) for v, f in ranked if abs(v) > least}
    chosen = [f for _, f in ranked if f in times and not 1 / 6 < times[f] < 6][:features]
    markers = {f for f in chosen if times[f] > 1 and not f.endswith("*")}
    index = {f: j for j, f in enumerate(chosen)}
    count = Counts(Model(index, np.zeros(0), np.zeros(0)))
    bags = [count(text) for text in found["text"]]
    marking = {index[f] for f in markers if f in index}
    held = np.array([sum(k for j, k in b.items() if j in marking) for b in bags], np.float64)
    cuts = np.quantile(held[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (held > cuts[0]) + (held > cuts[1]), 0)
    rows, cols, values = [], [], []
    for i, b in enumerate(bags):
        for j, k in sorted(b.items()):
            rows.append(i), cols.append(j), values.append(1 + np.log(k))
    rows, cols, values = np.array(rows, np.int64), np.array(cols, np.int64), np.array(values)
    weight = found["weight"].to_numpy(np.float64)
    weight = weight / weight.sum()
    # Thresholds as a first one and steps that stay positive, so that their order holds.
    w, t = np.zeros(len(chosen)), np.array([2.0, 0.0, 0.0])
    moments = [np.zeros(len(w) + 3), np.zeros(len(w) + 3)]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        score = np.bincount(rows, values * w[cols], len(y)) if len(rows) else np.zeros(len(y))
        theta = np.cumsum([t[0], *np.exp(t[1:])])
        cum = np.concatenate([np.zeros((len(y), 1)), sig(theta[None, :] - score[:, None]), np.ones((len(y), 1))], axis=1)
        at = np.arange(len(y))
        hi, lo = cum[at, grade + 1], cum[at, grade]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p  # of the log likelihood, by the threshold above and below
        d_score = d_lo - d_hi
        d_theta = np.array([d_hi[grade == k].sum() - d_lo[grade == k + 1].sum() for k in range(GRADES - 1)])
        d_t = np.array([d_theta.sum(), *(np.exp(t[k]) * d_theta[k:].sum() for k in (1, 2))])
        d_w = np.bincount(cols, values * d_score[rows], len(w)) - 1e-4 * w if len(rows) else np.zeros(len(w))
        grad = np.concatenate([d_w, d_t])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w, t = w + move[:-3], t + move[-3:]
    return Model(index, w, np.cumsum([t[0], *np.exp(t[1:])]))


def _grades(model: Model, batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    counts = Counts(model)
    for b in batches:
        yield b, model.above([counts(x.as_py()) for x in b.column(text_at)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, toxic): a row for each row of docs.

    severity is the expected grade, 0 to 3; grade the likeliest (the lower on a tie); toxic whether a grade over 0 is likelier
    than not. Null and empty texts have no features. Repeated rows are judged alike. Other columns are ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
        for b, above in _grades(model, batches, 1):
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1))
            arrays = [b.column(0), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] > 0.5)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "severity", "grade", "toxic"])

    rows = with_columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), "text")
    return over_arrow(rows, partial(run, model=model), "doc_id long, severity double, grade int, toxic boolean")


def toxic_severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() by a model fitted to the labelled rows of docs. Without rows of both classes all are grade 0."""
    return score(docs, fit_model(fit_rows(docs, labels)))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't judged toxic; columns as they were."""
    model = fit_model(fit_rows(docs, labels))
    bounded_batches(docs.sparkSession)
    with_columns_of(docs, ["doc_id", "text"])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
        for b, above in _grades(model, batches, at):
            yield b.filter(pa.array(above[:, 0] <= 0.5))

    return over_arrow(docs, partial(run, model=model), docs.schema)
