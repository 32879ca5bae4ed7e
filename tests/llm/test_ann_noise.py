"""Recall of probed lists on vectors without clusters."""

import numpy as np
import pytest

ann = pytest.importorskip("corpusflow.llm.ann")
from test_python_ops import brute, vectors  # noqa: E402


def test_lists_on_noise(spark):
    x = np.random.default_rng(9).normal(size=(1500, 32)).astype("f4")
    got: dict = {}
    for r in ann.search(vectors(spark, x)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(np.arange(1500), x.astype("f8"))
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[i] & set(w)) / 20 for i, w in want.items()]) >= 0.9


def test_every_row_is_a_candidate(spark):
    """Rows that share a vec_id, equal rows, and queries among them, against a loop over all pairs of rows."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 60, 400).tolist() + [20] * 30 + [7] * 40
    x = rng.integers(-2, 3, (400, 3)).tolist() + [[1, 0, 2]] * 30 + [[2, 2, 2]] * 40
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True) if any(v)]
    want = []
    for a, (i, v) in enumerate(rows):
        if i % 20 == 0:
            found = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(rows) if b != a)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    hits = sum(s == t for (_, _, _, s), (_, _, _, t) in zip(sorted(got), sorted(want), strict=True))
    assert len(got) == len(want) and hits >= 0.9 * len(want)
    few = [(20, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (20, [1.0, 0.0]), (20, [2.0, 0.0])]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect())
    one = [(20, 1, 20, 2.0), (20, 2, 20, 1.0), (20, 3, 1, 0.9), (20, 4, 1, 0.5)]
    assert got == sorted(one * 2 + [(20, 1, 20, 2.0), (20, 2, 20, 2.0), (20, 3, 1, 1.8), (20, 4, 1, 1.0)])
