"""Toxicity and languages: what the queries give for every document, against plain code by the definitions."""

import math
import os
import re
import zlib

import numpy as np
import pytest

langid = pytest.importorskip("corpusflow.llm.langid")
toxicity = pytest.importorskip("corpusflow.llm.toxicity")
DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def plain_severity(model, text):
    found: dict = {}
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for f in [word, *(word[:n] + "*" for n in (4, 5) if len(word) >= n)]:
            if f in model.features:
                found[f] = found.get(f, 0) + 1
    score = sum(model.weights[model.features[f]] * (1 + math.log(n)) for f, n in found.items())
    above = [1 / (1 + math.exp(min(60, max(-60, t - score)))) for t in model.thresholds]
    each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
    return sum(above), each.index(max(each)), above[0] > 0.5


@needs_tables
def test_severity_of_every_document(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit_model(toxicity.fit_rows(docs, labels))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = toxicity.toxic_severity(docs, labels).collect()
    assert len(got) == len(texts) and model.features and list(model.thresholds) == sorted(model.thresholds)
    for r in got:
        severity, grade, toxic = plain_severity(model, texts[r["doc_id"]])
        assert (r["severity"], r["grade"], r["toxic"]) == (pytest.approx(severity, abs=1e-9), grade, toxic)


def test_long_labelled_texts_are_read_too(spark):
    rows = [(i, "plain words here " * 40 + ("scumlike vile " * (i % 2)) + "and on " * 20) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(1, 0), (999, 1)], "doc_id long, toxic int")
    found = toxicity.fit_rows(docs, labels, rows=10, chars=300)
    assert set(found["toxic"]) == {0, 1} and (found["text"].str.len() <= 300).all() and len(found) <= 20
    twice = toxicity.fit_rows(docs.union(docs).union(docs.selectExpr("doc_id", "'other text'")), labels)
    assert (twice["toxic"].value_counts() <= 30).all()


def plain_language(net, text):
    """Byte by byte: each word, with a space before it and in pieces, is read both ways; every position has its probabilities."""
    sums, n = np.zeros(len(net.langs)), 0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for word in text.encode().split():
        word = b" " + word
        for i in range(0, len(word), langid.WIDTH):
            piece, states = word[i : i + langid.WIDTH], {}
            for d in "fb":
                s, out = np.zeros(langid.UNITS), []
                for byte in piece if d == "f" else piece[::-1]:
                    x, u = net.w["E"][byte].astype(float) @ net.w[f"W{d}"] + net.w[f"b{d}"], net.w[f"U{d}"].astype(float)
                    h = langid.UNITS
                    r, z = sigmoid(x[:h] + s @ u[:, :h]), sigmoid(x[h : 2 * h] + s @ u[:, h : 2 * h])
                    s = (1 - z) * s + z * np.tanh(x[2 * h :] + (r * s) @ u[:, 2 * h :])
                    out.append(s)
                states[d] = out if d == "f" else out[::-1]
            for f, b in zip(states["f"], states["b"], strict=True):
                e = np.exp(np.concatenate([f, b]) @ net.w["O"] + net.w["o"])
                sums, n = sums + e / e.sum(), n + 1
    return sums / n


@needs_tables
def test_language_of_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = langid.fit(docs)
    some = docs.selectExpr("doc_id", "lang", "substring(text, 1, 400) as text")
    rows = {r["doc_id"]: r for r in some.collect()}
    got = langid.predict(some, net).collect()
    assert len(got) == len(rows)
    for r in got:
        p = plain_language(net, rows[r["doc_id"]]["text"])
        assert r["score"] == pytest.approx(p.max(), abs=1e-3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] == net.langs[int(p.argmax())] or np.sort(p)[-2] > p.max() - 1e-3
    held = [r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in got if r["held_out"] and rows[r["doc_id"]]["lang"]]
    assert np.mean(held) > 0.95
