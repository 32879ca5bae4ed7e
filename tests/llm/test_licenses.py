"""Licence scans: wrapped texts, texts of other licences, and the scan against plain code."""

import random
import textwrap

import numpy as np
import pytest

licenses = pytest.importorskip("corpusflow.llm.licenses")


def prose(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["thing", "there", "onwh", "red", "sat", "mat", "license", "public", "of", "the", "under"], k=20)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return licenses.fit_model(prose(300))


def found(model, text):
    return licenses.found_in(text, model, licenses._Numbers(model.vocabulary | {"\n": licenses.SOFT}))


@pytest.mark.parametrize("family", sorted(licenses.TEMPLATES))
@pytest.mark.parametrize("width", [40, 60, 72])
def test_wrapped_texts_give_their_family_alone(model, family, width):
    before, after = prose(2, 5)
    for t in licenses.TEMPLATES[family]:
        wrapped = textwrap.fill(t, width)
        for text in (wrapped, f"{before}.\n{wrapped}\n\n{after}", wrapped.replace("\n", "\r\n"), "# " + wrapped.replace("\n", "\n# ")):
            assert set(found(model, text)[2]) == {family}, text


def test_others_are_unknown_and_prose_is_none(model):
    told = [found(model, textwrap.fill(t, 60))[2] for t in licenses.STRANGERS]
    assert sum(x in (["unknown"], ["unknown"] * 2) for x in told) >= len(told) - 1
    new = ["This library is made available under the terms of the Frobnicate Public License, version 7.", "You may copy and redistribute this software under the conditions of the Sunrise Licence."]
    assert all(set(found(model, t)[2]) <= {"unknown"} for t in new) and any(found(model, t)[2] for t in new)
    clean = [*prose(400, 9), *licenses.OTHERS]
    assert sum(len(found(model, t)[2]) for t in clean) <= 3
    junk = [" ".join([w] * n) for w in ("Is", "the", "license", "Ber", "software") for n in (40, 2000)]
    assert not any(found(model, t)[2] for t in junk)
    assert 0.5 <= model.limit < 1 and 0.2 <= model.shared <= 0.8


def plain(model, text):
    """By definition: paragraphs cut line by line, probabilities from counted words and pairs."""
    parts, new = [], True
    for line in licenses.HYPHEN.sub("-", (text or "").lower()).split("\n"):
        words = [w for w in licenses.words_of(line) if w[-1] != "\n"]
        if words:
            if new:
                parts.append([])
            parts[-1].append(words)
        new = not words or licenses.STOP.search(line + "\n") is not None

    def p(words):
        ids = [model.vocabulary.get(w, 0) for w in words]
        z = model.bias + sum((model.single[i] for i in ids if i > 1), np.zeros(len(model.families))) / np.sqrt(len(ids))
        z = z + sum((model.pair[k] for a, b in zip(ids, ids[1:], strict=False) if (k := model.pair_at[a, b])), np.zeros(len(model.families))) / np.sqrt(len(ids))
        e = np.exp((z - z.max()) / model.temperature)
        return e / e.sum()

    def name(words):
        return [model.family(p(words), words)] if len(set(words)) > licenses.DISTINCT * len(words) else []

    out = []
    for lines in parts:
        whole = [w for x in lines for w in x]
        if 1 - p(whole)[0] > model.limit:
            out += name(whole)
        elif len(lines) > 1:
            run: list = []
            for x in [*lines, None]:
                if x is not None and 1 - p(x)[0] > model.limit:
                    run += x
                elif run:
                    out += name(run)
                    run = []
    return len(parts), sorted(out)


def test_scan_is_plain_code(model, monkeypatch):
    rng = random.Random(4)
    every = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.STRANGERS + licenses.OTHERS
    for i in range(150):
        pieces = [textwrap.fill(rng.choice(every), rng.choice([40, 60, 1000])) if rng.random() < 0.4 else rng.choice(prose(5, i)) + rng.choice(["", ".", "?", " "]) for _ in range(rng.randint(0, 8))]
        text = rng.choice(["\n", "\n\n", "\n \n"]).join(pieces)
        count, most, names = found(model, text)
        assert (count, sorted(names)) == plain(model, text) and 0 <= most <= 1
    text = "\n".join(f"{a}.\n{textwrap.fill(b, 60)}" for a, b in zip(prose(40, 3), every[:40], strict=False))
    whole = found(model, text)
    monkeypatch.setattr(licenses, "BLOCK", 300)
    assert found(model, text)[::2] == whole[::2]


def test_copies_dont_fill_the_sample(spark):
    rows = [(i, "one text that many rows have") for i in range(3000)] + [(5000 + i, f"own words {chr(97 + i % 26)}{i}\nmore of {i}") for i in range(500)]
    lines = licenses.fit_lines(spark.createDataFrame(rows, "doc_id long, text string"), 400)
    assert len(lines) == len(set(lines)) <= 400 and sum("one text" in x for x in lines) <= 1
    long = spark.createDataFrame([(1, "word " * 5000)], "doc_id long, text string")
    assert [len(x) for x in licenses.fit_lines(long, 10, 100)] == [100]
