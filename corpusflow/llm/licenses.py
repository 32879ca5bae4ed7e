"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines in which each but the last ends amid a sentence, so that wrapped texts are whole. Its features
are words and word pairs of the templates' vocabulary; multinomial logistic regression gives `none`, `unknown` (texts of
licences beyond the families) and each licence family a probability, with a temperature fitted on held-out paragraphs. A
paragraph counts as a licence if it is likelier than the calibrated limit; its family stands only if it is likelier than
`unknown` and the paragraph also shares enough word triples with one of the family's templates, else it is `unknown`. Where
unpunctuated prose hides a licence, the paragraph's lines are judged by themselves, neighbours together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, over_arrow, with_columns_of

#: What licences call themselves and the openings of their texts, by family.
TEMPLATES: dict[str, list[str]] = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal public domain dedication.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Paragraphs that speak of the same things and are no licence.
OTHERS = [
    "The driver must show a licence and the papers of the car to any officer.",
    "Copyright law protects works of the mind for the life of the author and seventy years.",
    "All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
    "You may use this file as you like, and you can find a copy of it in the folder of the same name.",
    "The software is distributed in three versions, and a later version may follow in the spring.",
    "He was granted permission to use the library free of charge, with a copy of the conditions.",
    "The public may see the general at work; any person can obtain a free copy of the program.",
    "Modify the source, then compile and publish the binary; either form will do for this purpose.",
    "The MIT and the University published the notes of the conference under the terms they had agreed.",
    "By law the license must be renewed in writing, and the above notice shall be included.",
]
#: What licences of no family above say.
STRANGERS = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. You just do what the fuck you want to.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
    "You may distribute this package under the terms of the Artistic License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This software is proprietary and confidential. The licensee may install one copy of the software and may not modify, rent, sell or sublicense it.",
    "You are granted a limited, non-exclusive, non-transferable license to use this product for personal purposes only.",
    "Licensed under the Business Source License 1.1; the change date is stated below.",
    "This code is released under the Open Software License version 3.0.",
    "Use of this dataset is governed by the Community Data License Agreement, permissive version 2.0.",
    "Released under the Do No Harm License.",
    "Permission to copy this document in whole, for internal use and without fee, is granted by the owner provided that this notice is kept.",
]
#: Bounds of the fit (parameters of fit_lines()): lines, and characters of each, at a place chosen by hash.
FIT_LINES, FIT_CHARS = 3000, 1600
#: A word, a line's end after a sentence, any other line's end.
WORD = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*|[.!?:;][\"')\]*]*[ \t]*\r?\n|\n")
HYPHEN = re.compile(r"(?<=[a-z0-9])-\r?\n[ \t#*/;]*(?=[a-z0-9])")
STOP = re.compile(r"[.!?:;][\"')\]*]*[ \t]*\r?\n|\n[ \t\r]*\n")
BLOCK = 1 << 20
#: Part of its words that a licence has at least once each; what repeats a few words over and over is none.
DISTINCT = 0.2
NONE, UNKNOWN, SOFT, HARD = 0, 1, 1, -1


def words_of(text: str) -> list[str]:
    """Words and line ends; a word that a line's end cuts at its hyphen is one again."""
    text = text.lower()
    return WORD.findall(HYPHEN.sub("-", text) if "-\n" in text or "-\r" in text else text)


def triples(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:], strict=False)) or {tuple(words)}


@dataclass
class Model:
    families: list[str]  # `none` and `unknown` come first
    vocabulary: dict[str, int]  # from 2; 0 is any other word, 1 a line's end
    single: np.ndarray
    pair_at: np.ndarray  # of two words' numbers, the row of `pair`
    pair: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float
    shared: float
    templates: list[tuple[str, set]]

    def probabilities(self, ids: np.ndarray, owner: np.ndarray, paragraphs: int) -> np.ndarray:
        """Of each paragraph each family; owner says whose word it is, ascending."""
        n = np.maximum(1, np.bincount(owner, minlength=paragraphs))
        total = np.zeros((paragraphs, len(self.families)))
        known = np.flatnonzero(ids > 1)
        pairs = self.pair_at[ids[:-1], ids[1:]] * (owner[1:] == owner[:-1])
        met = np.flatnonzero(pairs)
        for j in range(len(self.families)):
            total[:, j] = np.bincount(owner[known], self.single[ids[known], j], paragraphs) + np.bincount(owner[met], self.pair[pairs[met], j], paragraphs)
        logits = (total / np.sqrt(n)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def family(self, p: np.ndarray, words: list[str]) -> str:
        """The confirmed family of a licence paragraph with these probabilities, or `unknown`."""
        best = UNKNOWN + int(p[UNKNOWN:].argmax())
        return self.families[best] if best != UNKNOWN and self.confirm(self.families[best], words) >= self.shared else self.families[UNKNOWN]

    def confirm(self, family: str, words: list[str]) -> float:
        """The largest part of the shorter side's triples that the paragraph shares with a template of the family."""
        own = triples(words)
        return max((len(own & t) / min(len(own), len(t)) for f, t in self.templates if f == family), default=0.0)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return HARD if word[-1] == "\n" else 0


def fit_model(lines: list[str], seed: int = 9, steps: int = 300) -> Model:
    """From variants of the templates, of STRANGERS as `unknown`, and as `none` of OTHERS and the corpus lines given, unless these are much like a template."""
    rng = np.random.default_rng(seed)
    templates = [(f, triples(words_of(t))) for f, ts in TEMPLATES.items() for t in ts]
    vocabulary = {w: i + 2 for i, w in enumerate(sorted({w for ts in TEMPLATES.values() for t in [*ts, *STRANGERS, *OTHERS] for w in words_of(t)}))}
    families = ["none", "unknown", *sorted(TEMPLATES)]
    prose = [w for x in lines if (w := [v for v in words_of(x) if v[-1] != "\n"]) and not any(len(triples(w) & t) > 0.3 * len(t) for _, t in templates)]
    rows: list[tuple[list[str], int]] = [(w, NONE) for w in prose]
    filler = [w for x in prose[:200] for w in x] or ["x"]

    def variant(w: list[str]) -> list[str]:
        w = [x if rng.random() > 0.06 else filler[rng.integers(len(filler))] for x in w if rng.random() > 0.04]
        return [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 5))] + w + [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 5))]

    for f, ts in TEMPLATES.items():
        for t in ts:
            w = words_of(t)
            rows += [(w, families.index(f))] * 4 + [(variant(w), families.index(f)) for _ in range(24)]
    for kind, ts in ((UNKNOWN, STRANGERS), (NONE, OTHERS)):
        for t in ts:
            rows += [(words_of(t), kind)] * 4 + [(variant(words_of(t)), kind) for _ in range(24)]
    every = list(vocabulary)
    rows += [([every[i] for i in rng.integers(0, len(every), rng.integers(3, 25))], NONE) for _ in range(600)]  # the same words without their order
    pairs: dict[tuple[int, int], int] = {}
    for ts in [*TEMPLATES.values(), STRANGERS]:
        for t in ts:
            ids = [vocabulary[w] for w in words_of(t)]
            for p in zip(ids, ids[1:], strict=False):
                pairs.setdefault(p, len(pairs) + 1)
    size, c = len(vocabulary) + 2, len(families)
    pair_at = np.zeros((size, size), np.int32)
    for (a, b), i in pairs.items():
        pair_at[a, b] = i
    x = np.zeros((len(rows), size + len(pairs) + 1), np.float32)
    for i, (w, _) in enumerate(rows):
        ids = np.array([vocabulary.get(v, 0) for v in w])
        np.add.at(x[i], ids, 1)
        if len(ids) > 1:
            np.add.at(x[i], size + pair_at[ids[:-1], ids[1:]], 1)
        x[i] /= np.sqrt(max(1, len(ids)))
    x[:, [0, 1, size]] = 0
    y = np.array([r[1] for r in rows])
    held = rng.random(len(y)) < 0.25
    w, b = np.zeros((x.shape[1], c)), np.zeros(c)
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    fx, target = x[~held].astype(np.float64), np.eye(c)[y[~held]]
    for step in range(1, steps + 1):
        z = fx @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - target) / len(fx)
        for v, g, m1, m2 in ((w, fx.T @ p + 2e-5 * w, m[0], m[1]), (b, p.sum(0), m[2], m[3])):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            v -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    z = x[held] @ w + b

    def told(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    at = np.arange(len(z))
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: -np.log(np.maximum(told(t)[at, y[held]], 1e-12)).sum())
    # The limit lets through one in a thousand of the held-out paragraphs that are no licence, and is a half at least.
    p = told(temperature)
    limit = max(0.5, float(np.quantile(1 - p[y[held] == NONE, NONE], 0.999)))
    model = Model(families, vocabulary, w[:size].copy(), pair_at, w[size:].copy(), b, temperature, limit, 0.0, templates)
    # The part of triples that tells held-out paragraphs of a family best from others that pass for it.
    best = [(UNKNOWN + 1 + int(q[UNKNOWN + 1 :].argmax()), r) for q, r in zip(p, (r for r, h in zip(rows, held, strict=True) if h), strict=True)]
    scores = [(model.confirm(families[f], v), f == kind) for f, (v, kind) in best]
    cuts = np.arange(0.2, 0.81, 0.05)
    wrong = np.array([sum((score >= c) != right for score, right in scores) for c in cuts])
    model.shared = float(np.median(cuts[wrong == wrong.min()]))
    return model


def fit_lines(docs: DataFrame, lines: int = FIT_LINES, chars: int = FIT_CHARS) -> list[str]:
    """At most `lines` different lines of docs with a word, a bounded sample by hash; one line of a text, equal texts once."""
    every = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), "text")
    count = every.count()
    some = every.where(F.pmod("h", F.lit(max(1, count // lines))) == 0)
    at = F.split("text", "\n")
    line = some.select("h", F.element_at(at, (F.pmod(F.shiftright("h", 20), F.size(at)) + 1).cast("int")).alias("line"))
    start = (F.pmod(F.shiftright("h", 8), F.greatest(F.length("line") - chars, F.lit(0)) + 1) + 1).cast("int")
    cut = line.select("h", F.substring(F.col("line"), start, F.lit(chars)).alias("line")).where("line rlike '[A-Za-z0-9]'")
    return [r["line"] for r in cut.groupBy("line").agg(F.min("h").alias("h")).orderBy("h", "line").limit(lines).collect()]


def _stretches(text: str) -> Iterator[list[str]]:
    """Words and line ends of stretches of whole paragraphs; a paragraph far over BLOCK characters comes in stretches of lines, a line whole."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK:
            stop = STOP.search(text, at + BLOCK, at + 4 * BLOCK)
            line = text.find("\n", at + 4 * BLOCK) if stop is None else -1
            end = stop.end() if stop else line + 1 if line >= 0 else end
        yield words_of(text[at:end])
        at = end


def found_in(text: str | None, model: Model, numbers: _Numbers) -> tuple[int, float, list[str]]:
    """The number of paragraphs, the largest probability of being a licence, and the family of each licence found."""
    count, most, found = 0, 0.0, []
    for words in _stretches(text or ""):
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        ends = (ids == SOFT) | (ids == HARD)
        if ends.all():
            continue
        # A line's end is a paragraph's end after a sentence and around an empty line.
        empty = ends & np.concatenate([[True], ends[:-1]])
        stops = empty | (ids == HARD) & ends
        line, part, plain = np.cumsum(ends)[~ends], np.cumsum(stops)[~ends], ids[~ends]
        own: list[str] = []

        def judge(owner: np.ndarray, where: np.ndarray, plain: np.ndarray = plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """First words, ends and probabilities of what `owner` numbers, of the words at `where`."""
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            number = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
            return where[starts], np.concatenate([where[starts[1:] - 1], where[-1:]]) + 1, model.probabilities(plain[where], number, len(starts))

        def take(start: int, end: int, p: np.ndarray, words: list[str] = words, own: list[str] = own) -> None:
            if not own:
                own.extend(w for w in words if w[-1] != "\n")
            if len(set(own[start:end])) > DISTINCT * (end - start):
                found.append(model.family(p, own[start:end]))

        starts, after, p = judge(part, np.arange(len(plain)))
        licence = 1 - p[:, NONE]
        count, most = count + len(starts), max(most, float(licence.max()))
        for n in np.flatnonzero(licence > model.limit).tolist():
            take(starts[n], after[n], p[n])
        # Of the others those of several lines, line by line.
        rest = np.flatnonzero((licence <= model.limit) & (line[starts] != line[after - 1]))
        if len(rest):
            inside = np.isin(part, part[starts[rest]])
            where = np.flatnonzero(inside)
            a, b, p = judge(line[where], where)
            likely = 1 - p[:, NONE] > model.limit
            if likely.any():
                # Neighbours are one paragraph.
                owner = np.zeros(len(plain), np.int64)
                group = np.cumsum(np.concatenate([[True], ~likely[:-1] | (part[a[1:]] != part[a[:-1]])]))
                for x, y, g in zip(a[likely], b[likely], group[likely], strict=True):
                    owner[x:y] = g
                where = np.flatnonzero(owner)
                a, b, p = judge(owner[where], where)
                most = max(most, float((1 - p[:, NONE]).max()))
                for x, y, q in zip(a, b, p, strict=True):
                    take(x, y, q)
    return count, most, found


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraphs, licence_paragraphs, unknown_paragraphs, families, score): a row for each row of docs.

    families are those confirmed, by name and joined by commas; score is the largest probability of being a licence, 0 for a
    text without a paragraph. Null and empty texts have no paragraphs. Repeated rows are judged alike. Ties of families: the
    first by name. Other columns are ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "paragraphs", "licence_paragraphs", "unknown_paragraphs", "families", "score"]

    def run(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(model.vocabulary | {"\n": SOFT})
        for b in batches:
            rows = []
            for x in b.column(1):
                count, most, found = found_in(x.as_py(), model, numbers)
                known = [f for f in found if f != "unknown"]
                rows.append((count, len(known), len(found) - len(known), ",".join(sorted(set(known))), most))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    rows = with_columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), "text")
    return over_arrow(rows, partial(run, model=model), "doc_id long, paragraphs long, licence_paragraphs long, unknown_paragraphs long, families string, score double")


def licenses(docs: DataFrame) -> DataFrame:
    """scan() by a model fitted to the templates and to lines of docs."""
    return scan(docs, fit_model(fit_lines(docs)))
