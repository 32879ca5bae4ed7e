"""Line dedup, mixing and SimHash against brute force; edge cases with nulls, repeats, ties, empty and long texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusflow.llm import line_dedup, mixing, simhash
from corpusflow.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, extra=False):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    names = ("fp", "h1", "leaf", "no", "size", "chunk", "target", "component_id", "__salt", "drop")
    return df.select("*", *(F.lit("x").alias(n) for n in names)) if extra else df


# ---- connected components


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, x) for x in range(1001, 1400)] + [(x, x + 1) for x in range(2000, 2080)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def plain_components(fps):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(25)]
    out = base + [base[1]] * 30 + [None, "", " \n ", "ONE", "one", "Ünï ß", "ünï ß"]
    for b in base[:12]:
        words = b.split()
        for _ in range(4):
            w = list(words) or ["x"]
            w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
    return [*out, "a\x0bb\x0cc\rd", "a b c d", " ".join(["x y z"] * 400)]


def test_simhash_is_brute_force(spark):
    texts = near_texts()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts, extra=True)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps and all(len(r["fingerprint"]) == 16 for r in got.values())
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(fps)


def test_ball_links_whatever_is_near(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))) for f in fps for _ in range(3)]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    links = {(r["a"], r["b"]) for r in simhash.link_fingerprints(nodes).collect()}
    assert links and all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in links)
    roots = {r["node"]: r["root"] for r in connected_components(simhash.link_fingerprints(nodes)).collect()}
    want = plain_components(dict(enumerate(fps)))
    assert all(roots.get(i, i) == r for i, r in want.items())
    with pytest.raises(ValueError):
        simhash.link_fingerprints(nodes, 3)


def test_simhash_edges(spark, monkeypatch):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (9, "other words stand here now")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == {(5, 3): 2, (3, 3): 1, (None, 3): 1, (9, 9): 1}
    kept = simhash.one_of_each(df.withColumn("component_id", F.lit("x"))).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 9] and kept[0]["component_id"] == "x"
    two = spark.createDataFrame([(5, "a b c d e"), (5, "other words stand here now"), (3, "a b c d e"), (None, "no other row has this")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(two).collect()) == [(0, 0), (3, 3), (5, 3), (5, 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    long = " ".join(f"word{i}" for i in range(5000))
    whole = simhash.fingerprint(long.encode())
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(long.encode()) == whole == plain_fingerprint(long)


# ---- line dedup


def plain_line_dedup(rows, depth=3, similarity=0.7, least=3, long=10):
    """rows: (doc_id, text). Lines kept, by the definition."""
    import re

    lines = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for no, x in enumerate((t or "").split("\n") if t is not None else []):
            w = tuple("<*>" if re.search("[0-9]", v) else v for v in re.findall(r"[^\x20\x09-\x0d]+", x))
            if w:
                lines.append((i, no, w))
    leaves = defaultdict(list)
    for _, _, w in lines:
        leaves[len(w), w[:depth]].append(w)
    of = {}
    for leaf, ws in leaves.items():
        if len(set(ws)) == 1 or leaf[0] <= depth or len(ws) < least:
            of |= {w: w for w in ws}
            continue
        fixed = []
        for p in range(depth, leaf[0]):
            token, n = max(Counter(w[p] for w in ws).items(), key=lambda x: (x[1], x[0]))
            fixed.append(token if 2 * n > len(ws) else None)
        for w in set(ws):
            agree = depth + sum(a == b for a, b in zip(fixed, w[depth:], strict=True))
            of[w] = leaf if agree >= similarity * leaf[0] else w
    seen = defaultdict(list)
    for i, no, w in lines:
        seen[of[w], len(w)].append((i, no))
    drop = {x for (_, n), spots in seen.items() if len({i for i, _ in spots}) >= (2 if n >= long else least) for x in spots[1:]}
    return {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in drop) for i, t in rows}


def line_texts():
    rng = random.Random(2)
    prose = [" ".join(rng.choices(["red", "blue", "green", "the", "of", "a"], k=rng.randint(1, 9))) for _ in range(60)]
    out = []
    for i in range(60):
        lines = [rng.choice(prose) for _ in range(rng.randint(0, 6))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), f"Posted by user{i} on day {i * 7} in room")
        if i % 3 == 0:
            lines.insert(0, f"Read more about {rng.choice(['cats', 'dogs', 'birds'])} on our page every single day here")
        out.append("\n".join(lines))
    return [*out, None, "", "\n\n", "  red   blue \t green ", "red blue green", "red\x0bblue green", "1 2 3\n4 5 6", "7 8 9", "0x1 b2 3c"]


def test_line_dedup_is_its_definition(spark):
    texts = line_texts()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts, extra=True)).collect()}
    want = plain_line_dedup(list(enumerate(texts)))
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_lines"] == (0 if texts[i] is None else texts[i].count("\n") + 1) for i, r in got.items())
    assert sum(r["n_dropped"] for r in got.values()) > 60


def test_line_dedup_joins_where_leaves_are_many(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW_LEAVES", 0)
    texts = line_texts()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == plain_line_dedup(list(enumerate(texts)))


def test_line_dedup_edges(spark):
    line = "this line recurs in all of them"
    df = spark.createDataFrame([(1, line), (1, line), (2, f"{line}\nown"), (3, f"x\n{line}"), (None, line), (4, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in line_dedup.dedup_lines(df, keep=["doc_id"]).where("text is not null").collect())
    assert got == [(0, line), (1, ""), (1, ""), (2, "own"), (3, "x")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, line), (2, line), (2, "b")], "doc_id long, text string")
    assert [r["n_dropped"] for r in line_dedup.dedup_lines(few).collect()] == [0, 0, 0]
    assert "Python" not in line_dedup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    ten = "these are ten words that stand in only two documents"
    rows = [(1, f"{ten}\na b\n{line}"), (2, f"a b\n{ten}\nc d"), (3, line)]
    assert [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [rows[0][1], "a b\nc d", line]
    long = "\n".join(f"line number x{i % 7} of a long text" for i in range(20000))
    out = line_dedup.dedup_lines(spark.createDataFrame([(i, long) for i in range(3)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_dropped"] for r in out] == [19999, 20000, 20000]


# ---- mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left, ws = total - sum(full.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / ws > most * sizes[s]]
        if not over:
            return full | {s: left * w[s] / ws for s in rest}
        full |= {s: most * sizes[s] for s in over}


def test_mix(spark, monkeypatch):
    rng = random.Random(6)
    sources = [rng.choice(["b", "a", "z", "Zed", None, "é", "hot", "hot", "hot"]) for _ in range(900)]
    texts = [" ".join(["w"] * min(400, int(rng.expovariate(0.03)))) for _ in range(890)] + [None, "", " "] + ["same text"] * 7
    monkeypatch.setattr(mixing, "CHUNK", 64)
    df = docs(spark, texts, sources, extra=True)
    got = {r["doc_id"]: r for r in mixing.mix(df, keep=["doc_id", "source"]).collect()}
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    sums = Counter()
    for i, s in enumerate(sources):
        sums[s] += size[i]
    want = plain_targets(dict(sums))
    assert len(got) == 900 and all(r["size"] == size[i] and r["source_size"] == sums[sources[i]] for i, r in got.items())
    assert all(r["target"] == pytest.approx(want[sources[i]], rel=1e-9) for i, r in got.items())
    assert sum(want.values()) == pytest.approx(1.5 * sum(sums.values()))
    taken = Counter()
    for i, r in got.items():
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[sources[i]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]) for s in want)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(7, "text"), keep=["doc_id"]).collect()}
    assert again == {i: r["copies"] for i, r in got.items()}
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()} == again
    out = mixing.mixed_documents(docs(spark, texts, sources))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({i: n for i, n in again.items() if n})


def test_mix_edges(spark, monkeypatch):
    empty = docs(spark, [None, "", " "])
    assert [(r["target"], r["taken"]) for r in mixing.mix(empty).collect()] == [(0.0, 0)] * 3
    assert mixing.mix(empty.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(None, "a b", "s"), (None, "a b", "s"), (2, "x", "t")], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 7
    assert all(len(some) and max(some) - min(some) <= 1 for some in ([r["copies"] for r in rows if r["size"] == n] for n in (2, 3)))
    equal = spark.createDataFrame([(7, "a b c d", "s")] * 100, "doc_id long, text string, source string").repartition(3)
    rows = mixing.mix(equal).collect()
    assert (len(rows), rows[0]["target"], sum(r["taken"] for r in rows), {r["copies"] for r in rows}) == (100, 600.0, 600, {1, 2})
    assert mixing.mixed_documents(equal).count() == 150
    many = spark.createDataFrame([(7, "a b c d", "s", f"x{i}") for i in range(300)], "doc_id long, text string, source string, other string")
    monkeypatch.setattr(mixing, "CHUNK", 32)
    assert sum(r["copies"] for r in mixing.mix(many, keep=["other"]).collect()) == mixing.mixed_documents(many).count() == 450
    odd = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(1, "a b c", None)] * 3 + [(2, "x " * 9, "s"), (None, None, "s"), (None, None, None)], "doc_id long, text string, source string")
    want = sum(r["copies"] for r in mixing.mix(odd, keep=["doc_id", "source"]).collect())
    assert mixing.mixed_documents(odd).count() == want == sum(r["copies"] for r in mixing.mix(odd).collect())


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    p, docs_, words = rng.random(500), np.ones(500), rng.integers(0, 300, 500).astype(float)
    out = mixing.flight(p, docs_, words, rng)
    assert ((out > 0) & (out < 1)).sum() <= 3 and abs(((out - p) * words).sum()) < 1e-4 and abs((out - p).sum()) < 1e-6
    whole = mixing.land(out, words, docs_)
    assert set(whole.tolist()) <= {0.0, 1.0} and abs(((whole - p) * words).sum()) <= 5
    mean = np.mean([mixing.flight(np.full(40, 0.3), np.ones(40), np.arange(40.0), np.random.default_rng(s)) for s in range(400)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.13


def test_targets_of_many_sources(spark):
    """Against resharing in plain code, with weights, limits and order of code points."""
    rng = random.Random(11)
    sizes = {f"s{i}é" if i % 3 else f"S{i}": int(rng.expovariate(0.001)) for i in range(500)} | {None: 40, "z": 10**6, "": 0}
    rows = spark.createDataFrame([("n" if s is None else f"s{s}", 1, n) for s, n in sizes.items()], "source_key string, units long, source_size long")
    got = {r["source_key"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert all(got["n" if s is None else f"s{s}"] == pytest.approx(t, rel=1e-9, abs=1e-6) for s, t in plain_targets(sizes).items()) and len(got) == len(sizes)
