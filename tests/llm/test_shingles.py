"""The pipeline's near-dedup against brute force over shingle sets."""

import random

import pytest

shingles = pytest.importorskip("corpusflow.llm.shingles")
simhash = pytest.importorskip("corpusflow.llm.simhash")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_kept(rows):
    def parts(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    ids = sorted({i for i, _ in rows})
    sets, root = {i: parts(t) for i, t in rows}, {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def near_rows():
    """Texts with more or fewer words edited, at both sides of the bar, chains and exact copies."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    out = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e"]
    for _ in range(12):
        words = rng.choices(vocab, k=rng.randint(40, 300))
        for edits in (0, 0, 1, 2, 3, 5, 8, 12):
            words = [f"edit{rng.random()}" if i in rng.sample(range(len(words)), edits) else w for i, w in enumerate(words)] if edits else words
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("tile", "few"), [(512, 100_000), (3, 0)])
def test_stage_is_brute_force(spark, monkeypatch, tile, few):
    monkeypatch.setattr(shingles, "TILE", tile)
    monkeypatch.setattr(shingles, "FEW_TEXTS", few)
    rows = near_rows()
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = plain_kept(rows)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want) and len(want) < len(rows) - 40


@pytest.mark.parametrize("stage", ["shingles", "simhash"])
def test_rows_that_share_ids(spark, stage):
    """A row is lost only to a row of its group, whatever ids the rows have; of equal rows one stays."""
    keep = shingles.one_of_similar if stage == "shingles" else simhash.one_of_each
    text, other = " ".join(map(str, range(30))), " ".join(map(str, range(50, 90)))
    rows = [(5, text, "x"), (5, other, "x"), (3, text, "x"), (3, text, "x"), (None, text, "x"), (9, other, "x"), (None, "own words of a row", None), (None, "own words of a row", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __th string")
    kept = sorted((r["doc_id"] or 0, r["text"][:3]) for r in keep(df).collect())
    assert kept == [(0, "own"), (3, "0 1"), (5, "50 ")] and keep(df).columns == df.columns
    swapped = spark.createDataFrame([(1, text), (1, other), (0, text)], "doc_id long, text string")
    assert sorted(tuple(r) for r in keep(swapped).collect()) == [(0, text), (1, other)]
    assert [tuple(r) for r in keep(spark.createDataFrame([(7, text)] * 50, "doc_id long, text string").repartition(3)).collect()] == [(7, text)]
    assert keep(df.limit(0)).count() == 0
