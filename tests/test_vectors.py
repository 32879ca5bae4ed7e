"""Similarities, pooling, embedding, images, averages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import vectors
from corpusflow.operators import aggregates, embed, image, similarity
from corpusflow.operators.tokenizer import Tokenizer

HIDDEN = [[[float(v)] * 3 for v in (1, 2, 3, 4)], [[float(v)] * 3 for v in (5, 6, 7, 8)]]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_measures(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0))
    got = [round(one(spark, vectors.similarity(m, a, b)), 6) for m in ("dot", "DOT_PRODUCT", "euclidean", "manhattan", "cosine", "unknown", None)]
    assert got == [1.0, 1.0, round(-(13**0.5), 6), -5.0, *[round(1 / 50**0.5, 6)] * 3]
    with pytest.raises(Exception, match="components"):
        one(spark, vectors.dot(a, F.array(F.lit(1.0))))
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0)))) == [0.0]


def test_pooling(spark):
    df = spark.createDataFrame([(i, h, n) for i, (h, n) in enumerate(zip(HIDDEN, (4, 3), strict=True))], "i int, h array<array<double>>, n int")
    pool = lambda **k: [r["p"][0] for r in df.orderBy("i").select(vectors.pool(F.col("h"), **k).alias("p")).collect()]
    assert pool(mean=True) == [2.5, 6.5] and pool(length=F.col("n"), mean=True) == [2.5, 6.0] and pool(last=True, mean=True) == [4.0, 8.0] and pool(length=F.col("n"), last=True) == [4.0, 7.0] and pool(cls=True) == [1.0, 5.0]
    with pytest.raises(ValueError):
        vectors.pool(F.col("h"), maximum=True)
    p, h = embed.Pooling(mean=True), np.array(HIDDEN)
    assert p(h)[:, 0].tolist() == [2.5, 6.5] and p(h, np.array([4, 3]))[:, 0].tolist() == [2.5, 6.0]
    assert embed.Pooling.parse('{"pooling_mode_lasttoken": true, "pooling_mode_mean_tokens": true}')(h, np.array([4, 3]))[:, 0].tolist() == [4, 7]
    with pytest.raises(ValueError):
        embed.Pooling(maximum=True)(h)


def test_pairs_and_best(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)], "id int, v array<double>")
    every = similarity.pairs(v, v, "dot", ("id", "v"), ("id", "v"))
    assert every.count() == 144 == similarity.pairs(v, v, "dot", ("id", "v"), ("id", "v"), block=5).distinct().count()
    best = similarity.top_k(every, 2).where("query_id = 2").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in best] == [(2, 5.0), (5, 5.0)]


def encoder(ids):
    return np.stack([ids, np.ones_like(ids)], axis=2).astype(np.float64)


def test_embedding(spark):
    t = Tokenizer({"pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "WordPiece", "unk_token": "u", "vocab": {"u": 9, "a": 1, "b": 3}}})
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "b"), (4, None)], "id long, text string")
    out = {r["reference"]: r["embedding"] for r in embed.embed(df, "id", "text", t, encoder).collect()}
    assert set(out) == {1, 3}
    assert np.allclose(out[1], np.array([2, 1]) / 5**0.5) and np.allclose(out[3], np.array([3, 1]) / 10**0.5)
    m = embed.SentenceModel.parse('[{"type": "x.Transformer"}, {"type": "x.Pooling"}, {"type": "x.Odd"}]', '{"pooling_mode_cls_token": true}', '{"prompts": {"q": "Q "}, "default_prompt_name": "q"}')
    assert m.modules == ["Transformer", "Pooling"] and m.prompt("x") == "Q x" and m.prompt("x", "none") == "x" and m.tasks() == ["q"]


def test_images(spark):
    x = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    y = image.preprocess(x, 2, 3, [0, 0, 0], [1, 1, 1])
    assert y.shape == (1, 3, 2, 3) and np.allclose(y[0, 1], x[:, :, 1] / 255)
    assert np.allclose(image.preprocess(x.astype(np.float32), 2, 3, [1, 1, 1], [2, 2, 2])[0, 0], (x[:, :, 0].astype(float) - 1) / 2)
    assert image.resized(np.ones((1, 4, 4, 2)), 7, 3).shape == (1, 7, 3, 2) and np.allclose(image.resized(np.ones((1, 4, 4, 2)), 7, 3), 1)
    points, labels = image.prompt_points([(1, 2, 1)], [(0, 1, 5, 6)])
    assert points.shape == (1, 1, 4, 2) and labels.tolist() == [[[1, 2, 3, -1]]] and image.prompt_points([], [])[1].tolist() == [[[-1]]]
    assert image.mask_of(np.array([[1.0, -1.0]]), 4, 1).tolist() == [[255, 255, 0, 0]]
    over = image.overlay(np.full((1, 2, 4), 100, np.uint8), np.array([[255, 0]]), (200, 0, 0))
    assert over.tolist() == [[[150, 50, 50, 100], [100, 100, 100, 100]]]
    df = spark.createDataFrame([(7, 2, 2, bytes(12), [[1, 1, 1]], [])], "key long, height int, width int, pixels binary, points array<array<int>>, boxes array<array<int>>")
    net = lambda p, pts, l: (np.stack([np.full((4, 4), -1.0), np.full((4, 4), 1.0)]), np.array([0.2, 0.9]))
    row = image.segment(df, net, size=8).first()
    assert [round(m["iou_score"], 3) for m in row["masks"]] == [0.9, 0.2] and bytes(row["masks"][0]["mask"]) == b"\xff" * 4


def test_moving_average(spark):
    values = np.random.default_rng(1).normal(size=700)
    rows = [(0, i, float(v)) for i, v in enumerate(values)] + [(1, 0, 5.0)]
    got = {(r["k"], r["i"]): r["ema"] for r in aggregates.moving_average(spark.createDataFrame(rows, "k int, i int, v double"), "k", "i", "v").collect()}
    e = None
    for i, v in enumerate(values):
        e = v if e is None else 0.1 * v + 0.9 * e
        assert got[0, i] == pytest.approx(e, abs=1e-9)
    assert got[1, 0] == 5.0


def test_totals(spark):
    t = spark.createDataFrame([([2, 3],), ([],), ([4],)], "shape array<bigint>")
    assert tuple(aggregates.parameter_totals(t, F.lit(4)).first()) == (3, 10, 40)
    d = aggregates.deviation(spark.createDataFrame([([1.0, 2.0], [1.0, 4.0])], "g array<double>, w array<double>"), "g", "w").first()
    assert d["mean"] == 1.5 and d["mean_abs_diff"] == 1.0 and d["max_rel_diff"] == 0.5


@pytest.mark.parametrize("weight", [0.1, 0.99, 0.5, 1.0, 0.001])
def test_moving_average_is_a_loop(spark, monkeypatch, weight):
    """Also where a key's rows lie in many stretches, blocks and groups."""
    import random

    from corpusflow.operators import aggregates

    monkeypatch.setattr(aggregates, "GROUP", 3)
    monkeypatch.setattr(aggregates, "STRETCHES", 5)
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", i, rng.gauss(0, 9)) for i in range(4000)]
    got = {r["n"]: r["ema"] for r in aggregates.moving_average(spark.createDataFrame(rows, "k string, n long, v double").repartition(3), "k", "n", "v", weight).collect()}
    last: dict = {}
    for k, n, v in rows:
        last[k] = weight * v + (1 - weight) * last[k] if k in last else v
        assert got[n] == pytest.approx(last[k], abs=1e-9)
    assert len(got) == len(rows)


def test_png_of_all_filters_and_colours():
    import struct
    import zlib

    from corpusflow.operators import image

    rng = np.random.default_rng(4)
    for channels in (1, 2, 3, 4):
        x = rng.integers(0, 256, (9, 7, channels)).astype(np.uint8)
        assert np.array_equal(image.read_png(image.write_png(x)), x)
        lines, above = b"", np.zeros(7 * channels, np.int64)
        for y in range(9):  # filtered by the format's definition, value by value
            now, kind = x[y].astype(np.int64).ravel(), y % 5
            left = np.concatenate([np.zeros(channels, np.int64), now[:-channels]])
            corner = np.concatenate([np.zeros(channels, np.int64), above[:-channels]])
            near = []
            for a, b, c in zip(left, above, corner, strict=True):
                p = a + b - c
                near.append(min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])
            guess = [np.zeros_like(now), left, above, (left + above) // 2, np.array(near)][kind]
            lines, above = lines + bytes([kind]) + ((now - guess) % 256).astype(np.uint8).tobytes(), now
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        png = image.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, image.COLOURS[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
        assert np.array_equal(image.read_png(png), x)
        for cut in (0, 5, 20, 40, len(png) - 3):
            with pytest.raises(ValueError):
                image.read_png(png[:cut])


def test_segmenting_png_files(spark):
    """From PNG files to PNG masks, best first, around a network that finds bright and dark pixels."""
    from pyspark.sql import functions as F

    from corpusflow.operators import image

    x = np.zeros((4, 4, 3), np.uint8)
    x[1:3, 2:4] = 250
    rows = [(1, image.write_png(x)), (2, image.write_png(x[:, :, 0])), (3, b"broken"), (4, None)]
    got = image.decoded(spark.createDataFrame(rows, "key long, png binary"))
    assert [(r["key"], r["height"], r["width"], r["error"] is None) for r in got.orderBy("key").collect()] == [(1, 4, 4, True), (2, 4, 4, True), (3, None, None, False), (4, None, None, False)]

    def network(pixels, points, labels):
        bright = pixels[0, 0] - 0.5
        return np.stack([-bright, bright]), np.array([0.2, 0.9])

    prompts = got.where("error is null").withColumn("points", F.array(F.array(F.lit(1), F.lit(1), F.lit(1)))).withColumn("boxes", F.expr("cast(array() as array<array<int>>)"))
    masks = image.segment(prompts, network, 4, (0.0,) * 3, (1.0,) * 3)
    files = {(r["key"], r["place"]): r for r in image.saved(masks).collect()}
    best = image.read_png(files[1, 0]["png"])[:, :, 0]
    assert files[1, 0]["iou_score"] == 0.9 and np.array_equal(best > 0, x[:, :, 0] > 0) and np.array_equal(image.read_png(files[2, 1]["png"])[:, :, 0] > 0, x[:, :, 0] == 0)


def test_pairs_are_the_expressions(spark):
    """Tiles have the bits of the column expressions, with nulls, zeros and values that aren't finite, in one block and in many."""
    rng, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    odd = [None, [0.0] * 5, [-0.0] * 5, [1.0, None, 2.0, 3.0, 4.0], [nan, 1.0, 1.0, 1.0, 1.0], [inf, 1.0, -1.0, 0.0, 2.0], [1e-20] * 5, [1e200] * 5]
    v = spark.createDataFrame([(i, x) for i, x in enumerate(odd + rng.normal(size=(40, 5)).tolist())] + [(3, [0.5] * 5), (None, [0.5] * 5)], "id long, v array<double>")
    met = v.select(F.col("id").alias("q"), F.col("v").alias("a")).crossJoin(v.select(F.col("id").alias("d"), F.col("v").alias("b")))
    told = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for measure in ("cosine", "DOT_PRODUCT", "euclidean", "manhattan", "unknown", None):
        score = vectors.similarity(measure, F.col("a"), F.col("b"))
        for digits, block in ((None, 1000), (None, 25), (6, 1000))[: 3 if measure == "cosine" else 1]:
            want = met.select("q", "d", score if digits is None else F.round(score, digits))
            assert told(similarity.pairs(v, v, measure, ("id", "v"), ("id", "v"), block, digits)) == told(want)
    narrow = v.where("id = 0 or id > 7").select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<float>").alias("v"))
    met = narrow.select(F.col("id").alias("q"), F.col("v").alias("a")).crossJoin(narrow.select(F.col("id").alias("d"), F.col("v").alias("b")))
    assert told(similarity.pairs(narrow, narrow, "dot", ("id", "v"), ("id", "v"))) == told(met.select("q", "d", vectors.dot(F.col("a"), F.col("b"))))
    assert similarity.pairs(v.where("id < 0"), v, "dot", ("id", "v"), ("id", "v")).count() == 0 == similarity.pairs(v, v.where("id < 0"), "dot", ("id", "v"), ("id", "v")).count()


def test_pairs_of_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<double>")
    some = lambda ids: v.where(F.col("id").isin(ids))
    every = lambda q, d: [r["score"] for r in similarity.pairs(some(q), some(d), "dot", ("id", "v"), ("id", "v")).collect()]
    assert every([1, 2, 3], [3]) == [None] * 3 == every([3], [1, 2, 3]) and sorted(every([1, 3], [1, 3]), key=repr) == [5.0, None, None, None]
    for q, d in (([1], [2]), ([1, 2], [1]), ([1], [1, 2])):
        with pytest.raises(Exception, match="vectors of 1 and 2 components"):
            every(q, d)


def test_rounding_is_that_of_columns(spark):
    rng = np.random.default_rng(5)
    x = [0.0, -0.0, 5e-7, -5e-7, 4.9999999e-7, 1.0000005, 0.1234565, 2.5, -1e-9, 1e15 + 0.3, 123456789.1234565, 4503599627370497.5, 1e300, -1e305, 5e-324, float("inf"), -float("inf"), float("nan")]
    x += [float(i) / 1e7 for i in range(-3000, 3000)] + (rng.integers(-(10**9), 10**9, 3000) * 5 / 1e7).tolist() + rng.normal(size=3000).tolist()
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", F.round("x", 6).alias("y"), F.round("x", 0).alias("z")).collect()
    a = np.array([r["x"] for r in got])
    for name, digits in (("y", 6), ("z", 0)):
        assert list(map(repr, similarity.rounded(a, digits).tolist())) == [repr(r[name]) for r in got]


def test_pairs_of_a_large_table_in_one_file(spark, tmp_path):
    """A file of one row group is spread over all cores, and a pair is no matter of microseconds."""
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(7).normal(size=(20_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"id": np.arange(20_000), "v": pa.array(list(x))}), tmp_path / "v.parquet")
    v = spark.read.parquet(str(tmp_path / "v.parquet"))
    began = time.time()
    every = similarity.pairs(v.where("id % 50 = 0"), v, "cosine", ("id", "v"), ("id", "v"), digits=6)
    n, total, tasks = every.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("score").alias("s")).agg(F.sum("n"), F.sum("s"), F.count("*")).first()
    took, unit = time.time() - began, x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert n == 8_000_000 and total == pytest.approx((unit[::50] @ unit.T).round(6).sum(), abs=1e-3)
    assert tasks >= spark.sparkContext.defaultParallelism and took < 60
