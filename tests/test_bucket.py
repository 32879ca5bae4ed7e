"""Shapes and batches against fixed values; the stream against the batch job."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import shapes
from corpusflow.operators import bucket


def table(spark, shape, lengths):
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    return {r["n"]: (r["batch_size"], r["seq_len"]) for r in bucket.shaped(df, F.col("n"), shape).collect()}


@pytest.mark.parametrize(("shape", "want"), [
    (shapes.by_power(32, 8, 2), {1: (32, 8), 7: (32, 8), 8: (32, 8), 9: (32, 16), 15: (32, 16), 16: (32, 16), 17: (32, 32), 32: (32, 32), 33: (32, 64)}),
    (shapes.by_power(32, 10, 10), {1: (32, 10), 10: (32, 10), 11: (32, 100), 100: (32, 100), 101: (32, 1000)}),
    (shapes.by_power_budget(256, 8, 2), {1: (32, 8), 8: (32, 8), 9: (16, 16), 16: (16, 16), 17: (8, 32), 256: (1, 256), 257: (1, 512)}),
    (shapes.by_power_budget(300, 10, 10), {1: (30, 10), 10: (30, 10), 11: (3, 100), 100: (3, 100), 101: (1, 1000)}),
    (shapes.by_two_bit(32, 4), {1: (32, 4), 3: (32, 4), 4: (32, 4), 5: (32, 6), 7: (32, 8), 9: (32, 12)}),
    (shapes.by_two_bit(1, 1), {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 6), 6: (1, 6), 7: (1, 8), 8: (1, 8), 9: (1, 12), 12: (1, 12), 13: (1, 16), 17: (1, 24), 32: (1, 32), 33: (1, 48)}),
    (shapes.by_two_bit_budget(128, 4), {1: (32, 4), 5: (21, 6), 7: (16, 8), 9: (10, 12), 128: (1, 128), 129: (1, 192)}),
])
def test_shapes(spark, shape, want):
    assert table(spark, shape, list(want)) == want


def sentences(spark, texts):
    rows = [(i, list(range(1, len(t) + 1)), f"ref{i + 1}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ord int, ids array<int>, ref string")


def test_padded_batches(spark):
    out = bucket.batches(sentences(spark, ["123", "12345", "12345678901"]), "ord", "ids", "ref", 99, shapes.by_power(2, 8, 2)).orderBy("seq_len").collect()
    assert [(r["batch_size"], r["seq_len"], r["references"], r["non_pad_tokens"]) for r in out] == [(2, 8, ["ref1", "ref2"], 8), (1, 16, ["ref3"], 11)]
    assert out[0]["batch"] == [1, 2, 3, 99, 99, 99, 99, 99, 1, 2, 3, 4, 5, 99, 99, 99] and out[1]["batch"] == [*range(1, 12), *[99] * 5]
    full = bucket.batches(sentences(spark, ["123"]), "ord", "ids", "ref", 99, shapes.by_power(2, 8, 2), batch_padding=True).first()
    assert full["batch"] == [1, 2, 3, *[99] * 13] and full["references"] == ["ref1", None] and full["batch_size"] == 2
    assert [(r["reference"], r["ids"][:3]) for r in bucket.rows_of(spark.createDataFrame([full])).collect()] == [("ref1", [1, 2, 3])]


def test_short_shapes_null_ids_and_runs(spark):
    cut = bucket.batches(sentences(spark, ["12345"]), "ord", "ids", "ref", 0, lambda n: shapes.shape(F.lit(1), F.lit(3))).first()
    assert cut["batch"] == [1, 2, 3] and cut["non_pad_tokens"] == 3
    df = spark.createDataFrame([(0, None, "a"), (1, [], "b")], "ord int, ids array<int>, ref string")
    assert bucket.batches(df, "ord", "ids", "ref", 7).first()["batch"] == [7] * 16
    df = spark.range(10).select(F.col("id").alias("ord"), F.array(F.lit(1)).alias("ids"), F.col("id").alias("ref"))
    out = bucket.batches(df, "ord", "ids", "ref", 0, shapes.by_power(3, 8, 2), run=5)
    assert sorted((r["run"], r["batch_no"], r["references"]) for r in out.collect()) == [(0, 0, [0, 1, 2]), (0, 1, [3, 4]), (1, 0, [5, 6, 7]), (1, 1, [8, 9])]
    assert bucket.batches(df.limit(0), "ord", "ids", "ref").count() == 0


def test_stream(spark, tmp_path):
    from corpusflow.streaming.bucketizer import OUTPUT, bucketize

    src = spark.range(23).select(F.col("id").cast("string").alias("ref"), F.sequence(F.lit(1), (F.col("id") % 12 + 1).cast("int")).alias("ids"))
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = bucketize(stream, F.col("ids"), F.col("ref"), shapes.by_power(4, 8, 2), pad=0)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(OUTPUT).parquet(f"{tmp_path}/out").collect()
    assert sorted((r["batch_size"], r["seq_len"]) for r in rows) == [(4, 8)] * 4 + [(4, 16)]
    met = [x for r in rows for x in r["references"]]
    assert len(met) == len(set(met)) == 20 and all(len(r["batch"]) == r["batch_size"] * r["seq_len"] for r in rows)
    for r in rows:
        for i, ref in enumerate(r["references"]):
            n = int(ref) % 12 + 1
            assert r["batch"][i * r["seq_len"] : (i + 1) * r["seq_len"]] == [*range(1, n + 1), *[0] * (r["seq_len"] - n)]


def test_stream_delay(spark, tmp_path):
    """A lone row leaves after its delay, with the batch padded."""
    import time

    from corpusflow.streaming.bucketizer import OUTPUT, bucketize

    src = spark.createDataFrame([("a", [1, 2, 3])], "ref string, ids array<int>")
    src.write.parquet(f"{tmp_path}/in")
    out = bucketize(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), F.col("ids"), F.col("ref"), shapes.by_power(2, 8, 2), 99, True, max_delay_ms=100)
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
    rows, until = [], time.time() + 60
    while not rows and time.time() < until:
        time.sleep(0.5)
        rows = spark.read.schema(OUTPUT).parquet(f"{tmp_path}/out").collect()
    run.stop()
    assert [(r["batch"], r["references"], r["non_pad_tokens"]) for r in rows] == [([1, 2, 3, *[99] * 13], ["a", None], 3)]


def test_stream_query_has_every_document_once(spark):
    import os

    if not os.path.isdir(data := "/root/testdata/sf0.001"):
        pytest.skip("no driver tables")
    from corpusflow.plans.queries import _streamed

    rows = _streamed(spark, data, False, 32).collect()
    docs = {str(r["doc_id"]): (r["text"] or "").split() for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(x for r in rows for x in r["references"]) == sorted(docs)
    for r in rows:
        assert r["batch_size"] == len(r["references"]) <= 4 and len(r["batch"]) == r["batch_size"] * r["seq_len"] and r["error"] is None
        for i, ref in enumerate(r["references"]):
            cells = r["batch"][i * r["seq_len"] : (i + 1) * r["seq_len"]]
            assert cells == [*map(len, docs[ref]), *[0] * (r["seq_len"] - len(docs[ref]))]


def test_stream_rest(spark, tmp_path):
    """Nothing pending, and a whole batch beside a padded rest."""
    from corpusflow.streaming.bucketizer import OUTPUT, bucketize, remaining

    for n in (4, 6):
        src = spark.range(n).select(F.col("id").cast("string").alias("ref"), F.array(F.lit(7)).alias("ids"))
        src.write.parquet(f"{tmp_path}/in{n}")
        out = bucketize(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in{n}"), F.col("ids"), F.col("ref"), shapes.by_power(4, 2, 2), 9, True)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out{n}").option("checkpointLocation", f"{tmp_path}/state{n}").trigger(availableNow=True).start().awaitTermination()
        rest = remaining(spark, f"{tmp_path}/state{n}", 9, True).collect()
        done = spark.read.schema(OUTPUT).parquet(f"{tmp_path}/out{n}").collect()
        assert [len([x for x in r["references"] if x]) for r in done] == [4] and [len([x for x in r["references"] if x]) for r in rest] == [2] * (n > 4)
        assert all(r["batch"] == [7, 9, 7, 9, 9, 9, 9, 9] and r["batch_size"] == 4 for r in rest)


def test_stream_that_is_cancelled(spark, tmp_path):
    """A stream ends by itself, or when it is told to; files come at the pace that was asked for."""
    import threading

    from corpusflow.streaming.bucketizer import drain, paced

    src = spark.range(8).select(F.col("id").cast("string").alias("ref"))
    src.repartition(4).write.parquet(f"{tmp_path}/in")
    sink = lambda n: paced(spark, f"{tmp_path}/in", src.schema, 1).writeStream.format("parquet").option("path", f"{tmp_path}/out{n}").option("checkpointLocation", f"{tmp_path}/state{n}")
    run = sink(0).trigger(availableNow=True).start()
    assert drain(run) and spark.read.parquet(f"{tmp_path}/out0").count() == 8 and len(run.recentProgress) >= 4
    run, stop = sink(1).trigger(processingTime="200 milliseconds").start(), threading.Event()
    threading.Timer(1.0, stop.set).start()
    assert drain(run, stop) is False and not run.isActive
