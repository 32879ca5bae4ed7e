"""Length buckets: rows of ids to padded batches of fixed shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import DEFAULT, ShapeFn, pad_row

#: Rows of a run: batches of a shape are numbered within runs of the order, so that no shape has to be in one task.
RUN = 1 << 20


def shaped(df: DataFrame, ids: Column, shape: ShapeFn = DEFAULT) -> DataFrame:
    """df with batch_size and seq_len of each row's ids (an array, or a column of lengths)."""
    kind = df.select(ids.alias("x")).schema["x"].dataType.typeName()
    length = F.size(ids) if kind == "array" else ids
    return df.withColumn("__shape", shape(length)).select(*df.columns, "__shape.batch_size", "__shape.seq_len")


def placed(df: DataFrame, order: str, run: int | None = None) -> DataFrame:
    """df, with its shapes, with run, batch and row: rows of a shape in order, batch_size to a batch.

    run, if given, cuts the order (integers) into stretches of so many values; batches don't cross them, so that the rows of
    a shape, however many, are dealt to many tasks. None: one stretch, as a single stream would have it.
    """
    part = F.floor(F.col(order) / F.lit(run)).cast("long") if run else F.lit(0).cast("long")
    keyed = df.withColumn("run", part)
    at = F.expr(f"row_number() over (partition by run, batch_size, seq_len order by {order})") - 1
    keyed = keyed.withColumn("__at", at)
    return keyed.withColumn("batch", F.floor(F.col("__at") / F.col("batch_size")).cast("long")).withColumn("row", (F.col("__at") % F.col("batch_size")).cast("int")).drop("__at")


def batches(df: DataFrame, order: str, ids: str, reference: str, pad: int = 0, shape: ShapeFn = DEFAULT, batch_padding: bool = False, run: int | None = None) -> DataFrame:
    """(run, batch_size, seq_len, batch_no, batch, references, non_pad_tokens): `batch` is flat, row after row.

    The last batch of a shape is partial: with batch_padding it keeps its size, its missing rows all pad and their references
    null; without, batch_size is the number of its rows. Ids longer than their shape are cut. Null ids are no ids.
    """
    rows = df.select(F.col(order).alias("ord"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"), F.col(reference).alias("reference"))
    laid = placed(shaped(rows, F.col("ids"), shape), "ord", run)
    row = F.struct("row", pad_row(F.col("ids"), F.col("seq_len"), pad).alias("padded"), "reference", F.least(F.size("ids"), F.col("seq_len")).alias("n"))
    grouped = laid.groupBy("run", "batch_size", "seq_len", "batch").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # at most batch_size rows
    missing = F.col("batch_size") - F.size("rows") if batch_padding else F.lit(0)
    flat = F.concat(F.flatten("rows.padded"), F.array_repeat(F.lit(pad), missing * F.col("seq_len")))
    references = F.concat(F.col("rows.reference"), F.array_repeat(F.lit(None).cast(df.schema[reference].dataType), missing))
    size = F.col("batch_size") if batch_padding else F.size("rows")
    tokens = F.aggregate("rows.n", F.lit(0), lambda s, n: s + n)
    return grouped.select("run", size.cast("int").alias("batch_size"), "seq_len", F.col("batch").alias("batch_no"), flat.alias("batch"), references.alias("references"), tokens.alias("non_pad_tokens"))


def rows_of(batched: DataFrame) -> DataFrame:
    """Batches back to (reference, ids): rows with a reference, with their padding."""
    row = F.posexplode("references").alias("at", "reference")
    return batched.select("seq_len", "batch", row).where(F.col("reference").isNotNull()).select("reference", F.slice("batch", F.col("at") * F.col("seq_len") + 1, F.col("seq_len")).alias("ids"))


def padding(batched: DataFrame) -> DataFrame:
    """(batches, rows, tokens, cells, padding_ratio): how much of the batches is padding, rows being real ones."""
    return batched.agg(
        F.count("*").alias("batches"), F.sum(F.size(F.filter("references", lambda r: r.isNotNull()))).alias("rows"), F.sum("non_pad_tokens").alias("tokens"), F.sum(F.size("batch")).alias("cells"),
    ).withColumn("padding_ratio", 1 - F.col("tokens") / F.col("cells"))


def distinct_shapes(batched: DataFrame) -> DataFrame:
    return batched.select("batch_size", "seq_len").distinct()
