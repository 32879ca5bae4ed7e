"""Aggregations over rows: pooling of vectors, moving averages, sizes and statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import num_elements


def mean_vectors(df: DataFrame, key: str, vector: str, where: Column | None = None) -> DataFrame:
    """(key, vector): the mean of each component over the rows of a key, of those where `where` holds if given.

    Sums are partial before the shuffle, one row for each key and component.
    """
    rows = df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x")) if where is None else df.where(where).select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    means = rows.groupBy(key, "at").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(vector))


def first_vectors(df: DataFrame, key: str, vector: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(vector, order).alias(vector))


def last_vectors(df: DataFrame, key: str, vector: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(vector, order).alias(vector))


#: Stretches of the order that a key's rows are dealt to, blocks in a group of blocks.
STRETCHES, GROUP = 64, 512


def moving_average(df: DataFrame, key: str, order: str, value: str, weight: float = 0.1) -> DataFrame:
    """df with `ema`: value * weight + the last ema * (1 - weight); a key's first value starts it. order: numbers, dates or times.

    Each row maps the average before it to the one after it, and such maps are chained in levels: rows in blocks, in which the
    powers of 1 - weight stay in range, blocks in groups, groups in keys. A key's rows lie in stretches of the order, between
    quantiles of all rows, so that one key, however many rows it has, is dealt to many tasks.
    """
    keep = 1.0 - weight
    size = max(1, min(256, int(250 / -math.log10(keep)))) if 0 < keep < 1 else 1
    power = lambda n: F.pow(F.lit(keep), n.cast("double"))
    at = F.col(order) if dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint", "float", "double") else F.unix_micros(F.col(order).cast("timestamp"))
    bounds = df.select(at.alias("at")).agg(F.percentile_approx("at", [i / STRETCHES for i in range(1, STRETCHES)], 1000)).first()[0] or []
    stretch = F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(bounds)))), lambda x: x <= at)) if bounds else F.lit(0)
    rows = df.withColumn("__s", stretch)
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__s").orderBy(order)) - 1)
    rows = rows.withColumn("__b", F.floor(F.col("__n") / size)).withColumn("__i", F.col("__n") % size).withColumn("__g", F.floor(F.col("__b") / GROUP))
    block = [key, "__s", "__g", "__b"]
    own = F.sum(F.col(value).cast("double") * F.lit(weight) * power(-F.col("__i"))).over(Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__own", power(F.col("__i")) * own)
    # A map x -> a * x + b of each block, and what the blocks before it in its group make of the group's x.
    blocks = rows.groupBy(*block).agg(power(F.count("*")).alias("a"), F.max_by("__own", "__n").alias("b"), F.min_by(F.col(value).cast("double"), "__n").alias("first"))
    chained = blocks.groupBy(key, "__s", "__g").agg(F.sort_array(F.collect_list(F.struct("__b", "a", "b", "first"))).alias("maps"))  # at most GROUP
    one = F.array(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")))
    after = lambda acc, x: F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["a"] * x["a"]).alias("a"), (F.element_at(acc, -1)["b"] * x["a"] + x["b"]).alias("b"))))
    chained = chained.withColumn("until", F.aggregate("maps", one, after))
    whole = chained.select(key, "__s", "__g", F.element_at("until", -1).alias("map"), F.col("maps")[0]["first"].alias("first"))
    keys = whole.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__s", "__g", "map", "first"))).alias("groups"))  # one entry for GROUP blocks
    follow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) * x["map"]["a"] + x["map"]["b"]))
    starts = keys.select(key, F.explode(F.arrays_zip("groups", F.aggregate("groups", F.array(F.col("groups")[0]["first"]), follow).alias("x"))).alias("g")).where("g.groups is not null")
    starts = starts.select(key, F.col("g.groups.__s").alias("__s"), F.col("g.groups.__g").alias("__g"), F.col("g.x").alias("x"))
    each = chained.join(starts, [key, "__s", "__g"]).select(key, "__s", "__g", "x", F.explode(F.arrays_zip("maps", "until")).alias("m")).where("m.maps is not null")
    before = each.select(key, "__s", "__g", F.col("m.maps.__b").alias("__b"), (F.col("m.until.a") * F.col("x") + F.col("m.until.b")).alias("__before"))
    return rows.join(before, block).withColumn("ema", F.col("__own") + F.col("__before") * power(F.col("__i") + 1)).select(*df.columns, "ema")


def catalog_summary(files: DataFrame) -> DataFrame:
    """Files and bytes of each config and split, in order."""
    return files.groupBy("config", "split").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy("config", "split")


def parameter_totals(tensors: DataFrame, item_bytes: Column, *keys: str) -> DataFrame:
    """(tensors, parameters, bytes) over rows with a shape, of all or of each key."""
    n = num_elements(F.col("shape"))
    return tensors.groupBy(*keys).agg(F.count("*").alias("tensors"), F.sum(n).alias("parameters"), F.sum(n * item_bytes).alias("bytes"))


def deviation(pairs: DataFrame, got: str, want: str, *keys: str) -> DataFrame:
    """(mean, std, mean_abs_diff, max_rel_diff) of vectors against wanted ones, component by component, of all or of each key."""
    both = pairs.select(*keys, F.explode(F.arrays_zip(F.col(got).cast("array<double>").alias("g"), F.col(want).cast("array<double>").alias("w"))).alias("x")).select(*keys, "x.g", "x.w")
    off = F.abs(F.col("g") - F.col("w"))
    return both.groupBy(*keys).agg(F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.avg(off).alias("mean_abs_diff"), F.max(off / F.greatest(F.abs("w"), F.lit(1e-12))).alias("max_rel_diff"))
