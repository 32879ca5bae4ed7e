"""What the operators share: reading tables, lineage cuts, names, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.parallel import spread

#: A word is a run of anything but these bytes (ASCII white space); the same class in Java, RE2 and Python.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
#: Bounds of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, times: int = 1) -> None:
    """Few rows and few bytes in a batch, as a text may be long; `times` as many where work in step pays.

    Plans read these settings when they run, which is after the operator returns, so that they stay as the last operator set them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(times * BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(times * BATCH_BYTES))


def over_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, over all cores; at a partition's end the worker, which may then idle beside other stages, gives back what Arrow holds."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return spread(rows).mapInArrow(whole, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(made := tempfile.mkdtemp(prefix="corpusflow-"))
    return made


def remove(spark: SparkSession, path: str) -> None:
    """A folder that is needed no more, in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder: lost executors cost no earlier stage."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def with_columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns; a missing one is an error that names it."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*(F.col(f"`{n}`") for n in names))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salted_join(large: DataFrame, small: DataFrame, key: str | list[str], spread: Column, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join on key, where a key may hold a large part of `large`: its rows are dealt to `salts` tasks by `spread`; `small` has each key once."""
    left = large.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    return left.join(right, [*([key] if isinstance(key, str) else key), "__salt"], how).drop("__salt")


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (node, root): each node that has a link, with the least node it reaches.

    Alternating large and small stars: only minima are gathered at a node, so that a node with any number of neighbours
    costs no task more than its share. Each round is cut; no link leaves the executors.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    links = cut(links.select(*pair(F.col("a"), F.col("b"))).where("a < b").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
    seen = mark(links)
    while seen[0]:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, "u", F.col("v")).select(*pair(F.col("v"), F.col("m"))).where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = salted_join(large, least, "b", F.col("a"))
        stars = small.select(*pair(F.col("a"), F.col("m"))).union(small.select(*pair(F.col("b"), F.col("m")))).where("a < b").distinct()
        links, before = cut(stars), seen
        if (seen := mark(links)) == before:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def others_hash(docs: DataFrame, names: list[str]) -> Column:
    """A hash of the columns but `names`, which tells rows apart that are equal in those; columns without a hash are left out."""
    told = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in names and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(F.lit(0), *told)


def row_keys(docs: DataFrame) -> list[Column]:
    """doc_id, th and rk: what tells rows apart are their id, a hash of their text and one of their other columns."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), others_hash(docs, ["doc_id", "text"]).alias("rk")]


def heads_only(docs: DataFrame, rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """docs with one row of each group, in its columns: that of least doc_id (null last), then by the hashes; of equal rows one.

    rows has row_keys() and `key` for each row of docs, labels has (key, root), each key once; rows of one root are a group.
    """
    me = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th", "rk")
    each = cut(rows.groupBy(key, "doc_id", "th", "rk").agg(F.count("*").alias("n")))
    rooted = labels.join(each.groupBy(key).agg(F.min(me).alias("head")), key)
    keep = rooted.groupBy("root").agg(F.min("head").alias("keep"))
    kept = salted_join(rooted.select(key, "root"), keep, "root", F.col(key)).select(key, "keep")
    told = cut(salted_join(each, kept, key, F.col("th")).select(F.col("doc_id").alias("__gd"), F.col("th").alias("__gt"), F.col("rk").alias("__gr"), "n", (me == F.col("keep")).alias("stays")).where("n > 1 or not stays"))
    names = [f"__c{i}" for i, _ in enumerate(docs.columns)]
    keys = [k.alias(n) for k, n in zip(row_keys(docs), ("__d", "__t", "__r"), strict=True)]
    mine = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), *keys)
    same = F.col("__d").eqNullSafe(F.col("__gd")) & (F.col("__t") == F.col("__gt")) & (F.col("__r") == F.col("__gr"))
    back = lambda df: df.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
    out = back(mine.join(told, same, "left_anti"))
    again = told.where("stays")
    return out if again.isEmpty() else out.unionByName(back(mine.join(again, same, "left_semi").dropDuplicates(["__d", "__t", "__r"])))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
