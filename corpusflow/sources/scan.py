"""Typed parquet scans: a declared record read by name, files in catalog order, starting anywhere."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import list_files

#: Values of missing columns in records that know no null.
ZERO = {T.StringType: "", T.BooleanType: False, T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 0, T.FloatType: 0.0, T.DoubleType: 0.0}


def _zero(kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(_zero(f.dataType).alias(f.name) for f in kind.fields))
    return F.lit(ZERO.get(type(kind))).cast(kind)


def _reconciled(column: Column, found: T.DataType, wanted: T.DataType) -> Column:
    """A column of the file as declared: structs by name at any depth, leaves by cast after reading."""
    if isinstance(wanted, T.StructType) and isinstance(found, T.StructType):
        have = {f.name: f for f in found.fields}
        parts = [(_reconciled(column[f.name], have[f.name].dataType, f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(wanted, T.ArrayType) and isinstance(found, T.ArrayType):
        return F.transform(column, lambda x: _reconciled(x, found.elementType, wanted.elementType))
    return column if found == wanted else column.cast(wanted)


def scan(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, zero_missing: bool = False) -> DataFrame:
    """The declared columns of parquet files, by name; others aren't read. The first file's footer says what there is.

    A declared column that isn't there is null, or its type's zero with zero_missing, as are nulls then.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files are selected")
    if schema is None:
        return spark.read.parquet(*paths)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in spark.read.parquet(paths[0]).schema.fields}
    narrowed = T.StructType([T.StructField(f.name, have[f.name]) for f in wanted.fields if f.name in have])
    df = spark.read.schema(narrowed).parquet(*paths)
    out = [_reconciled(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in wanted.fields]
    return df.select(*((F.coalesce(c, _zero(f.dataType)) if zero_missing else c).alias(f.name) for c, f in zip(out, wanted.fields, strict=True)))


def file_counts(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(file, number of its path, rows) of all files below the paths, in order of paths and then of names; one job, which reads footers."""
    if not paths:
        raise ValueError("no files are selected")
    frame = spark.read.parquet(*paths)
    rows = frame.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()  # one a file
    bare = lambda f: re.sub("^file:/+", "/", f)  # noqa: E731  one file's URI has one slash or three
    counts = {bare(r["f"]): (r["f"], r["n"]) for r in rows}
    out = []
    for i, p in enumerate(paths):
        for f in sorted(spark.read.schema(frame.schema).parquet(p).inputFiles()):
            name, n = counts.get(bare(f), (f, 0))
            out.append((name, i, n))
    return out


def _numbered(spark: SparkSession, files: list[tuple[str, int, int]], first: int, schema: T.StructType | str | None) -> DataFrame:
    starts, total = [], first
    for f, i, n in files:
        starts.append((f, i, total))
        total += n
    base = spark.read.parquet(*(f for f, _, _ in files)).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        have = {f.name: f.dataType for f in base.schema.fields}
        base = base.select(*((_reconciled(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields), "__file", "__row")
    table = spark.createDataFrame(starts, "__file string, file_no int, __start long")
    return base.join(F.broadcast(table), "__file").withColumn("row_no", F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")  # a row for each file


def numbered(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """The columns of scan() with `file_no` (place in paths) and `row_no` (from 0 over all files, in their order); rows aren't shuffled."""
    return _numbered(spark, file_counts(spark, paths), 0, schema)


def scan_from(spark: SparkSession, paths: list[str], at: int, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows from global number `at` on (clamped to what there is), in order. Of files before it only footers are read."""
    files, first = file_counts(spark, paths), 0
    while len(files) > 1 and first + files[0][2] <= at:
        first += files.pop(0)[2]
    return _numbered(spark, files, first, schema).where(F.col("row_no") >= at).orderBy("row_no").drop("row_no", "file_no")


def dataset_scan(spark: SparkSession, files: DataFrame, root: str, config: str = "", split: str = "", schema: T.StructType | str | None = None) -> DataFrame | None:
    """scan() of a catalog's config and split under root. Nothing selected: an empty frame, None without a schema."""
    paths = [f"{root}/{r['config']}/{r['split']}/{r['filename']}" for r in list_files(files, config, split).collect()]  # a catalog is small
    if not paths:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], wanted) if wanted is not None else None
    return scan(spark, paths, schema)


def records(df: DataFrame) -> Iterator[Row]:
    """Rows one by one, a partition at a time; stopping early reads no further partitions."""
    yield from df.toLocalIterator(prefetchPartitions=False)


def passages(records_frame: DataFrame, key: str = "query_id", texts: str = "passages.passage_text") -> DataFrame:
    """(key, at, text) of question-passage records: a row for each passage that isn't empty."""
    return records_frame.select(key, F.posexplode(texts).alias("at", "text")).where(F.col("text") != "")
