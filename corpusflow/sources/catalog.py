"""Dataset catalogs: configs, splits and parquet files as rows."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "dataset string, config string, split string, url string, filename string, size long"


def parse_feature(spec: Any) -> dict:
    """A feature as {type, dtype, names, feature}: `feature` maps names to sub-features, "" to a sole one. What isn't an object is no sub-feature."""
    sub = spec.get("feature")
    if isinstance(sub, dict):
        sub = {"": parse_feature(sub)} if "_type" in sub else {k: parse_feature(v) for k, v in sub.items() if isinstance(v, dict)}
    else:
        sub = {}
    return {"type": spec.get("_type"), "dtype": spec.get("dtype"), "names": spec.get("names") or [], "feature": sub}


def format_feature(feature: dict) -> dict:
    """The inverse of parse_feature()."""
    sub = feature["feature"]
    out = {"_type": feature["type"]} | {k: feature[k] for k in ("dtype", "names") if feature.get(k)}
    if sub:
        out["feature"] = format_feature(sub[""]) if set(sub) == {""} else {k: format_feature(v) for k, v in sub.items()}
    return out


def info_frames(spark: SparkSession, content: str) -> dict[str, DataFrame]:
    """Dataset metadata JSON to the tables configs, splits and features."""
    configs, splits, features = [], [], []
    for name, c in sorted((json.loads(content).get("dataset_info") or {}).items()):
        configs.append(tuple(c.get(k) for k in ("description", "citation", "homepage", "license", "builder_name")) + (name, c.get("download_size"), c.get("dataset_size")))
        splits += [(name, k, s.get("num_bytes"), s.get("num_examples")) for k, s in sorted((c.get("splits") or {}).items())]
        features += [(name, k, f.get("_type"), f.get("dtype"), json.dumps(format_feature(parse_feature(f)), sort_keys=True)) for k, f in sorted((c.get("features") or {}).items()) if isinstance(f, dict)]
    return {
        "configs": spark.createDataFrame(configs, "description string, citation string, homepage string, license string, builder_name string, config string, download_size long, dataset_size long"),
        "splits": spark.createDataFrame(splits, "config string, split string, num_bytes long, num_examples long"),
        "features": spark.createDataFrame(features, "config string, name string, type string, dtype string, spec string"),
    }


def files_frame(spark: SparkSession, content: str) -> DataFrame:
    """The file catalog JSON as rows, `ordinal` being their order."""
    rows = [(i, *(f.get(k) for k in ("dataset", "config", "split", "url", "filename", "size"))) for i, f in enumerate(json.loads(content).get("parquet_files") or [])]
    return spark.createDataFrame(rows, f"ordinal long, {FILES}")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """files_frame() of a catalog in any store that Spark reads."""
    rows = spark.read.option("multiLine", True).schema(f"parquet_files array<struct<{FILES.replace(' ', ':').replace(',:', ',')}>>").json(path)
    return rows.select(F.posexplode("parquet_files").alias("ordinal", "f")).select(F.col("ordinal").cast("long").alias("ordinal"), "f.*")


def write_files(files: DataFrame, path: str) -> None:
    """The catalog as one JSON document, in order; a catalog is small."""
    ordered = files.orderBy("ordinal").select("dataset", "config", "split", "url", "filename", "size")
    ordered.agg(F.collect_list(F.struct("*")).alias("parquet_files")).coalesce(1).write.mode("overwrite").json(path)


def list_files(files: DataFrame, config: str = "", split: str = "") -> DataFrame:
    """Files of a config and split in catalog order; an empty name is any."""
    wanted = (F.lit(config) == "") | (F.col("config") == config), (F.lit(split) == "") | (F.col("split") == split)
    return files.where(wanted[0] & wanted[1]).orderBy("ordinal")


def config_of(name: Column) -> Column:
    """From a file's folder: none, `data` and `parquet` are `default`; else its parts, less a leading `data` or `parquet`, joined by `-`."""
    parts = F.split(name, "/")
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bare = F.when((F.size(folder) > 1) & folder[0].isin("data", "parquet"), F.slice(folder, F.lit(2), F.size(folder))).otherwise(folder)
    plain = (F.size(folder) == 0) | ((F.size(folder) == 1) & folder[0].isin(".", "data", "parquet", ""))
    return F.when(plain, "default").otherwise(F.array_join(bare, "-"))


def split_of(name: Column) -> Column:
    """From a file's own name: train, validation (`val` too), test, dev; else train."""
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    return F.when(base.contains("train"), "train").when(base.contains("val"), "validation").when(base.contains("test"), "test").when(base.contains("dev"), "validation").otherwise("train")


def _marked(name: Column, mark: Column) -> Column:
    """Whether a name has /mark/, the same with - as /, or _mark_."""
    around = lambda m, a: name.contains(F.concat(F.lit(a), m, F.lit(a)))
    return around(mark, "/") | around(F.replace(mark, F.lit("-"), F.lit("/")), "/") | around(mark, "_")


def crawl(files: DataFrame, dataset: str, url: Column | None = None, splits: DataFrame | None = None) -> DataFrame:
    """The catalog of a repository's files (name, size) that end in .parquet: config and split from their names.

    With known splits (config, split) the first config by name that a file's name is marked with wins, then the first split of
    its config that it is marked with or whose name its base name contains. `ordinal` follows the names.
    """
    rows = files.where(F.col("name").endswith(".parquet")).select("name", "size", config_of(F.col("name")).alias("config"), split_of(F.col("name")).alias("split"))
    base = F.element_at(F.split("name", "/"), -1)
    if splits is not None:
        known = splits.groupBy("config").agg(F.sort_array(F.collect_set("split")).alias("s"))
        table = F.broadcast(known.agg(F.sort_array(F.collect_list(F.struct("config", "s"))).alias("known")))  # one row: a dataset's configs
        rows = rows.crossJoin(table)
        first = F.get(F.filter("known", lambda k: _marked(F.col("name"), k["config"])), F.lit(0))
        rows = rows.withColumn("config", F.coalesce(first["config"], F.col("config")))
        own = F.get(F.filter("known", lambda k: k["config"] == F.col("config")), F.lit(0))["s"]
        found = F.get(F.filter(own, lambda s: _marked(F.col("name"), s) | base.contains(s)), F.lit(0))
        rows = rows.withColumn("split", F.coalesce(found, F.col("split")))
    rows = rows.select(F.lit(dataset).alias("dataset"), "config", "split", (url if url is not None else F.col("name")).alias("url"), base.alias("filename"), "size", "name")
    return rows.withColumn("ordinal", F.expr("row_number() over (order by name)") - 1).drop("name").select("ordinal", "dataset", "config", "split", "url", "filename", "size")


def downloaded(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose name the cache (filename) has."""
    return files.join(cached.select("filename").distinct(), "filename", "left_semi")


def missing(files: DataFrame, cached: DataFrame) -> DataFrame:
    return files.join(cached.select("filename").distinct(), "filename", "left_anti")


def describe(splits: DataFrame, files: DataFrame) -> DataFrame:
    """Each config and split with its files' number and bytes, 0 without files."""
    held = files.groupBy("config", "split").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return splits.join(held, ["config", "split"], "left").withColumn("files", F.coalesce("files", F.lit(0))).withColumn("bytes", F.coalesce("bytes", F.lit(0))).orderBy("config", "split")


def default_choice(splits: DataFrame) -> DataFrame:
    """(config, split): the first config by name, and its first split."""
    return splits.agg(F.min(F.struct("config", "split")).alias("first")).select("first.*")


def summary_lines(splits: DataFrame, files: DataFrame) -> DataFrame:
    """(config, split, line): what a reader is told of each config and split."""
    size = F.when(F.col("bytes") >= 1 << 20, F.concat(F.round(F.col("bytes") / (1 << 20), 1).cast("string"), F.lit(" MB"))).otherwise(F.concat(F.col("bytes").cast("string"), F.lit(" bytes")))
    told = F.concat_ws(" ", F.concat_ws("/", "config", "split"), F.lit("has"), F.col("files").cast("string"), F.when(F.col("files") == 1, "file").otherwise("files"), F.lit("of"), size)
    return describe(splits, files).select("config", "split", told.alias("line"))
