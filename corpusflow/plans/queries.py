"""The library's queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import json
import os
import struct
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, names, shapes, vectors, words
from ..operators import aggregates, bucket, embed, image, similarity
from ..operators.parallel import spread
from ..operators.tokenizer import Options, Tokenizer, decode_column, encode_ids_column, tokens_table
from ..sources import catalog, dequant, hub, scan, schema, tensors
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their texts: over all cores, also where the table is one small file."""
    return spread(read(spark, sf_dir, "documents"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local master may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='corpusflow-')}/corpusflow/{kind}-{uuid.uuid4().hex}"


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def joined(c: Column) -> Column:
    """Arrays as one string, so that any engine compares them alike."""
    return F.array_join(c.cast("array<string>"), "|")


# Words as SQL has them: DuckDB's regular expressions know the same classes.
SPACE = r"\t\n\x0B\f\r \x{85}\p{Z}"
PUNCT = r"!-/:-@\[-`{-~\p{P}"

# ---- scans, projections, filters ---------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def q_scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, lang string").where("lang = 'en'")


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS url, CAST(n_chars AS INTEGER) AS n_chars FROM documents")
def q_scan_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, url string, n_chars int")


@query("SELECT doc_id, '' AS url, 0 AS score FROM documents")
def q_scan_zero_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, url string, score int", zero_missing=True)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id OFFSET 50")
def q_scan_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, source string").orderBy("doc_id").offset(50)


@query("SELECT file_no, count(*) AS rows, min(row_no) AS first_row, max(row_no) AS last_row FROM (SELECT 0 AS file_no, row_number() OVER () - 1 AS row_no FROM orders UNION ALL SELECT 1, (SELECT count(*) FROM orders) + row_number() OVER () - 1 FROM customer) GROUP BY file_no")
def q_scan_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.numbered(spark, [f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet"], "o_orderkey bigint")
    return df.groupBy("file_no").agg(F.count("*").alias("rows"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


@query("SELECT 'supplier' AS kind, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer")
def q_union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return a.unionByName(read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))


@query("SELECT conv_id AS query_id, pos, text FROM (SELECT conv_id, unnest(list(text ORDER BY turn)) AS text, unnest(range(count(*))) AS pos FROM conversations GROUP BY conv_id) WHERE text <> ''")
def q_passages_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("passage_text"))
    out = scan.passages(grouped.withColumn("passages", F.struct("passage_text")))
    return out.select("query_id", F.col("at").cast("long").alias("pos"), "text")


# ---- catalog -----------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a catalog: source as config, language as split."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("config"), F.col("lang").alias("split"), F.concat(F.col("doc_id").cast("string"), F.lit(".parquet")).alias("filename"), F.col("n_chars").alias("size"))


@query("SELECT source AS config, lang AS split, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def q_catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.catalog_summary(_files(spark, sf_dir))


@query("SELECT doc_id AS ordinal, source AS config, lang AS split FROM documents WHERE lang = 'de'")
def q_catalog_filter_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_files(_files(spark, sf_dir), "", "de").select("ordinal", "config", "split")


@query("SELECT doc_id AS ordinal FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_catalog_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = read(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".parquet")).alias("filename"))
    return catalog.downloaded(_files(spark, sf_dir), cached).select("ordinal")


@query("SELECT doc_id AS ordinal FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_catalog_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = read(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".parquet")).alias("filename"))
    return catalog.missing(_files(spark, sf_dir), cached).select("ordinal")


@query("SELECT s.config, s.split, coalesce(files, 0) AS files, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT source AS config, lang AS split FROM documents) s LEFT JOIN (SELECT source AS config, lang AS split, count(*) AS files, sum(n_chars) AS bytes FROM documents WHERE n_chars > 5000 GROUP BY ALL) f USING (config, split)")
def q_catalog_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return catalog.describe(files.select("config", "split").distinct(), files.where("size > 5000"))


@query("SELECT source AS config, lang AS split FROM documents ORDER BY source, lang LIMIT 1")
def q_default_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The config and split that are taken where none is said."""
    return catalog.default_choice(_files(spark, sf_dir).select("config", "split"))


@query("SELECT source AS config, lang AS split, source || '/' || lang || ' has ' || count(*) || CASE WHEN count(*) = 1 THEN ' file of ' ELSE ' files of ' END || CASE WHEN sum(n_chars) >= 1048576 THEN round(sum(n_chars) / 1048576.0, 1) || ' MB' ELSE sum(n_chars) || ' bytes' END AS line FROM documents GROUP BY source, lang")
def q_catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return catalog.summary_lines(files.select("config", "split").distinct(), files)


def _named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of all the forms that the rules tell apart, made from document numbers."""
    i = F.col("doc_id")
    folder = F.element_at(F.array(*(F.lit(x) for x in ("", "data/", "parquet/", "data/en/", "sub-a/x/", "plain/"))), (i % 6 + 1).cast("int"))
    name = F.element_at(F.array(*(F.lit(x) for x in ("Train", "val", "test", "dev", "part", "validation", "other"))), (i % 7 + 1).cast("int"))
    ending = F.when(i % 5 == 4, ".json").otherwise(".parquet")
    return read(spark, sf_dir, "documents").select(F.concat(folder, name, F.lit("-"), F.lpad(i.cast("string"), 8, "0"), ending).alias("name"), F.col("n_chars").alias("size"))


_NAMED = """named AS (SELECT (['', 'data/', 'parquet/', 'data/en/', 'sub-a/x/', 'plain/'])[doc_id % 6 + 1] || (['Train', 'val', 'test', 'dev', 'part', 'validation', 'other'])[doc_id % 7 + 1]
  || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || CASE WHEN doc_id % 5 = 4 THEN '.json' ELSE '.parquet' END AS name, n_chars AS size FROM documents),
parts AS (SELECT name, size, string_split(name, '/')[:-2] AS dirs, lower(string_split(name, '/')[-1]) AS base FROM named WHERE ends_with(name, '.parquet'))"""


@query(f"""WITH {_NAMED} SELECT row_number() OVER (ORDER BY name) - 1 AS ordinal, size,
  CASE WHEN len(dirs) = 0 OR len(dirs) = 1 AND dirs[1] IN ('.', 'data', 'parquet', '') THEN 'default' WHEN len(dirs) > 1 AND dirs[1] IN ('data', 'parquet') THEN array_to_string(dirs[2:], '-') ELSE array_to_string(dirs, '-') END AS config,
  CASE WHEN contains(base, 'train') THEN 'train' WHEN contains(base, 'val') THEN 'validation' WHEN contains(base, 'test') THEN 'test' WHEN contains(base, 'dev') THEN 'validation' ELSE 'train' END AS split FROM parts""")
def q_crawl_split_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.crawl(_named_files(spark, sf_dir), "d").select(F.col("ordinal").cast("long").alias("ordinal"), "size", "config", "split")


@query(f"""WITH {_NAMED} SELECT size, CASE WHEN contains(name, '/en/') THEN 'en' WHEN contains(name, '/x/') OR contains(name, '/plain/') THEN CASE WHEN contains(name, '/x/') THEN 'x' ELSE 'plain' END
    WHEN len(dirs) = 0 OR len(dirs) = 1 AND dirs[1] IN ('.', 'data', 'parquet', '') THEN 'default' ELSE array_to_string(dirs, '-') END AS config,
  CASE WHEN contains(name, '/en/') AND contains(base, 'part') THEN 'part' WHEN contains(base, 'train') THEN 'train' WHEN contains(base, 'val') THEN 'validation' WHEN contains(base, 'test') THEN 'test' WHEN contains(base, 'dev') THEN 'validation' ELSE 'train' END AS split
  FROM parts""")
def q_crawl_known_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("en", "part"), ("x", "zzz")], "config string, split string")
    return catalog.crawl(_named_files(spark, sf_dir), "d", splits=known).select("size", "config", "split")


# ---- names, paths, prompts ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'foo/' || doc_id WHEN 1 THEN 'bar/' || doc_id WHEN 2 THEN 'foo/' || doc_id WHEN 3 THEN '.' END AS path FROM documents")
def q_clean_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("./foo//"), i)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("../foo/../bar/"), i)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("foo/x/../"), i, F.lit("/."))).otherwise(F.lit("foo/../../../.."))
    return read(spark, sf_dir, "documents").select("doc_id", names.clean_path(raw).alias("path"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/home/u/' || source WHEN 1 THEN '/home/u' WHEN 2 THEN '~' || source ELSE 'a/~/' || source END AS path FROM documents")
def q_expand_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("doc_id") % 4
    raw = F.when(case == 0, F.concat(F.lit("~/"), "source")).when(case == 1, "~").when(case == 2, F.concat(F.lit("~"), "source")).otherwise(F.concat(F.lit("a/~/"), "source"))
    return read(spark, sf_dir, "documents").select("doc_id", names.expand_home(raw, F.lit("/home/u")).alias("path"))


@query("SELECT DISTINCT CASE event_type WHEN NULL THEN NULL ELSE 'QueryID' || upper(event_type[1]) || event_type[2:] || 'URL' END AS name FROM events")
def q_camel_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type").distinct().select(names.camel_case(F.concat(F.lit("query_id_"), "event_type", F.lit("_url"))).alias("name"))


@query("SELECT 'datasets--' || source || '--' || lang AS folder, 'https://hub/datasets/' || source || '/' || lang || '/resolve/main/a.parquet' AS url, count(*) AS n FROM documents GROUP BY ALL")
def q_flat_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.concat_ws("/", "source", "lang")
    rows = read(spark, sf_dir, "documents").select(names.flat_folder_name(F.lit("datasets"), repo).alias("folder"), names.file_url("https://hub", "datasets", repo, F.lit("main"), F.lit("a.parquet")).alias("url"))
    return rows.groupBy("folder", "url").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, 'layer_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '/attn/MultiHeadAttention/query/dense' WHEN 1 THEN '/mlp/up_proj/dense' ELSE '/input_norm/rms_norm' END AS scope,
  CASE doc_id % 3 WHEN 0 THEN 'biases' WHEN 1 THEN 'weights' ELSE 'scale' END AS variable FROM documents""")
def q_tensor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("encoder.layer."), i, F.lit(".attention.self.query.bias")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("model.language_model.layers."), i, F.lit(".mlp.up_proj.weight")))
        .otherwise(F.concat(F.lit("model.layers."), i, F.lit(".input_layernorm.weight")))
    )
    return read(spark, sf_dir, "documents").select("doc_id", names.map_tensor_name(raw).alias("t")).select("doc_id", "t.*")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'query: ' || text WHEN 'assistant' THEN 'passage: ' || text ELSE text END AS prompt, CASE WHEN role = 'user' THEN 'Instruct: answer' || chr(10) || 'Query: ' || text ELSE text END AS instructed FROM conversations")
def q_prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = F.create_map(*(F.lit(x) for kv in fixtures.PROMPTS.items() for x in kv))
    task = F.when(F.col("role") == "user", "query").when(F.col("role") == "assistant", "document").otherwise("none")
    instruction = F.when(F.col("role") == "user", "answer").otherwise("")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", names.build_prompt(prompts, task, F.lit("query"), F.col("text")).alias("prompt"), names.instruct_query(instruction, F.col("text")).alias("instructed"))


# ---- normalizers and pre-tokenizers --------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def q_lowercase_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(chars.lowercase(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def q_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.md5(chars.unicode_form(F.col("text"), "NFC").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def q_strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.md5(chars.strip_accents(F.col("text")).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\t\n\r]', ' ', 'g')) AS digest FROM documents")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(chars.clean(F.col("text")).cast("binary")).alias("digest"))


def _words_query(make: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", make(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(joined(F.col("w")).cast("binary")).alias("digest"))

    return run


def _words_sql(extract: str) -> str:
    return f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, '|')) AS digest FROM (SELECT doc_id, {extract} AS w FROM documents)"


for _name, _make, _sql in (
    ("q_word_count_whitespace", words.whitespace_words, f"regexp_extract_all(text, '[^{SPACE}]+')"),
    ("q_bert_words", words.bert_words, f"regexp_extract_all(text, '[{PUNCT}]|[^{SPACE}{PUNCT}]+')"),
    ("q_punctuation_words", words.punctuation_words, f"regexp_extract_all(text, '[{PUNCT}]|[^{PUNCT}]+')"),
    ("q_split_removed", lambda t: words.split_words(t, "[aeiou]+"), "regexp_extract_all(text, '[^aeiou]+')"),
    ("q_split_isolated", lambda t: words.split_words(t, "[aeiou]", "isolated"), "regexp_extract_all(text, '[aeiou]|[^aeiou]+')"),
    ("q_split_contiguous", lambda t: words.split_words(t, "[aeiou]", "contiguous"), "regexp_extract_all(text, '[aeiou]+|[^aeiou]+')"),
    ("q_split_merged_previous", lambda t: words.split_words(t, "[aeiou]", "MergedWithPrevious"), "regexp_extract_all(text, '[^aeiou]+[aeiou]?|[aeiou]')"),
    ("q_split_merged_next", lambda t: words.split_words(t, "[aeiou]", "merged_with_next"), "regexp_extract_all(text, '[aeiou][^aeiou]*|[^aeiou]+')"),
    ("q_split_inverted", lambda t: words.split_words(t, "[aeiou]+", "removed", invert=True), "regexp_extract_all(text, '[aeiou]+')"),
    ("q_space_led_words", lambda t: words.space_led_words(t, prefix=True), "regexp_extract_all(CASE WHEN starts_with(text, ' ') THEN text ELSE ' ' || text END, ' [^ ]*|[^ ]+')"),
    ("q_metaspace", words.metaspace_words, "regexp_extract_all(replace(CASE WHEN text = '' OR starts_with(text, ' ') THEN text ELSE ' ' || text END, ' ', '▁'), '▁[^▁]*|[^▁]+')"),
    ("q_added_token_split", lambda t: words.added_token_segments(t, ["the", "then", "of"]), "list_filter(string_split(regexp_replace(text, '(then|the|of)', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '')"),
):
    QUERIES[_name], SQL[_name] = _words_query(_make), _words_sql(_sql)

# ---- subword models ------------------------------------------------------------------------------------------------------


def _distinct_words(spark: SparkSession, sf_dir: str, make: Callable[[Column], Column]) -> DataFrame:
    return texts(spark, sf_dir).select(F.explode(make(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _longest_match_sql(extract: str, whole_word_unknown: bool, prefix: str) -> str:
    """Greedy longest match over distinct words, one piece a step."""
    vocab = fixtures.vocabulary(prefix)
    values = ", ".join(f"('{w}', {i})" for w, i in vocab.items())
    first = f"CASE WHEN pos = 1 THEN substr(word, pos, k) ELSE '{prefix}' || substr(word, pos, k) END"
    step = f"""SELECT word, n, CASE WHEN hit IS NULL THEN {'length(word) + 1' if whole_word_unknown else 'pos + 1'} ELSE pos + hit.k END AS pos,
      CASE WHEN hit IS NULL THEN {"['0']" if whole_word_unknown else "list_append(ids, '0')"} ELSE list_append(ids, CAST(hit.id AS VARCHAR)) END AS ids
      FROM (SELECT word, n, pos, ids, (SELECT max(struct_pack(k := k, id := v.id)) FROM range(1, {max(map(len, vocab)) + 1}) r(k), vocab v WHERE pos + k - 1 <= length(word) AND v.token = {first}) AS hit FROM pieces WHERE pos <= length(word))"""
    return f"""WITH RECURSIVE vocab(token, id) AS (VALUES {values}),
    distinct_words AS (SELECT word, count(*) AS n FROM (SELECT unnest({extract}) AS word FROM documents) GROUP BY word),
    pieces AS (SELECT word, n, CAST(1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS ids FROM distinct_words UNION ALL {step})
    SELECT word, n, array_to_string(ids, '|') AS ids FROM pieces WHERE pos > length(word)"""


@query(_longest_match_sql(f"regexp_extract_all(lower(text), '[{PUNCT}]|[^{SPACE}{PUNCT}]+')", True, "##"))
def q_wordpiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _distinct_words(spark, sf_dir, words.bert_words)
    return found.select("word", "n", joined(encode_ids_column(Tokenizer(fixtures.word_piece_spec()), F.col("word"))).alias("ids"))


@query(_longest_match_sql(f"regexp_extract_all(lower(text), '[^{SPACE}]+')", False, ""))
def q_unigram_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _distinct_words(spark, sf_dir, words.whitespace_words)
    return found.select("word", "n", joined(encode_ids_column(Tokenizer(fixtures.unigram_spec()), F.col("word"))).alias("ids"))


def _merging_sql() -> str:
    """Distinct words merged one pair a step: the pair of least rank, the leftmost on a tie."""
    ranks = ", ".join(f"'{m}': {i}" for i, m in enumerate(fixtures.merges()))
    vocab = ", ".join(f"('{w}', {i})" for w, i in fixtures.bpe_spec()["model"]["vocab"].items())
    pair = "list_sort(list_filter(list_transform(range(1, len(s)), lambda i: struct_pack(r := list_extract(map_extract(m, s[i] || ' ' || s[i + 1]), 1), i := i)), lambda x: x.r IS NOT NULL))[1]"
    return f"""WITH RECURSIVE ranks AS (SELECT MAP {{{ranks}}} AS m), vocab(token, id) AS (VALUES {vocab}),
    placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^{SPACE}]+') AS w FROM documents)),
    merged AS (SELECT DISTINCT word, regexp_extract_all(word, '(?s).') AS s FROM placed
      UNION ALL SELECT word, list_concat(list_append(s[:best.i - 1], s[best.i] || s[best.i + 1]), s[best.i + 2:]) FROM (SELECT word, s, {pair} AS best FROM merged, ranks) WHERE best IS NOT NULL),
    done AS (SELECT word, arg_min(s, len(s)) AS s FROM merged GROUP BY word),
    pieces AS (SELECT word, unnest(s) AS token, unnest(range(len(s))) AS k FROM done),
    encoded AS (SELECT word, string_agg(CAST(coalesce(id, 0) AS VARCHAR), '|' ORDER BY k) AS ids, count(*) AS n FROM pieces LEFT JOIN vocab USING (token) GROUP BY word),
    joined AS (SELECT doc_id, CAST(sum(n) AS INTEGER) AS n, string_agg(ids, '|' ORDER BY place) AS ids FROM placed JOIN encoded USING (word) GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n, md5(coalesce(ids, '')) AS digest FROM documents LEFT JOIN joined USING (doc_id)"""


@query(_merging_sql())
def q_bpe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", encode_ids_column(Tokenizer(fixtures.bpe_spec()), F.col("text")).alias("ids")).select("doc_id", F.size("ids").alias("n"), F.md5(joined(F.col("ids")).cast("binary")).alias("digest"))


def _between(processor: dict) -> Query:
    """Words between special tokens: the first, the last and how many."""
    spec = {"pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "None", "vocab": {"[UNK]": 7}, "unk_token": "[UNK]"}, "post_processor": processor}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = texts(spark, sf_dir).select("doc_id", encode_ids_column(Tokenizer(spec), F.col("text")).alias("ids"))
        return ids.select("doc_id", F.col("ids")[0].alias("first_id"), F.size("ids").alias("n"), F.element_at("ids", -1).alias("last_id"), F.size(F.filter("ids", lambda x: x == 7)).alias("known"))

    return run


_TEMPLATE = [{"SpecialToken": {"id": "<s>"}}, {"SpecialToken": {"id": "<lang>"}}, {"Sequence": {"id": "A"}}, {"SpecialToken": {"id": "</s>"}}]
for _name, _processor, _around in (
    ("q_template_tokens", {"type": "TemplateProcessing", "single": _TEMPLATE, "special_tokens": {"<s>": {"ids": [1]}, "<lang>": {"ids": [5, 6]}, "</s>": {"ids": [2]}}}, 4),
    ("q_roberta_tokens", {"type": "RobertaProcessing", "cls": ["<s>", 1], "sep": ["</s>", 2]}, 2),
):
    QUERIES[_name] = _between(_processor)
    SQL[_name] = f"SELECT doc_id, 1 AS first_id, CAST(n + {_around} AS INTEGER) AS n, 2 AS last_id, n AS known FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{SPACE}]+')) AS INTEGER) AS n FROM documents)"


@query("SELECT doc_id, lang, 101 AS first_id, CAST(len(w) + 2 AS INTEGER) AS n, 102 AS last_id FROM (SELECT doc_id, lang, regexp_extract_all(text, '[^" + SPACE + "]+') AS w FROM documents)")
def q_postprocess_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {
        "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "None", "vocab": {"[UNK]": 0}, "unk_token": "[UNK]"},
        "post_processor": {"type": "BertProcessing", "cls": ["[CLS]", 101], "sep": ["[SEP]", 102]},
    }
    ids = encode_ids_column(Tokenizer(spec), F.col("text"))
    return texts(spark, sf_dir).select("doc_id", "lang", ids.alias("ids")).select("doc_id", "lang", F.col("ids")[0].alias("first_id"), F.size("ids").alias("n"), F.element_at("ids", -1).alias("last_id"))


@query(f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[{PUNCT}]|[^{SPACE}{PUNCT}]+')) AS word FROM benchmark)
SELECT item_id, CAST(count(*) AS BIGINT) AS words, CAST(sum(length(word)) AS BIGINT) AS covered FROM w GROUP BY item_id""")
def q_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans cut the text into its words again: as many, and of as many bytes (the benchmark's text is ASCII where it counts)."""
    spec = fixtures.word_piece_spec() | {"model": {"type": "None", "vocab": {"[UNK]": 0}, "unk_token": "[UNK]"}}
    tokens = tokens_table(read(spark, sf_dir, "benchmark"), Tokenizer(spec, options=Options(include_spans=True)), "item_id", "text")
    text = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("raw"))
    cut = tokens.join(text, "item_id").select("item_id", F.length(F.substring(F.col("raw"), F.col("start") + 1, F.col("end") - F.col("start")).cast("string")).alias("chars"))
    return cut.groupBy("item_id").agg(F.count("*").alias("words"), F.sum("chars").cast("long").alias("covered"))


_VOCABULARY = ", ".join(f"('{w}', {i})" for w, i in fixtures.vocabulary().items())


@query(f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{SPACE}]+')) AS token FROM documents), v(token, id) AS (VALUES {_VOCABULARY}) SELECT doc_id, count(id) AS known, CAST(coalesce(sum(id), 0) AS BIGINT) AS id_sum FROM w LEFT JOIN v USING (token) GROUP BY doc_id")
def q_vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to ids by a join with a tokenizer's vocabulary, whose size bounds what is broadcast."""
    found = texts(spark, sf_dir).select("doc_id", F.explode(words.whitespace_words(F.col("text"))).alias("token"))
    vocab = spark.createDataFrame(list(fixtures.vocabulary().items()), "token string, id long")
    return found.join(F.broadcast(vocab), "token", "left").groupBy("doc_id").agg(F.count("id").alias("known"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"))


@query("SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM (SELECT doc_id, unnest(range(1, 4)) AS pos, unnest([doc_id % 7, doc_id % 11, doc_id % 3]) AS id FROM documents) JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two'), (3, 'three'), (4, 'four'), (5, 'five')) v(id, token) USING (id) GROUP BY doc_id")
def q_vocab_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to tokens; those that the vocabulary hasn't are left out."""
    vocab = spark.createDataFrame(list(enumerate(["zero", "one", "two", "three", "four", "five"])), "id long, token string")
    ids = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(F.col("doc_id") % 7, F.col("doc_id") % 11, F.col("doc_id") % 3)).alias("at", "id"))
    kept = ids.join(F.broadcast(vocab), "id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("t"))
    return kept.select("doc_id", F.array_join("t.token", " ").alias("text"))


# ---- buckets -------------------------------------------------------------------------------------------------------------

_TWO_BIT = "CASE WHEN m <= 2 THEN m WHEN m = top THEN m WHEN m <= top + top // 2 THEN top + top // 2 ELSE 2 * top END"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.size(words.whitespace_words(F.col("text"))).alias("n"))


_LENGTHS = f"lengths AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{SPACE}]+')) AS INTEGER) AS n FROM documents)"


def _two_bit_sql(least: int, size: str) -> str:
    return f"""WITH {_LENGTHS}, floored AS (SELECT doc_id, n, greatest(n, {least}) AS m FROM lengths), topped AS (SELECT *, CAST(1 AS INTEGER) << CAST(floor(log2(m)) AS INTEGER) AS top FROM floored),
    shaped AS (SELECT doc_id, n, CAST({_TWO_BIT} AS INTEGER) AS seq_len FROM topped) SELECT doc_id, n, CAST({size} AS INTEGER) AS batch_size, seq_len FROM shaped"""


def _power_sql(least: int, base: int, size: str) -> str:
    return f"""WITH {_LENGTHS}, shaped AS (SELECT doc_id, n, CAST(floor(pow({base}, ceil(ln(greatest(n, {least})) / ln({base})))) AS INTEGER) AS seq_len FROM lengths)
    SELECT doc_id, n, CAST({size} AS INTEGER) AS batch_size, seq_len FROM shaped"""


@query(_power_sql(8, 2, "32"))
def q_bucket_by_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket.shaped(_lengths(spark, sf_dir), F.col("n"), shapes.by_power(32, 8, 2))


@query(_power_sql(8, 2, "greatest(256 // seq_len, 1)"))
def q_bucket_by_power_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket.shaped(_lengths(spark, sf_dir), F.col("n"), shapes.by_power_budget(256, 8, 2))


@query(_two_bit_sql(4, "32"))
def q_two_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket.shaped(_lengths(spark, sf_dir), F.col("n"), shapes.by_two_bit(32, 4))


@query(_two_bit_sql(16, "greatest(8192 // seq_len, 1)"))
def q_two_bit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket.shaped(_lengths(spark, sf_dir), F.col("n"), shapes.by_two_bit_budget(8192, 16))


@query(f"WITH {_LENGTHS} SELECT doc_id, n, CAST(4 AS INTEGER) AS batch_size, CAST(100 * (n // 100 + 1) AS INTEGER) AS seq_len FROM lengths")
def q_custom_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket.shaped(_lengths(spark, sf_dir), F.col("n"), lambda n: shapes.shape(F.lit(4), 100 * (F.floor(n / 100) + 1)))


def _word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ids: the length of each word."""
    return texts(spark, sf_dir).select("doc_id", F.transform(words.whitespace_words(F.col("text")), lambda w: F.length(w)).alias("ids"))


def _batches(spark: SparkSession, sf_dir: str, padded: bool = False) -> DataFrame:
    return bucket.batches(_word_lengths(spark, sf_dir), "doc_id", "ids", "doc_id", 0, shapes.by_two_bit_budget(8192, 16), padded, bucket.RUN)


_BATCHED = f"""WITH {_LENGTHS}, floored AS (SELECT doc_id, n, greatest(n, 16) AS m FROM lengths), topped AS (SELECT *, CAST(1 AS INTEGER) << CAST(floor(log2(m)) AS INTEGER) AS top FROM floored),
shaped AS (SELECT doc_id, n, CAST({_TWO_BIT} AS INTEGER) AS seq_len FROM topped), sized AS (SELECT *, greatest(8192 // seq_len, 1) AS batch_size FROM shaped),
batched AS (SELECT *, doc_id // 1048576 AS run, (row_number() OVER (PARTITION BY doc_id // 1048576, batch_size, seq_len ORDER BY doc_id) - 1) // batch_size AS batch_no FROM sized),
batches AS (SELECT run, batch_size, seq_len, batch_no, count(*) AS rows, sum(n) AS tokens FROM batched GROUP BY ALL)"""


@query(f"{_BATCHED} SELECT CAST(rows AS INTEGER) AS batch_size, seq_len, CAST(batch_no AS BIGINT) AS batch_no, CAST(tokens AS BIGINT) AS non_pad_tokens FROM batches")
def q_bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("batch_size", "seq_len", "batch_no", F.col("non_pad_tokens").cast("long").alias("non_pad_tokens"))


@query(f"{_BATCHED} SELECT count(*) AS batches, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(rows * seq_len) AS BIGINT) AS cells, round(1 - sum(tokens) / sum(rows * seq_len), 6) AS padding_ratio FROM batches")
def q_padding_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bucket.padding(_batches(spark, sf_dir))
    return out.select("batches", "rows", "tokens", "cells", rounded(F.col("padding_ratio")).alias("padding_ratio"))


@query(f"""{_BATCHED}, ids AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^{SPACE}]+'), lambda w: length(w)) AS ids FROM documents),
padded AS (SELECT run, batch_size, seq_len, batch_no, doc_id, list_concat(ids, list_transform(range(seq_len - len(ids)), lambda x: CAST(0 AS BIGINT))) AS row FROM batched JOIN ids USING (doc_id)),
flat AS (SELECT run, batch_size, seq_len, batch_no, flatten(list(row ORDER BY doc_id)) AS f, count(*) AS rows FROM padded GROUP BY ALL)
SELECT CAST(batch_size AS INTEGER) AS batch_size, seq_len, CAST(batch_no AS BIGINT) AS batch_no, CAST(rows AS BIGINT) AS real_rows, md5(array_to_string(list_concat(f, list_transform(range((batch_size - rows) * seq_len), lambda x: CAST(0 AS BIGINT))), '|')) AS digest FROM flat""")
def q_flat_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded batches whole: row after row, missing rows all pad."""
    real = F.size(F.filter("references", lambda r: r.isNotNull())).cast("long")
    return _batches(spark, sf_dir, True).select("batch_size", "seq_len", "batch_no", real.alias("real_rows"), F.md5(joined(F.col("batch")).cast("binary")).alias("digest"))


@query(f"{_BATCHED} SELECT DISTINCT CAST(batch_size AS INTEGER) AS batch_size, seq_len FROM batches")
def q_distinct_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket.distinct_shapes(_batches(spark, sf_dir, True))


@query(f"WITH {_LENGTHS} SELECT doc_id, n FROM lengths")
def q_rows_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches back to rows: every document once, with as many ids that aren't pad."""
    rows = bucket.rows_of(_batches(spark, sf_dir, True))
    return rows.select(F.col("reference").alias("doc_id"), vectors.seq_len(F.col("ids"), 0).alias("n"))


def _streamed(spark: SparkSession, sf_dir: str, padded: bool, deal: int) -> DataFrame:
    """Documents as a stream of files through the stateful bucketizer; what is pending when it ends follows as partial batches."""
    from ..streaming.bucketizer import OUTPUT, bucketize, drain, paced, remaining

    folder, name = shared_folder(spark, "stream"), f"stream_{uuid.uuid4().hex}"
    src = texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("reference"), F.transform(words.whitespace_words(F.col("text")), lambda w: F.length(w)).alias("ids"))
    src.write.mode("overwrite").parquet(f"{folder}/in")
    out = bucketize(paced(spark, f"{folder}/in", src.schema, 256), F.col("ids"), F.col("reference"), shapes.by_two_bit(4, 16), pad=0, batch_padding=padded, deal=deal)
    drain(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").queryName(name).trigger(availableNow=True).start())
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out").union(remaining(spark, f"{folder}/state", batch_padding=padded))


_SHAPED = f"""WITH {_LENGTHS}, floored AS (SELECT doc_id, n, greatest(n, 16) AS m FROM lengths), topped AS (SELECT *, CAST(1 AS INTEGER) << CAST(floor(log2(m)) AS INTEGER) AS top FROM floored),
shaped AS (SELECT doc_id, n, CAST({_TWO_BIT} AS INTEGER) AS seq_len FROM topped)"""


@query(f"{_SHAPED} SELECT CAST(doc_id AS VARCHAR) AS reference, seq_len, n FROM shaped")
def q_stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once, in a batch of its shape, with its ids."""
    rows = _streamed(spark, sf_dir, False, 32).select("seq_len", "batch", F.posexplode("references").alias("at", "reference"))
    return rows.select("reference", "seq_len", F.size(F.filter(F.slice("batch", F.col("at") * F.col("seq_len") + 1, F.col("seq_len")), lambda x: x != 0)).alias("n"))


@query(f"{_SHAPED} SELECT seq_len, (count(*) + 3) // 4 AS batches, CAST((count(*) + 3) // 4 * 4 * seq_len AS BIGINT) AS cells, CAST(sum(n) AS BIGINT) AS tokens, CAST((count(*) + 3) // 4 * 4 - count(*) AS BIGINT) AS missing FROM shaped GROUP BY seq_len")
def q_stream_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one size: as many as a shape's documents need, the last one filled up."""
    some = _streamed(spark, sf_dir, True, 1)
    missing = F.size(F.filter("references", lambda r: r.isNull()))
    return some.groupBy("seq_len").agg(F.count("*").alias("batches"), F.sum(F.size("batch")).alias("cells"), F.sum("non_pad_tokens").alias("tokens"), F.sum(missing).alias("missing"))


# ---- vectors -------------------------------------------------------------------------------------------------------------

_PAIRS = "FROM (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 50 = 0) JOIN (SELECT vec_id AS d, CAST(embedding AS DOUBLE[]) AS b FROM embeddings) ON true"


def _scored(spark: SparkSession, sf_dir: str, measure: str, digits: int | None = None) -> DataFrame:
    """Each fiftieth vector as a query, against all vectors."""
    e = read(spark, sf_dir, "embeddings")
    return similarity.pairs(e.where("vec_id % 50 = 0"), e, measure, ("vec_id", "embedding"), ("vec_id", "embedding"), digits=digits)


def _measure_query(measure: str) -> Query:
    return lambda spark, sf_dir: _scored(spark, sf_dir, measure, 6)


for _measure, _sql in (
    ("cosine", "list_cosine_similarity(a, b)"),
    ("dot", "list_dot_product(a, b)"),
    ("euclidean", "-list_distance(a, b)"),
    ("manhattan", "-list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))"),
):
    QUERIES[f"q_sim_{_measure}"] = _measure_query(_measure)
    SQL[f"q_sim_{_measure}"] = f"SELECT q AS query_id, d AS doc_id, round({_sql}, 6) AS score {_PAIRS}"


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q AS query_id, d AS doc_id, list_dot_product(a, b) AS score {_PAIRS})) WHERE rank <= 5")
def q_topk_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.top_k(_scored(spark, sf_dir, "dot"), 5)
    return out.select("query_id", "doc_id", rounded(F.col("score")).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("SELECT vec_id, pos, round(x / greatest(norm, 1e-12), 6) AS x FROM (SELECT vec_id, sqrt(list_dot_product(e, e)) AS norm, unnest(e) AS x, unnest(range(len(e))) AS pos FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * 3) AS e FROM embeddings))")
def q_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    out = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(tripled)).alias("at", "x"))
    return out.select("vec_id", F.col("at").cast("long").alias("pos"), rounded(F.col("x")).alias("x"))


def _components(df: DataFrame, key: str) -> DataFrame:
    out = df.select(key, F.posexplode("embedding").alias("at", "x"))
    return out.select(key, F.col("at").cast("long").alias("pos"), rounded(F.col("x").cast("double")).alias("x"))


_UNNESTED = "SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos, vec_id FROM embeddings"


@query(f"SELECT label, pos, round(avg(x), 6) AS x FROM ({_UNNESTED}) GROUP BY label, pos")
def q_pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(aggregates.mean_vectors(read(spark, sf_dir, "embeddings"), "label", "embedding"), "label")


@query(f"SELECT label, pos, round(avg(x), 6) AS x FROM ({_UNNESTED}) WHERE vec_id % 3 <> 0 GROUP BY label, pos")
def q_masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(aggregates.mean_vectors(read(spark, sf_dir, "embeddings"), "label", "embedding", F.col("vec_id") % 3 != 0), "label")


@query(f"SELECT label, pos, round(arg_min(x, vec_id), 6) AS x FROM ({_UNNESTED}) GROUP BY label, pos")
def q_pool_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(aggregates.first_vectors(read(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id"), "label")


@query(f"SELECT label, pos, round(arg_max(x, vec_id), 6) AS x FROM ({_UNNESTED}) GROUP BY label, pos")
def q_pool_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(aggregates.last_vectors(read(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id"), "label")


@query("WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), e AS (SELECT user_id, event_id, n, value AS ema FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, 0.1 * o.value + 0.9 * e.ema FROM e JOIN o ON o.user_id = e.user_id AND o.n = e.n + 1) SELECT user_id, event_id, round(ema * 1.0123456789e0, 6) AS ema FROM e")
def q_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.moving_average(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    return out.select("user_id", "event_id", rounded(F.col("ema") * 1.0123456789).alias("ema"))  # the factor keeps decimal ties off


@query("SELECT label, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg(abs(x - y)), 6) AS mean_abs_diff FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / 2)) AS y FROM embeddings) GROUP BY label")
def q_tensor_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumn("half", F.transform(F.col("embedding").cast("array<double>"), lambda x: x / 2))
    return aggregates.deviation(e, "embedding", "half", "label").select("label", *(rounded(F.col(c)).alias(c) for c in ("mean", "std", "mean_abs_diff")))


# ---- tensors, images -----------------------------------------------------------------------------------------------------

#: Types of the format with their ids, values and bytes of a block (fixed values), apart from the table that the query gives.
_TYPES_SQL = """VALUES (0, 'F32', 1, 4, false), (1, 'F16', 1, 2, false), (2, 'Q4_0', 32, 18, true), (3, 'Q4_1', 32, 20, true), (6, 'Q5_0', 32, 22, true), (7, 'Q5_1', 32, 24, true), (8, 'Q8_0', 32, 34, true),
(9, 'Q8_1', 32, 36, true), (10, 'Q2_K', 256, 84, true), (11, 'Q3_K', 256, 110, true), (12, 'Q4_K', 256, 144, true), (13, 'Q5_K', 256, 176, true), (14, 'Q6_K', 256, 210, true), (15, 'Q8_K', 256, 292, true),
(16, 'IQ2_XXS', 256, 66, true), (17, 'IQ2_XS', 256, 74, true), (18, 'IQ3_XXS', 256, 98, true), (19, 'IQ1_S', 256, 50, true), (20, 'IQ4_NL', 32, 18, true), (21, 'IQ3_S', 256, 110, true), (22, 'IQ2_S', 256, 82, true),
(23, 'IQ4_XS', 256, 136, true), (24, 'I8', 1, 1, false), (25, 'I16', 1, 2, false), (26, 'I32', 1, 4, false), (27, 'I64', 1, 8, false), (28, 'F64', 1, 8, false), (29, 'IQ1_M', 256, 56, true), (30, 'BF16', 1, 2, false),
(34, 'TQ1_0', 256, 54, true), (35, 'TQ2_0', 256, 66, true), (39, 'MXFP4', 32, 17, true)"""


@query(f"SELECT * FROM ({_TYPES_SQL}) t(id, name, block_size, type_size, quantized)")
def q_gguf_type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dequant.type_table(spark)


@query(f"SELECT doc_id, name, CAST(n AS BIGINT) AS elements, CAST(n // block_size * type_size AS BIGINT) AS bytes FROM (SELECT doc_id, (doc_id % 5 + 1) * 256 * (doc_id % 3 + 1) AS n FROM documents) JOIN ({_TYPES_SQL}) t(id, name, block_size, type_size, quantized) ON id IN (0, 8, 12)")
def q_tensor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.broadcast(dequant.type_table(spark).where("id in (0, 8, 12)"))  # three rows
    dims = F.array((F.col("doc_id") % 5 + 1) * 256, F.col("doc_id") % 3 + 1)
    both = read(spark, sf_dir, "documents").select("doc_id", vectors.num_elements(dims).alias("elements")).crossJoin(table)
    return both.select("doc_id", "name", "elements", F.expr("elements div block_size * type_size").alias("bytes"))


@query("SELECT doc_id, pos, CAST(CASE WHEN (doc_id + pos) % 256 > 127 THEN (doc_id + pos) % 256 - 256 ELSE (doc_id + pos) % 256 END AS DOUBLE) * 0.5 AS value FROM (SELECT doc_id, unnest(range(32)) AS pos FROM documents)")
def q_dequant_q8_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a scale of one half and bytes made from document numbers."""
    quants = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.lpad(F.hex((F.col("doc_id") + i) % 256), 2, "0")), "")
    blocks = read(spark, sf_dir, "documents").select("doc_id", F.unhex(F.concat(F.lit("0038"), quants)).alias("raw"))
    values = blocks.select("doc_id", dequant.gguf_dequantize(F.lit("Q8_0"), F.col("raw")).alias("v"))
    out = values.select("doc_id", F.posexplode("v.values").alias("at", "value"))
    return out.select("doc_id", F.col("at").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


def _byte(at: str) -> str:
    """What the blocks hold at a place, from the document's number."""
    return f"((doc_id * 7 + ({at}) * 13) % 256)"


def _nibble(at: str, high: str) -> str:
    return f"(CASE WHEN {high} THEN {_byte(at)} >> 4 ELSE {_byte(at)} & 15 END)"


def _dequant_sql() -> str:
    """A value of each block type by its definition: d is 0.5 and m is 1."""
    low = lambda first: _nibble(f"{first} + p % 16", "p >= 16")
    fifth = lambda first: f"((({_byte(f'{first} + p // 8')} >> (p % 8)) & 1) << 4)"
    pair = lambda first: f"(({_byte(f'{first} + 32 * (p // 128) + p % 32')} >> (2 * ((p % 128) // 32))) & 3)"
    s4 = f"(CASE WHEN p // 32 < 4 THEN {_byte('4 + p // 32')} & 63 ELSE ({_byte('8 + p // 32')} & 15) | (({_byte('p // 32')} >> 6) << 4) END)"
    m4 = f"(CASE WHEN p // 32 < 4 THEN {_byte('8 + p // 32')} & 63 ELSE ({_byte('8 + p // 32')} >> 4) | (({_byte('4 + p // 32')} >> 6) << 4) END)"
    half = lambda first: _nibble(f"{first} + 32 * (p // 64) + p % 32", "p % 64 >= 32")
    s3 = f"(((CASE WHEN p // 16 < 8 THEN {_byte('96 + p // 16')} & 15 ELSE {_byte('88 + p // 16')} >> 4 END) | ((({_byte('104 + (p // 16) % 4')} >> (2 * (p // 64))) & 3) << 4)) - 32)"
    q6 = f"({_nibble('64 * (p // 128) + p % 64', 'p % 128 >= 64')} | ((({_byte('128 + 32 * (p // 128) + p % 32')} >> (2 * ((p % 128) // 32))) & 3) << 4))"
    s6 = f"(CASE WHEN {_byte('192 + p // 16')} > 127 THEN {_byte('192 + p // 16')} - 256 ELSE {_byte('192 + p // 16')} END)"
    kinds = {
        "Q4_0": (32, f"0.5 * ({low(2)} - 8)"), "Q4_1": (32, f"0.5 * {low(4)} + 1"), "Q5_0": (32, f"0.5 * (({low(6)} | {fifth(2)}) - 16)"), "Q5_1": (32, f"0.5 * ({low(8)} | {fifth(4)}) + 1"),
        "Q2_K": (256, f"0.5 * ({_byte('p // 16')} & 15) * {pair(16)} - ({_byte('p // 16')} >> 4)"),
        "Q3_K": (256, f"0.5 * {s3} * ({pair(32)} - 4 * (1 - (({_byte('p % 32')} >> (p // 32)) & 1)))"),
        "Q4_K": (256, f"0.5 * {s4} * {half(16)} - {m4}"), "Q5_K": (256, f"0.5 * {s4} * ({half(48)} | ((({_byte('16 + p % 32')} >> (p // 32)) & 1) << 4)) - {m4}"),
        "Q6_K": (256, f"0.5 * {s6} * ({q6} - 32)"),
    }
    each = [f"SELECT doc_id, '{k}' AS type, CAST(sum(({v}) * (p + 1)) AS DOUBLE) AS total FROM (SELECT doc_id, unnest(range({n})) AS p FROM documents) GROUP BY doc_id" for k, (n, v) in kinds.items()]
    return " UNION ALL ".join(each)


#: Where a type's block has its scale and minimum as half floats: their bytes are those of 0.5 and 1.
_HALVES = {"Q4_0": (0,), "Q4_1": (0, 2), "Q5_0": (0,), "Q5_1": (0, 2), "Q2_K": (80, 82), "Q3_K": (108,), "Q4_K": (0, 2), "Q5_K": (0, 2), "Q6_K": (208,)}


@query(_dequant_sql())
def q_dequant_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of every type from document numbers, all values weighed by their places."""
    docs, out = read(spark, sf_dir, "documents").select("doc_id"), None

    def block(size: int, halves: tuple[int, ...]) -> Column:
        fixed = dict(zip((x + y for x in halves for y in (0, 1)), ("00", "38", "00", "3C"), strict=False))
        told = F.create_map(*(x for k, v in fixed.items() for x in (F.lit(k), F.lit(v))))
        byte = lambda i: F.coalesce(F.try_element_at(told, i), F.lpad(F.hex((F.col("doc_id") * 7 + i * 13) % 256), 2, "0"))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), byte), ""))

    for kind, halves in _HALVES.items():
        some = docs.select("doc_id", F.lit(kind).alias("type"), block(dequant.BY_NAME[kind].size, halves).alias("raw"))
        out = some if out is None else out.union(some)
    values = out.select("doc_id", "type", dequant.gguf_dequantize(F.col("type"), F.col("raw")).alias("v"))
    weighed = F.transform(F.col("v.values").cast("array<double>"), lambda x, i: x * (i + 1))
    return values.select("doc_id", "type", F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT vec_id, CAST(sum(CASE WHEN x > 0 THEN 255 ELSE 0 END) AS BIGINT) AS mask_sum FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def q_mask_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("embedding", lambda x: F.when(x > 0, F.lit(255).cast("long")).otherwise(F.lit(0).cast("long")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x).alias("mask_sum"))


def _tensor_files(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A container for each label with its vectors as tensors named by their ids, written where executors and driver see it."""
    folder = shared_folder(spark, kind)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        items = {f"vec.{i}.weight": np.asarray(v, "<f4") for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True)}
        data, head, infos, at = b"".join(a.tobytes() for a in items.values()), {"__metadata__": {"label": str(pdf["label"].iloc[0])}}, b"", 0
        text = lambda t: struct.pack("<Q", len(t.encode())) + t.encode()
        for name, a in items.items():
            head[name] = {"dtype": "F32", "shape": [len(a) // 8, 8], "data_offsets": [at, at + a.nbytes]}
            infos += text(name) + struct.pack("<I2QIQ", 2, 8, len(a) // 8, 0, at)
            at += a.nbytes
        if kind == "safetensors":
            raw = json.dumps(head).encode()
            out = struct.pack("<Q", len(raw)) + raw + data
        else:
            out = b"GGUF" + struct.pack("<IQQ", 3, len(items), 1) + text("label") + struct.pack("<Iq", 11, int(pdf["label"].iloc[0])) + infos
            out += b"\0" * (-len(out) % 32) + data
        filesystem, where = tensors.locate(folder)
        filesystem.create_dir(where, recursive=True)
        name = f"{where}/part-{int(pdf['label'].iloc[0]):03d}.{kind}"
        with filesystem.open_output_stream(f"{name}.{os.getpid()}.draft") as f:
            f.write(out)
        filesystem.move(f"{name}.{os.getpid()}.draft", name)
        return pd.DataFrame({"n": [len(items)]})

    read(spark, sf_dir, "embeddings").groupBy("label").applyInPandas(write, "n long").agg(F.sum("n")).collect()  # ten labels, a file each
    return folder


def _tensor_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = tensors.tensors(spark, _tensor_files(spark, sf_dir, kind), kind)
    values = rows.select("file", "name", "shape", dequant.gguf_dequantize(F.col("dtype"), F.col("data")).alias("v"))
    total = F.aggregate(F.col("v.values").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return values.select("file", "name", joined(F.col("shape")).alias("shape"), rounded(total, 4).alias("total"))


def _tensors_sql(kind: str, shape: str) -> str:
    return f"SELECT 'part-' || lpad(CAST(label AS VARCHAR), 3, '0') || '.{kind}' AS file, 'vec.' || vec_id || '.weight' AS name, '{shape}' AS shape, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings"


@query(_tensors_sql("safetensors", "8|8"))
def q_safetensors_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tensor_rows(spark, sf_dir, "safetensors")


@query(_tensors_sql("gguf", "8|8"))
def q_gguf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tensor_rows(spark, sf_dir, "gguf")


@query("SELECT 'vec.7.weight' AS name, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings WHERE vec_id = 7")
def q_tensor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tensor by name: the filter reaches the reader, which reads these bytes only."""
    rows = tensors.tensors(spark, _tensor_files(spark, sf_dir, "safetensors")).where("name = 'vec.7.weight'")
    values = rows.select("name", dequant.gguf_dequantize(F.col("dtype"), F.col("data")).alias("v"))
    return values.select("name", rounded(F.aggregate(F.col("v.values").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT 'part-' || lpad(CAST(label AS VARCHAR), 3, '0') || '.safetensors' AS file, count(*) AS tensors, CAST(sum(64) AS BIGINT) AS parameters, CAST(sum(256) AS BIGINT) AS bytes FROM embeddings GROUP BY label")
def q_tensor_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors, parameters and bytes of each shard, from the headers alone."""
    rows = tensors.tensors(spark, _tensor_files(spark, sf_dir, "safetensors"), data=False)
    return aggregates.parameter_totals(rows, F.lit(4).cast("long"), "file")  # all F32


@query("SELECT 'part-' || lpad(CAST(label AS VARCHAR), 3, '0') || '.safetensors' AS file, 'vec.' || vec_id || '.weight' AS name, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS at FROM embeddings")
def q_tensor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors by shard and offset."""
    return tensors.in_order(tensors.tensors(spark, _tensor_files(spark, sf_dir, "safetensors"), data=False)).select("file", "name", F.col("at").cast("int").alias("at"))


@query("SELECT 'part-' || lpad(CAST(label AS VARCHAR), 3, '0') || '.safetensors' AS file, 'vec.' || min(vec_id) || '.weight' AS name, round(list_sum(CAST(arg_min(embedding, vec_id) AS DOUBLE[])), 4) AS total FROM embeddings GROUP BY label")
def q_tensor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with an index file that names one tensor of each; only those are tensors of the model."""
    folder = _tensor_files(spark, sf_dir, "safetensors")
    first = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id")).collect()  # one row a shard
    filesystem, at = tensors.locate(folder)
    with filesystem.open_output_stream(f"{at}/{tensors.INDEX_NAMES[0]}") as f:
        f.write(json.dumps({"weight_map": {f"vec.{r['vec_id']}.weight": f"part-{r['label']:03d}.safetensors" for r in first}}).encode())
    values = tensors.sharded(spark, folder).select("file", "name", dequant.gguf_dequantize(F.col("dtype"), F.col("data")).alias("v"))
    return values.select("file", "name", rounded(F.aggregate(F.col("v.values").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT 'part-' || lpad(CAST(label AS VARCHAR), 3, '0') || '.gguf' AS file, 'label' AS key, 'i64' AS type, CAST(label AS BIGINT) AS long_value FROM embeddings GROUP BY label")
def q_gguf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.gguf_values(spark, _tensor_files(spark, sf_dir, "gguf")).select("file", "key", "type", "long_value")


@query("SELECT vec_id, CAST(4 * 255 * len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS mask_sum, CAST(256 AS BIGINT) AS pixels FROM embeddings")
def q_mask_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 by 8 logits, to masks of 16 by 16."""

    @F.pandas_udf("struct<mask_sum:bigint,pixels:bigint>")
    def masks(logits: pd.Series) -> pd.DataFrame:
        made = [image.mask_of(np.asarray(x).reshape(8, 8), 16, 16) for x in logits]
        return pd.DataFrame({"mask_sum": [int(m.astype(np.int64).sum()) for m in made], "pixels": [m.size for m in made]})

    return read(spark, sf_dir, "embeddings").select("vec_id", masks("embedding").alias("m")).select("vec_id", "m.*")


@query("SELECT vec_id, y, x, c, round(((vec_id % 100 + 3 * c + 2 * (4 * y + 1.5) + 5 * (2 * x + 0.5)) / 255.0 - 0.5) / 0.25, 4) AS value FROM embeddings, (SELECT unnest(range(2)) AS y), (SELECT unnest(range(2)) AS x), (SELECT unnest(range(3)) AS c)")
def q_image_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 by 4 that rise by 2 down and by 5 to the right, resized to 2 by 2 (places 1.5 and 5.5 down, 0.5 and 2.5 across), less their mean, over their deviation."""

    @F.pandas_udf("array<double>")
    def prepared(ids: pd.Series) -> pd.Series:
        y, x, c = np.meshgrid(np.arange(8), np.arange(4), np.arange(3), indexing="ij")
        made = (image.preprocess((int(i) % 100 + 3 * c + 2 * y + 5 * x).astype(np.uint8), 2, 2, [0.5] * 3, [0.25] * 3)[0] for i in ids)
        return pd.Series([m.transpose(1, 2, 0).ravel().astype(np.float64).tolist() for m in made])

    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(prepared("vec_id")).alias("at", "v"))
    at = F.col("at").cast("long")
    return rows.select("vec_id", F.floor(at / 6).alias("y"), (F.floor(at / 3) % 2).alias("x"), (at % 3).alias("c"), rounded(F.col("v"), 4).alias("value"))


@query("SELECT vec_id, CAST(sum(((vec_id + 31 * (p // 24) + 7 * (p % 24)) % 256) * (p + 1)) AS BIGINT) AS weighed, CAST(192 AS BIGINT) AS bytes FROM (SELECT vec_id, unnest(range(192)) AS p FROM embeddings) GROUP BY vec_id")
def q_png_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 8 by 8 in colour as PNG files and back, pixels weighed by their places."""

    @F.pandas_udf("struct<weighed:bigint,bytes:bigint>")
    def stored(ids: pd.Series) -> pd.DataFrame:
        p, rows = np.arange(192), []
        for i in ids:
            read_back = image.read_png(image.write_png(((int(i) + 31 * (p // 24) + 7 * (p % 24)) % 256).astype(np.uint8).reshape(8, 8, 3)))
            rows.append((int((read_back.ravel().astype(np.int64) * (p + 1)).sum()), read_back.size))
        return pd.DataFrame(rows, columns=["weighed", "bytes"])

    return read(spark, sf_dir, "embeddings").select("vec_id", stored("vec_id").alias("p")).select("vec_id", "p.*")


@query("SELECT vec_id, CAST((vec_id % 256 + 200) // 2 AS INTEGER) AS over, CAST(vec_id % 256 AS INTEGER) AS beside FROM embeddings")
def q_mask_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("struct<over:int,beside:int>")
    def blended(ids: pd.Series) -> pd.DataFrame:
        made = [image.overlay(np.full((1, 2, 4), int(i) % 256, np.uint8), np.array([[255, 0]]), (200, 200, 200)) for i in ids]
        return pd.DataFrame({"over": [int(m[0, 0, 0]) for m in made], "beside": [int(m[0, 1, 0]) for m in made]})

    return read(spark, sf_dir, "embeddings").select("vec_id", blended("vec_id").alias("b")).select("vec_id", "b.*")


# ---- embedding, decoding, metadata ---------------------------------------------------------------------------------------


def _lengths_encoder(ids: np.ndarray) -> np.ndarray:
    """Stands in for a network: each id's state is (id, 1)."""
    return np.stack([ids, np.ones_like(ids)], axis=2).astype(np.float64)


class _WordLengths:
    """Stands in for a tokenizer: a word's id is its number of characters."""

    def encode(self, text: str) -> list[int]:
        return [len(w) for w in text.split(" ") if w]


@query("SELECT conv_id * 1000 + turn AS reference, round(mean / sqrt(mean * mean + 1), 6) AS x, round(1 / sqrt(mean * mean + 1), 6) AS y FROM (SELECT conv_id, turn, list_avg(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w))) AS mean FROM conversations WHERE text <> '')")
def q_embed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenize, bucket, encode in padded batches, pool without the padding, normalize."""
    df = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("reference"), "text")
    out = embed.embed(df, "reference", "text", _WordLengths(), _lengths_encoder)
    return out.select("reference", rounded(F.col("embedding")[0]).alias("x"), rounded(F.col("embedding")[1]).alias("y"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def q_decode_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through byte-level BPE ids and back."""
    t = Tokenizer(fixtures.byte_level_spec())
    decoded = decode_column(t, encode_ids_column(t, F.col("text")))
    return texts(spark, sf_dir).select("doc_id", F.md5(decoded.cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[^" + SPACE + "]+'), ' ')) AS digest FROM documents")
def q_decode_word_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of known characters through WordPiece ids and back: white space becomes single spaces."""
    t = Tokenizer(fixtures.character_spec())
    decoded = decode_column(t, encode_ids_column(t, F.col("text")))
    return texts(spark, sf_dir).select("doc_id", F.md5(decoded.cast("binary")).alias("digest"))


def _decoded(spec: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tokenizer(spec)
        return texts(spark, sf_dir).select("doc_id", F.md5(decode_column(t, encode_ids_column(t, F.col("text"))).cast("binary")).alias("digest"))

    return run


_SPACED = "CASE WHEN text = '' OR starts_with(text, ' ') THEN text ELSE ' ' || text END"
for _name, _spec, _sql in (
    ("q_decode_metaspace", fixtures.metaspace_spec(), f"substr({_SPACED}, 2)"),
    ("q_decode_sequence", fixtures.metaspace_spec(fixtures.STEPS), f"replace({_SPACED}, 'e', 'E')"),
    ("q_decode_suffix", fixtures.suffix_spec(), f"array_to_string(regexp_extract_all(text, '[^{SPACE}]+'), ' ')"),
):
    QUERIES[_name], SQL[_name] = _decoded(_spec), f"SELECT doc_id, md5({_sql}) AS digest FROM documents"


@query("SELECT lang || '/' || source AS repo, CAST(0 AS INTEGER) AS ordinal, 'data/train-' || count(*) || '.parquet' AS name, CAST(sum(n_chars) AS BIGINT) AS size, CAST(135 AS BIGINT) AS pointer_size FROM documents GROUP BY lang, source")
def q_hub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata documents of repositories, made from the catalog, to their files."""
    groups = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))
    sibling = F.struct(F.concat(F.lit("data/train-"), F.col("n").cast("string"), F.lit(".parquet")).alias("rfilename"), F.col("size"), F.struct(F.lit("s").alias("sha256"), F.col("size"), F.lit(135).alias("pointerSize")).alias("lfs"))
    documents = groups.select(F.to_json(F.struct(F.concat_ws("/", "lang", "source").alias("id"), F.array(sibling).alias("siblings"))).alias("value"))
    return hub.files(hub.repo_infos(documents), strict=True).select("repo", "ordinal", "name", "size", F.col("lfs.pointer_size").alias("pointer_size"))


@query("SELECT doc_id, 'c' || doc_id AS commit, CASE WHEN doc_id % 2 = 0 THEN 'linked' ELSE 'plain' END AS etag, 'http://u' AS location, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 5 END AS size FROM documents")
def q_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked, sized = F.when(F.col("doc_id") % 2 == 0, '"linked"').otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).otherwise("")
    headers = F.create_map(F.lit("x-repo-commit"), F.concat(F.lit("c"), F.col("doc_id").cast("string")), F.lit("etag"), F.lit('"plain"'), F.lit("x-linked-etag"), linked, F.lit("x-linked-size"), sized)
    meta = hub.file_metadata(headers, F.lit("http://u"), F.lit(5).cast("long"))
    return read(spark, sf_dir, "documents").select("doc_id", meta.alias("m")).select("doc_id", "m.*")


@query("SELECT * FROM (VALUES ('doc_id', 'DocID', 'INT64', 'bigint', false), ('text', 'Text', 'BYTE_ARRAY', 'string', false), ('lang', 'Lang', 'BYTE_ARRAY', 'string', false), ('source', 'Source', 'BYTE_ARRAY', 'string', false), ('n_chars', 'NChars', 'INT64', 'bigint', false)) t(path, name, physical_type, spark_type, repeated)")
def q_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.report(spark, read(spark, sf_dir, "documents").schema)
