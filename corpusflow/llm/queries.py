"""The queries opN_<name> and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, gif, langid, licenses, line_dedup, mixing, simhash, tokenfile, toxicity
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.stored_digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_toxicity, op4_langid, op5_ann, op6_gif, op7_simhash, op8_tokenfile, op9_licenses, op10_bpe)}

SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, no, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM lines),
leaved AS (SELECT doc_id, no, w, len(w) AS n, w[1:3] AS lead FROM worded WHERE len(w) > 0),
wide AS (SELECT n, lead, count(*) AS total FROM leaved WHERE n > 3 GROUP BY n, lead HAVING count(DISTINCT w) > 1 AND count(*) >= 3),
placed AS (SELECT n, lead, w, total, unnest(w[4:]) AS token, unnest(range(3, n)) AS pos FROM leaved JOIN wide USING (n, lead)),
fixed AS (SELECT n, lead, pos, token FROM placed GROUP BY n, lead, pos, token, total HAVING 2 * count(*) > total),
members AS (SELECT w, n FROM (SELECT DISTINCT n, lead, w, pos, token FROM placed) LEFT JOIN (SELECT *, 1 AS hit FROM fixed) USING (n, lead, pos, token) GROUP BY w, n HAVING 3 + count(hit) >= n * CAST(0.7 AS DOUBLE)),
named AS (SELECT doc_id, no, CASE WHEN m.w IS NULL THEN [0] ELSE [1, l.n] END AS kind, CASE WHEN m.w IS NULL THEN l.w ELSE l.lead END AS template, l.n FROM leaved l LEFT JOIN members m ON l.w = m.w),
recurring AS (SELECT kind, template, min(struct_pack(doc_id := doc_id, no := no)) AS first FROM named GROUP BY kind, template HAVING count(DISTINCT doc_id) >= CASE WHEN max(n) >= 10 THEN 2 ELSE 3 END),
gone AS (SELECT doc_id, no FROM named JOIN recurring USING (kind, template) WHERE struct_pack(doc_id := doc_id, no := no) <> first),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_dropped, string_agg(CASE WHEN g.no IS NULL THEN line END, chr(10) ORDER BY l.no) AS left_over FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_over, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
}
