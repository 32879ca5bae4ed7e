"""The corpus pipeline: toxic documents go, recurring lines go, one document of each near-duplicate group stays, sources are
mixed to their weights, and the rest becomes token ids. Each stage is written as Parquet and read again as the next one's
docs, so a lost executor costs one stage at most; a stage's files go when the next one's are there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import bpe, line_dedup, mixing, shingles, toxicity
from corpusflow.llm.common import remove, shared_dir, table
from corpusflow.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those judged toxic by a model fitted to the labelled rows of docs."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with recurring lines taken out of their text; n_chars is that of the new text."""
    return line_dedup.deduped_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id: SimHash balls and MinHash bands find the candidates, a similarity of five-word shingles of 0.8 or more links."""
    return shingles.one_of_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]
#: Regression, balanced sampling and BPE have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpusflow/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
