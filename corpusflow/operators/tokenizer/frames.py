"""Tokenizers on columns: over Arrow batches, one tokenizer a worker, each different word once."""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODING = "struct<ids:array<int>,spans:array<struct<start:int,end:int>>,special_tokens_mask:array<int>>"


#: Of each tokenizer that is still in use, its broadcast and the application that has it.
_SHARED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _shared(tokenizer: Any) -> Broadcast:
    """Sent to the workers once, however many columns use it; the context drops it when none does any more."""
    context = SparkSession.getActiveSession().sparkContext
    app, held = _SHARED.get(tokenizer, (None, None))
    if app != context.applicationId:
        _SHARED[tokenizer] = context.applicationId, (held := context.broadcast(tokenizer))
    return held


def encode_ids_column(tokenizer: Any, text: Column) -> Column:
    """array<int>; a null text is null."""
    shared = _shared(tokenizer)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = shared.value
        for texts in batches:
            yield pd.Series([None if x is None else t.encode(x) for x in texts], dtype=object)

    return run(text)


def encode_column(tokenizer: Any, text: Column) -> Column:
    """Ids with spans and mask as the tokenizer's options ask for them; what isn't asked for is null."""
    shared = _shared(tokenizer)

    @F.pandas_udf(ENCODING)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for texts in batches:
            found = [None if x is None else t.annotate(x) for x in texts]
            spans = [None if e is None or e.spans is None else [{"start": a, "end": b} for a, b in e.spans] for e in found]
            yield pd.DataFrame({"ids": [None if e is None else e.ids for e in found], "spans": spans, "special_tokens_mask": [None if e is None else e.special_tokens_mask for e in found]})

    return run(text)


def decode_column(tokenizer: Any, ids: Column) -> Column:
    shared = _shared(tokenizer)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = shared.value
        for rows in batches:
            yield pd.Series([None if x is None else t.decode([int(i) for i in x]) for x in rows], dtype=object)

    return run(ids)


def normalize_column(tokenizer: Any, text: Column) -> Column:
    shared = _shared(tokenizer)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        t = shared.value
        return texts.map(lambda x: None if x is None else t.normalize(x))

    return run(text)


def vocabulary_frame(spark: SparkSession, tokenizer: Any) -> DataFrame:
    """(token, id, is_added, is_special), ordered by id."""
    rows = [(t, i, t in tokenizer.added, t in tokenizer.special) for t, i in (tokenizer.vocab | tokenizer.added).items()]
    return spark.createDataFrame(rows, "token string, id int, is_added boolean, is_special boolean").orderBy("id", "token")


def tokens_table(df: DataFrame, tokenizer: Any, key: str, text: str) -> DataFrame:
    """(key, at, id, start, end): one row a token."""
    found = df.select(F.col(key), encode_column(tokenizer, F.col(text)).alias("e"))
    return found.select(key, F.posexplode(F.arrays_zip(F.col("e.ids").alias("id"), F.col("e.spans").alias("span"))).alias("at", "t")).select(key, "at", "t.id", "t.span.start", "t.span.end")


def register_sql(spark: SparkSession, name: str, tokenizer: Any) -> None:
    """SQL functions <name>_encode(text) and <name>_decode(ids)."""
    shared = _shared(tokenizer)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.encode(x) for x in texts], dtype=object)

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode([int(i) for i in x]) for x in rows], dtype=object)

    spark.udf.register(f"{name}_encode", encode)
    spark.udf.register(f"{name}_decode", decode)
