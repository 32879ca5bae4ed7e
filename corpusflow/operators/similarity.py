"""Similarity of queries and documents: all pairs within blocks of a checked size, and the best of each query."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import MEASURES

#: Queries, and bytes of their vectors, that are broadcast at most; beyond, they come in as many blocks.
BLOCK, BLOCK_BYTES = 10_000, 64 << 20
#: Pairs scored at a time, and pairs of a task: where there are more, the documents are dealt out anew.
TILE, SHARE = 1 << 15, 1 << 21


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As round() of a column: halves of the shortest decimal form away from zero, no negative zero."""
    with np.errstate(all="ignore"):
        y = x * 10.0**digits
        near = np.rint(y)
        out = near / 10.0**digits + 0.0
        # What the product's own error may carry over a half, or out of range, is rounded as a decimal.
        open_ = np.isfinite(x) & ~(np.abs(np.abs(y - near) - 0.5) > np.abs(y) * 2.0**-50)
    unit, wide = Decimal(1).scaleb(-digits), Context(prec=400)
    out[open_] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP, wide)) + 0.0 for v in x[open_].tolist()]
    return out


def _widths(vectors: pa.Array) -> set[int]:
    return set(pc.unique(pc.list_value_length(vectors).drop_null()).to_pylist())


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each vector, and where neither it nor a component is null; vectors that aren't null have `width` components."""
    known, values = vectors.is_valid().to_numpy(zero_copy_only=False), vectors.flatten()
    x = np.zeros((len(vectors), width))
    x[known] = values.to_numpy(zero_copy_only=False).reshape(known.sum(), width)
    if values.null_count:
        known[known] = ~values.is_null().to_numpy(zero_copy_only=False).reshape(known.sum(), width).any(1)
    return x, known


def _norms(x: np.ndarray, least: float = 1e-12) -> np.ndarray:
    out = np.zeros(len(x))
    for c in x.T:
        out += c * c
    return np.maximum(np.sqrt(out), least)


def _scores(measure: str, d: np.ndarray, q: np.ndarray, norms: np.ndarray, sums: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The score of each row of d and column of q. Terms of components are added one after the other, as the column expressions add them, to the same bits.

    norms has the product of the norms, sums and step are room for as many values.
    """
    sums[:] = 0
    for x, y in zip(d.T, q, strict=True):
        if measure in ("euclidean", "manhattan"):
            np.subtract(x[:, None], y, out=step)
            np.abs(step, out=step) if measure == "manhattan" else np.multiply(step, step, out=step)
        else:
            np.multiply(x[:, None], y, out=step)
        sums += step
    return sums.copy() if measure == "dot" else -sums if measure == "manhattan" else -np.sqrt(sums) if measure == "euclidean" else sums / norms


def _score(batches: Iterator[pa.RecordBatch], queries: pa.Table, measure: str, digits: int | None) -> Iterator[pa.RecordBatch]:
    """Every document of the batches with every query, document after document, at most TILE pairs (or one document) a batch."""
    ids, asked, n = queries.column(0).combine_chunks(), queries.column(1).combine_chunks(), queries.num_rows
    if not n:
        return
    widths, many = _widths(asked), max(1, TILE // n)
    tiled, room = ids.take(pa.array(np.tile(np.arange(n), many))), (np.empty((many, n)), np.empty((many, n)))
    q, some = _matrix(asked, *widths) if len(widths) == 1 else (np.zeros((n, 0)), np.zeros(n, bool))
    with np.errstate(all="ignore"):
        q, q_norms = np.ascontiguousarray(q.T), _norms(q)
        for b in batches:
            own = _widths(b.column(1))
            if widths and own and len(both := sorted(widths | own)) > 1:
                raise ValueError(f"vectors of {both[0]} and {both[-1]} components")
            d, known = _matrix(b.column(1), len(q)) if widths and own else (np.zeros((b.num_rows, len(q))), np.zeros(b.num_rows, bool))
            d_norms = _norms(d)
            for a in range(0, len(d), many):
                part, here = d[a : a + many], known[a : a + many]
                x = _scores(measure, part, q, d_norms[a : a + many, None] * q_norms, *(r[: len(part)] for r in room)).ravel()
                x = x if digits is None else rounded(x, digits)
                void = None if some.all() and here.all() else ~(here[:, None] & some).ravel()
                documents = b.column(0).take(pa.array(np.repeat(np.arange(a, a + len(part)), n)))
                yield pa.RecordBatch.from_arrays([tiled.slice(0, len(x)), documents, pa.array(x, mask=void)], names=["query_id", "doc_id", "score"])


def pairs(
    queries: DataFrame, documents: DataFrame, measure: str = "cosine", query: tuple[str, str] = ("query_id", "vector"), document: tuple[str, str] = ("doc_id", "vector"), block: int = BLOCK, digits: int | None = None
) -> DataFrame:
    """(query_id, doc_id, score) of every query and document, as a similarity matrix has them; score to `digits` as round() has it, if given.

    The queries are broadcast, or, if there are more than `block` or their vectors are larger than BLOCK_BYTES, dealt to
    blocks within both, each broadcast in its turn, and scored in tiles by Arrow functions. Documents are counted, and, where
    the pairs are more than SHARE, dealt out anew: a file of few row groups is few tasks, however many pairs it makes.
    The score of a null vector or component is null; vectors of other lengths are an error.
    """
    spark, sc = documents.sparkSession, documents.sparkSession.sparkContext
    measure = (measure or "").lower()
    measure = "dot" if measure == "dot_product" else measure if measure in MEASURES else "cosine"
    q = queries.select(F.col(query[0]).alias("query_id"), F.col(query[1]).cast("array<double>").alias("__q"))
    d = documents.select(F.col(document[0]).alias("doc_id"), F.col(document[1]).alias("__d"))
    count, width = q.agg(F.count("*"), F.coalesce(F.max(F.size("__q")), F.lit(0))).first()
    blocks = -(-count // max(1, min(block, BLOCK_BYTES // (8 * max(1, width) + 64)))) or 1
    parts = [q] if blocks == 1 else [q.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)) == i) for i in range(2 * blocks)]
    if (shares := -(-count * d.count() // (SHARE * len(parts)))) > 1:
        d = d.repartition(max(shares, 2 * sc.defaultParallelism))
    d = d.select("doc_id", F.col("__d").cast("array<double>").alias("__d"))
    schema, out = StructType([q.schema["query_id"], d.schema["doc_id"], StructField("score", DoubleType())]), None
    for p in parts:
        shared = sc.broadcast(p.toArrow())
        met = d.mapInArrow(lambda batches, shared=shared: _score(batches, shared.value, measure, digits), schema)
        out = met if out is None else out.union(met)
    return out


def top_k(scored: DataFrame, k: int, key: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each key with their rank from 1; ties to the smaller item."""
    rank = F.expr(f"row_number() over (partition by {key} order by {score} desc, {item})")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
