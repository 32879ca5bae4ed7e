"""Vectors as arrays: similarities, norms and pooling, in double precision column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _paired(a: Column, b: Column, fn) -> Column:
    """fn over the pairs of components; vectors of other lengths are an error."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("vectors of "), F.size(a), F.lit(" and "), F.size(b), F.lit(" components"))).cast("array<double>"))
    return same.otherwise(F.zip_with(a, b, fn))


def dot(a: Column, b: Column) -> Column:
    return _sum(_paired(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: x * x)))


def l2_normalize(a: Column, least: float = 1e-12) -> Column:
    """Over the norm, or over `least` where that is larger. The norm is worked out once, not for each component."""
    a = a.cast("array<double>")
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.transform(a, lambda x: x / F.greatest(F.sqrt(s), F.lit(least))))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(least)) * F.greatest(norm(b), F.lit(least)))


def euclidean(a: Column, b: Column) -> Column:
    """The negative distance, so that more is nearer."""
    return -F.sqrt(_sum(_paired(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    """The negative distance, so that more is nearer."""
    return -_sum(_paired(a, b, lambda x, y: F.abs(x - y)))


MEASURES = {"cosine": cosine, "dot": dot, "dot_product": dot, "euclidean": euclidean, "manhattan": manhattan}


def similarity(name: str | None, a: Column, b: Column) -> Column:
    """By name, in any case; other names are cosine."""
    return MEASURES.get((name or "").lower(), cosine)(a, b)


def seq_len(ids: Column, pad: int) -> Column:
    return F.size(F.filter(ids, lambda x: x != pad))


def mean_pool(hidden: Column, length: Column | None = None) -> Column:
    """The mean of hidden's rows (array of arrays), of the first `length` only if given. No rows: null."""
    rows = F.slice(hidden, F.lit(1), length) if length is not None else hidden
    rows = rows.cast("array<array<double>>")
    total = F.aggregate(F.slice(rows, 2, 1 << 30), F.element_at(rows, 1), lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    return F.when(F.size(rows) > 0, F.transform(total, lambda x: x / F.size(rows)))


def last_pool(hidden: Column, length: Column | None = None) -> Column:
    """Row `length`, the last one if not given."""
    return F.try_element_at(hidden, length if length is not None else F.size(hidden))


def cls_pool(hidden: Column) -> Column:
    return F.try_element_at(hidden, F.lit(1))


def pool(hidden: Column, length: Column | None = None, *, last: bool = False, mean: bool = False, cls: bool = False, maximum: bool = False) -> Column:
    """One of the modes that are on: last before mean before cls. Maximum alone, or none, is an error."""
    if last:
        return last_pool(hidden, length)
    if mean:
        return mean_pool(hidden, length)
    if cls:
        return cls_pool(hidden)
    raise ValueError("max pooling isn't supported" if maximum else "no pooling mode is on")


def num_elements(dims: Column) -> Column:
    """The product of the dimensions; 0 without dimensions."""
    return F.when(F.size(dims) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(dims.cast("array<bigint>"), F.lit(1).cast("long"), lambda s, x: s * x))
