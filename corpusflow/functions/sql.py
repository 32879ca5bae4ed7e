"""The library's functions by name in SQL: expressions as SQL functions, tokenizers as Arrow functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

_SUM = "aggregate({}, 0D, (s, x) -> s + x)"
_DOT, _NORM = _SUM.format("zip_with(a, b, (x, y) -> x * y)"), "sqrt(" + _SUM.format("transform({0}, x -> x * x)") + ")"
_TOP = "shiftleft(1L, length(bin(n)) - 1)"
_VECTORS = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
#: name, parameters, result, body.
FUNCTIONS = [
    ("two_bit_bucket_len", "n BIGINT", "BIGINT", f"CASE WHEN n <= 2 THEN n WHEN n = {_TOP} THEN n WHEN n <= {_TOP} + {_TOP} div 2 THEN {_TOP} + {_TOP} div 2 ELSE 2 * {_TOP} END"),
    ("dot_similarity", _VECTORS, "DOUBLE", _DOT),
    ("cosine_similarity", _VECTORS, "DOUBLE", f"{_DOT} / (greatest({_NORM.format('a')}, 1e-12D) * greatest({_NORM.format('b')}, 1e-12D))"),
    ("euclidean_similarity", _VECTORS, "DOUBLE", "-sqrt(" + _SUM.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))") + ")"),
    ("manhattan_similarity", _VECTORS, "DOUBLE", "-" + _SUM.format("zip_with(a, b, (x, y) -> abs(x - y))")),
    ("l2_normalize", "a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "aggregate(a, 0D, (s, x) -> s + x * x, s -> transform(a, v -> v / greatest(sqrt(s), 1e-12D)))"),
    ("pad_row", "ids ARRAY<INT>, seq_len INT, pad INT", "ARRAY<INT>", "concat(slice(ids, 1, seq_len), array_repeat(pad, greatest(seq_len - size(ids), 0)))"),
]


def register(spark: SparkSession, **tokenizers: Any) -> None:
    """Makes FUNCTIONS temporary functions of the session, and <name>_encode and <name>_decode of each tokenizer given."""
    from ..operators.tokenizer.frames import register_sql

    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, tokenizer in tokenizers.items():
        register_sql(spark, name, tokenizer)
