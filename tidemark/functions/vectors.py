"""Vector and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if an array or a component is null or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def json_long(text: Column, path: str) -> Column:
    """An integer of a JSON text, null where it isn't there, no integer, or the text is malformed."""
    return F.try_variant_get(F.try_parse_json(text), path, "bigint")


def ln(x: Column) -> Column:
    """The natural logarithm as IEEE 754 and DuckDB have it: minus infinity for zero and NaN for less, where Spark's is null."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))
