"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.paths import as_col


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in doubles; 0 for unequal lengths and for a zero vector."""
    a, b = as_col(a).cast("array<double>"), as_col(b).cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    ratio = dot / F.nullif(_norm(a) * _norm(b), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), F.coalesce(ratio, F.lit(0.0))).otherwise(0.0)
