"""Rows as JSON text and back, snake_case keys, nulls kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_rows(df: DataFrame, key: str) -> DataFrame:
    """``key, value``: the whole row as one JSON object."""
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"),
    )


def decode_rows(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Rows of ``schema``; null arrays come back as empty arrays."""
    row = F.from_json(F.col(value), schema)
    return df.select(row.alias("__row")).select(
        *[
            F.coalesce(F.col("__row")[f.name], F.array().cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col("__row")[f.name].alias(f.name)
            for f in schema.fields
        ]
    )
