"""Declared schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        *[T.StructField(c, T.StringType()) for c in ("event_type", "product_id", "category_id", "category_code", "brand")],
        T.StructField("price", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in ("user_id", "user_session")],
    ]
)
INTERVAL = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("price", T.DecimalType(12, 2)),
        T.StructField("effective_start", T.TimestampType()),
        T.StructField("effective_end", T.TimestampType()),
        T.StructField("change_reason", T.StringType()),
        T.StructField("pct_change", T.DoubleType()),
    ]
)
RESCUED = "_rescued_data"


def with_rescued(schema: T.StructType) -> T.StructType:
    """The schema with a column for what a row held beyond it."""
    return T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])
