"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes and rows of a side that may be sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 500_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: its values, and some for the row itself."""

    def width(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(column)
        if isinstance(kind, T.ArrayType) and not isinstance(
            kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
        ):
            return F.size(column) * 8
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(column)))
        return F.lit(8)

    total = F.lit(32).cast("long")
    for field in df.schema.fields:
        total = total + F.coalesce(width(df[field.name], field.dataType).cast("long"), F.lit(0))
    return total


def is_small(
    side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether ``side`` stays below both bounds. Only partial sums leave the tasks."""
    rows, size = side.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(side)), F.lit(0))
    ).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(
    side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``side`` with a broadcast hint when it stays below both bounds.

    Without the hint the planner, not knowing the size of a derived table, would shuffle the
    other side before it learns better. A larger side joins as the planner sees fit.
    """
    return F.broadcast(side) if is_small(side, max_rows, max_bytes) else side
