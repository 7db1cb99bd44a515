"""Running sums over groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    into: str,
    total: str | None = None,
    block: int = 4096,
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over rows of the group up to and with ``position``.

    A plain window puts a whole group into one task. Here positions are cut in blocks of
    ``block``; block sums are taken before the shuffle, and only they meet in one task per
    group. ``position`` must be an integer, unique in its group. ``total`` names a further
    column for the sum of the whole group. Null keys are a group.
    """
    part = f"__{into}_block"
    parted = df.withColumn(part, F.floor(F.col(position) / block))
    group = Window.partitionBy(*keys)
    before = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    extra = [] if total is None else [F.sum("__sum").over(group).alias(total)]
    offsets = (
        parted.groupBy(*keys, part)
        .agg(F.sum(value).alias("__sum"))
        .select(*keys, part, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"),
                *extra)
    )
    inside = (
        Window.partitionBy(*keys, part)
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    theirs = [*keys, part]
    renamed = offsets.select(
        *(F.col(k).alias(f"__of_{i}") for i, k in enumerate(theirs)), "__offset",
        *([total] if total else []),
    )
    same = F.lit(True)
    for i, k in enumerate(theirs):
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{i}"))
    return (
        parted.join(renamed, same)
        .withColumn(into, F.sum(value).over(inside) + F.col("__offset"))
        .drop(part, "__offset", *(f"__of_{i}" for i in range(len(theirs))))
    )
