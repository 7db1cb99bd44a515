"""Health figures of an index from sketches that are kept beside each batch.

A batch leaves one row: counters, a theta sketch of its ids and quantile sketches of the norms of
its vectors and the lengths of its texts. Reading merges these rows, so that an audit costs as much
as there are batches and no stored point is read again. Counters are exact; distinct ids and
quantiles are estimates, within ``ID_ERROR`` of the number and ``RANK_ERROR`` of the rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.vectors import norm

#: Entries of a theta sketch, as a power of two: a relative standard error of 0.8 %.
ID_BITS = 14
#: About three standard errors of the estimated number of ids.
ID_ERROR = 0.025
#: Size of a quantile sketch and its error of a rank, as a share of all rows.
QUANTILE_SIZE = 400
RANK_ERROR = 0.02

COUNTERS = ("n_points", "n_wrong_width", "n_not_unit", "n_without_text")


def sketch(
    points: DataFrame, dimension: int, key: str = "chunk_id", vector: str = "vector",
    text: str = "chunk_text", tolerance: float = 1e-3,
) -> DataFrame:
    """One row for all of ``points``: counters and sketches.

    Tasks sketch what they hold and only sketches travel, so that hot ids cost nothing. Null ids
    are one id more, counted by ``n_null_ids``; null vectors have a wrong width and no norm, null
    texts no length. An empty table gives a row of zeros and empty sketches.
    """
    length = norm(F.col(vector))
    # A null vector has no norm; a norm beyond numbers would spoil a sketch.
    finite = F.when(~F.isnan(length) & (F.abs(length) < F.lit(float("inf"))), length)
    return points.agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dimension).alias("n_wrong_width"),
        F.count_if(F.coalesce(F.abs(length - 1) > tolerance, F.lit(True))).alias("n_not_unit"),
        F.count_if(F.coalesce(text, F.lit("")) == "").alias("n_without_text"),
        F.count_if(F.col(key).isNull()).alias("n_null_ids"),
        F.theta_sketch_agg(F.col(key).cast("string"), ID_BITS).alias("ids"),
        F.kll_sketch_agg_double(finite.cast("double"), QUANTILE_SIZE).alias("norms"),
        F.kll_sketch_agg_bigint(F.length(text).cast("long"), QUANTILE_SIZE).alias("lengths"),
    )


def merge(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of :func:`sketch` made one, or one for each of ``keys``: a row like them again, so
    that old batches can be folded and merged later."""
    return sketches.groupBy(*(keys or [])).agg(
        *(
            F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
            for c in (*COUNTERS, "n_null_ids")
        ),
        F.theta_union_agg("ids", ID_BITS).alias("ids"),
        F.kll_merge_agg_double("norms", QUANTILE_SIZE).alias("norms"),
        F.kll_merge_agg_bigint("lengths", QUANTILE_SIZE).alias("lengths"),
    )


def figures(merged: DataFrame, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """The counters, ``n_ids``, and ``norms`` and ``lengths`` at the given shares (null where no
    row has one) of rows of :func:`merge`; other columns, such as its keys, stay."""
    at = F.array(*(F.lit(float(share)) for share in shares))

    def quantiles(column: str, kind: str, of: str) -> F.Column:
        size = F.expr(f"kll_sketch_get_n_{kind}({column})")
        return F.when(size > 0, getattr(F, f"kll_sketch_get_quantile_{kind}")(column, at)).alias(of)

    keys = [c for c in merged.columns if c not in {*COUNTERS, "n_null_ids", "ids", "norms", "lengths"}]
    nulls = (F.col("n_null_ids") > 0).cast("long")
    return merged.select(
        *keys,
        *COUNTERS,
        (F.theta_sketch_estimate("ids") + nulls).alias("n_ids"),
        quantiles("norms", "double", "norms"),
        quantiles("lengths", "bigint", "lengths"),
    )


@dataclass(frozen=True)
class BatchSketches:
    """Sketches below ``root``, a row per batch. A replayed batch replaces its own row."""

    spark: SparkSession
    root: str
    dimension: int

    def write(self, batch: int, points: DataFrame) -> None:
        sketch(points, self.dimension).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/batch={int(batch)}"
        )

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.root)

    def audit(self, batches: list[int] | None = None) -> DataFrame:
        """Figures over all batches, or the given ones. An id of several batches counts once;
        the counters and quantiles count its rows."""
        rows = self.rows()
        if batches is not None:
            rows = rows.where(F.col("batch").isin(batches))
        return figures(merge(rows))
