"""Run parameters and metrics as an append-only long table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id STRING, run_name STRING, kind STRING, key STRING, value STRING, step BIGINT"
)


def param_rows(
    spark: SparkSession, run_id: str, run_name: str, params: Mapping[str, object]
) -> DataFrame:
    """One row per parameter of a run."""
    rows = [(run_id, run_name, "param", k, str(v), None) for k, v in params.items()]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def metric_rows(
    metrics: DataFrame, run_id: str, run_name: str, step: int | None = None
) -> DataFrame:
    """One row per ``metric, value`` that is a number; NaN is not logged."""
    return metrics.where(~F.isnan("value")).select(
        F.lit(run_id).alias("run_id"),
        F.lit(run_name).alias("run_name"),
        F.lit("metric").alias("kind"),
        F.col("metric").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.lit(step).cast("long").alias("step"),
    )


def append_run(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)
