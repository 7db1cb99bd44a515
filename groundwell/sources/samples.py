"""Evaluation samples as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.settings import shared_folder

SAMPLE_SCHEMA = (
    "question STRING, answer STRING, contexts ARRAY<STRING>, ground_truth STRING"
)


def read_samples(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """One object per line; blank lines are skipped, and a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Overwrite ``path``. Null fields are written, and text is not escaped to ASCII."""
    samples.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def with_sample_ids(samples: DataFrame) -> DataFrame:
    """Add ``sample_id``. The ids are fixed by a checkpoint, as equal questions may repeat and
    ids computed twice need not agree."""
    shared_folder(samples.sparkSession)
    return samples.withColumn("sample_id", F.monotonically_increasing_id()).checkpoint()
