"""Vectors kept by content: each distinct text is embedded once, over all batches.

A store is a folder of Parquet batches with a row per text that was embedded. A text is known by
its SHA-256 and length; the model is part of the folder. A batch of texts is joined against what
is known before the model runs, what is new is embedded and written back under the batch number,
and a replayed batch replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.vectors import Embedder
from groundwell.operators.sizes import broadcast_if_small

_SCHEMA = "digest BINARY, length INT, vector ARRAY<FLOAT>, batch BIGINT"
_KEY = ["digest", "length"]


def text_key(text: Column) -> tuple[Column, Column]:
    """What tells a text: 32 bytes of digest and its length in bytes. Null is the empty text."""
    filled = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(filled, 256)).alias("digest"), F.octet_length(filled).alias("length")


@dataclass(frozen=True)
class EmbeddingStore:
    """Stored vectors of one model below ``root``."""

    spark: SparkSession
    root: str
    model: str
    embed: Embedder

    @property
    def folder(self) -> str:
        return f"{self.root}/model={self.model}"

    def known(self, before: int | None = None) -> DataFrame:
        """``digest, length, vector, batch`` of all texts embedded, or of batches below one."""
        paths = [
            f"{self.folder}/batch={batch}"
            for batch in self.batches()
            if before is None or batch < before
        ]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        # Batches are named one by one: Spark takes two reads of one folder for the same table,
        # even if a batch came between them.
        return self.spark.read.schema(_SCHEMA).option("basePath", self.folder).parquet(*paths)

    def batches(self) -> list[int]:
        """The numbers of the batches written so far, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [status.getPath().getName() for status in system.listStatus(path)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def add(self, batch: int, rows: DataFrame, text: str = "text") -> DataFrame:
        """Embed the texts of ``rows`` that no earlier batch has, and return them with their
        number: ``digest, length, vector``.

        Copies are folded before the join, and only keys meet: stored vectors do not move. Batches
        are numbered in the order they come.
        """
        digest, length = text_key(F.col(text))
        distinct = rows.select(digest, length, F.coalesce(text, F.lit("")).alias("text"))
        distinct = distinct.groupBy(*_KEY).agg(F.any_value("text").alias("text"))
        earlier = self.known(before=batch).select(*_KEY)
        fresh = distinct.join(earlier, _KEY, "left_anti")
        target = f"{self.folder}/batch={batch}"
        fresh.select(*_KEY, self.embed(F.col("text")).alias("vector")).write.mode(
            "overwrite"
        ).parquet(target)
        return self.spark.read.schema("digest BINARY, length INT, vector ARRAY<FLOAT>").parquet(target)

    def with_vectors(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with the ``vector`` of their text; null where it was never added.

        Keys of the rows are folded first, so that a text that a third of them share is looked up
        once; the vectors found are sent to the rows while they are few.
        """
        digest, length = text_key(F.col(text))
        keyed = rows.select("*", digest.alias("__digest"), length.alias("__length"))
        asked = keyed.select(F.col("__digest").alias("digest"), F.col("__length").alias("length"))
        found = self.known().join(asked.distinct(), _KEY).select(*_KEY, "vector")
        found = found.withColumnsRenamed({"digest": "__digest", "length": "__length"})
        return keyed.join(broadcast_if_small(found), ["__digest", "__length"], "left").select(
            *rows.columns, "vector"
        )
