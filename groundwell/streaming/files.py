"""Continuous ingest of files: stored points, and a table of the files that were refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundwell.functions.vectors import Embedder
from groundwell.operators.index import Collection
from groundwell.plans.ingest import points_of_files
from groundwell.settings import Settings
from groundwell.sources.files import normal_path, split_documents

_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
_REJECT_SCHEMA = "path STRING, reason STRING, batch BIGINT"


def file_stream(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of the files below ``folder``, each as ``path, content`` once it appears.

    A file must appear whole (be moved into place); a changed file under an old name is not read
    again. Names that begin with ``.`` or ``_`` are skipped.
    """
    reader = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
    reader = reader.option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(normal_path(F.col("path")).alias("path"), "content")


def ingest_file_stream(
    files: DataFrame,
    collection: Collection,
    rejects: str,
    embed: Embedder,
    checkpoint: str,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
    pdf_pages: Callable[[Column], Column] | None = None,
    first_batch: int = 0,
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Store a stream of files (``path, content``) and the refused ones, batch by batch.

    Both sinks of a micro-batch are written under its number, the rejects first: a batch that is
    run again after a failure between the two replaces both. ``first_batch`` shifts the numbers
    past those already in the collection. Rejects are read by :func:`read_rejects`.
    """

    def store(batch: DataFrame, number: int) -> None:
        documents, rejected = split_documents(batch, pdf_pages)
        rejected.write.mode("overwrite").parquet(f"{rejects}/batch={first_batch + number}")
        points = points_of_files(documents, embed, chunk_size, chunk_overlap)
        # A path occurs once in a stream, so its points are unique.
        collection.write_batch(first_batch + number, points, unique=True)

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """``path, reason, batch`` of all files refused so far."""
    path = spark._jvm.org.apache.hadoop.fs.Path(rejects)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _REJECT_SCHEMA)
    return spark.read.schema(_REJECT_SCHEMA).parquet(rejects)
