"""The given Parquet tables in the shapes the operators take. Every loader reads whole tables
and only the columns it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Below this many bytes per core Spark makes fewer splits than there are cores.
SPREAD_BYTES = 4 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on.

    One that is too small for a split per core, by its size on disk, is dealt out to all
    cores; any other is read in its own splits, without a shuffle.
    """
    frame = table(spark, folder, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    cores = spark.sparkContext.defaultParallelism
    if system.getContentSummary(path).getLength() < cores * SPREAD_BYTES:
        return frame.repartition(cores)
    return frame


def documents(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """``document_id, text, metadata, lang, source``; ``spread`` for work on every token."""
    read = spread_table if spread else table
    return read(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        "text",
        F.create_map(
            F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")
        ).alias("metadata"),
        "lang",
        "source",
    )


def conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as paged documents, one turn a page."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"),
        F.col("turn").alias("page_no"),
        F.col("text").alias("page_text"),
    )


def vector_points(spark: SparkSession, folder: str) -> DataFrame:
    """``chunk_id, vector, chunk_text, metadata`` of the embeddings, with their label.

    Odd labels have no text, so that its default shows.
    """
    label = F.col("label").cast("string")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("embedding").alias("vector"),
        F.when(F.col("label") % 2 == 0, F.concat(F.lit("label "), label)).alias("chunk_text"),
        F.create_map(F.lit("label"), label).alias("metadata"),
    )


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a query: ``query_id, vector, label``."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"
    )


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as questions: ``query_id, query``."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def neighbour_turns(spark: SparkSession, folder: str, *distances: int) -> DataFrame:
    """Turns with the texts at the given distances in ``near`` (null where there is none).

    Every text is dealt to the turns that are near it, and these meet in one aggregate by
    (conversation, turn), which is unique, so a long conversation is no hot key.
    """
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    places = [
        F.struct(
            (F.col("turn") - distance).alias("turn"), F.lit(slot).alias("slot"), "role", "text"
        )
        for slot, distance in enumerate((0, *distances))
    ]
    dealt = turns.select("conv_id", F.inline(F.array(*places)))
    said = lambda slot, name: F.max(F.when(F.col("slot") == slot, F.col(name)))
    return (
        dealt.groupBy("conv_id", "turn")
        .agg(
            F.bool_or(F.col("slot") == 0).alias("own"),
            said(0, "role").alias("role"),
            said(0, "text").alias("text"),
            *(said(i + 1, "text").alias(f"__{i}") for i in range(len(distances))),
        )
        .where("own")
        .select(
            "conv_id", "turn", "role", "text",
            F.array(*(f"__{i}" for i in range(len(distances)))).alias("near"),
        )
    )


def dialogue_samples(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as evaluation samples: the reply is the answer, the turns before and after
    the exchange are its contexts, and the reply after that is the ground truth."""
    near = F.col("near")
    return (
        neighbour_turns(spark, folder, 1, -1, 2, 3)
        .where(F.col("role") == "user")
        .select(
            F.concat_ws(":", "conv_id", "turn").alias("sample_id"),
            F.col("text").alias("question"),
            near[0].alias("answer"),
            F.array_compact(F.array(near[1], near[2])).alias("contexts"),
            near[3].alias("ground_truth"),
        )
    )
