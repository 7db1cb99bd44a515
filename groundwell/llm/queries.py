"""One named query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm import (
    alignment,
    bytespans,
    chat,
    decontamination,
    licenses,
    neighbours,
    packing,
    quality,
    simhash,
    spelling,
    substrings,
    toxicity,
    warc,
)
from groundwell.plans.tables import table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = points.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return neighbours.nearest(points, asked)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ratings = table(spark, folder, "labels").select(
        "doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade")
    )
    # One fold in four is kept out of the fit, to be measured on.
    held_out = toxicity.fold(F.col("doc_id")) == 2
    model = quality.fit(docs, ratings.where(~held_out))
    return quality.rate(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "expected_grade",
        F.col("tails")[0].alias("p_grade_1"),
        F.get("tails", F.lit(1)).alias("p_grade_2"),
        "selected",
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "fingerprint", "component_id"
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, folder, "benchmark"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.captures(table(spark, folder, "pages"))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.unionByName(more)))


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op12_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bytespans.remove_earlier(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.link_scores(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_neighbours": op2_neighbours,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_substrings": op9_substrings,
    "op10_licenses": op10_licenses,
    "op11_spelling": op11_spelling,
    "op12_suffixes": op12_suffixes,
    "op13_alignment": op13_alignment,
}
