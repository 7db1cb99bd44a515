"""Posting lists: for each metadata entry the ids that have it, in sorted blocks.

A filter is settled on ids alone: the lists of its entries are intersected block by block, and
only the ids that are left are looked up among the vectors. An id is in the same block number of
every list, told by its hash, so that blocks of two lists meet by an equi key; how many blocks
there are follows from the number of points, so that a block stays bounded even where all points
have the entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a block at most, on average.
BLOCK_IDS = 16_384
#: Where filters ask for more of the points than this, a scan of all is no dearer.
SCAN_SHARE = 0.5


def posting_lists(
    points: DataFrame, entries: Column, point_id: str = "chunk_id", block_ids: int = BLOCK_IDS
) -> DataFrame:
    """``key, value, block, ids, n``: the posting lists of ``points`` (unique ids).

    ``entries`` is an array of distinct ``(key, value)``, such as
    :func:`groundwell.functions.typed.typed_entries`. The row with the null key lists every point
    once, so that the lists know how many points there are. Null ids are left out.
    """
    blocks = max(1, -(-points.count() // block_ids))
    everything = F.array(
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    )
    return (
        points.where(F.col(point_id).isNotNull())
        .select(F.col(point_id).alias("id"), F.inline(F.concat(everything, entries)))
        .groupBy("key", "value", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("n", F.size("ids"))
    )


def _lists_of(wanted: DataFrame) -> DataFrame:
    """``filter, many, key, value``: a row per entry of each filter."""
    return wanted.select(
        F.col("key").alias("filter"), F.size("entries").alias("many"), F.inline("entries")
    )


def asked_share(postings: DataFrame, wanted: DataFrame) -> tuple[int, int]:
    """How many points the filters (``key, entries``) ask for at most, and how many there are.

    A filter asks for no more than its rarest entry has. Only counts are read.
    """
    counts = postings.groupBy("key", "value").agg(F.sum("n").alias("n"))
    per_filter = (
        _lists_of(wanted)
        .join(counts, ["key", "value"])
        .groupBy("filter")
        .agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("known"), F.first("many").alias("many"))
        .where("known = many")
    )
    total = counts.where("key is null").select(F.lit(False).alias("asked"), "n")
    sums = (
        per_filter.select(F.lit(True).alias("asked"), "n").unionByName(total)
        .groupBy("asked").agg(F.sum("n").alias("n")).collect()
    )
    figures = {row["asked"]: row["n"] for row in sums}
    return figures.get(True, 0), figures.get(False, 0)


def matching_ids(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, point_id``: the points that have all entries of each filter (``key, entries``).

    Lists of one filter meet by block; what they have in common is taken without a row per id.
    """
    met = _lists_of(wanted).join(postings.drop("n"), ["key", "value"])
    common = met.groupBy("filter", "block").agg(
        F.first("many").alias("many"), F.collect_list("ids").alias("lists")
    )
    ids = F.aggregate(
        F.slice("lists", F.lit(2), F.col("many")),
        F.element_at("lists", 1),
        lambda left, right: F.array_intersect(left, right),
    )
    return (
        common.where(F.size("lists") == F.col("many"))
        .select(F.col("filter").alias("key"), F.explode(ids).alias("point_id"))
    )
