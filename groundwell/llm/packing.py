"""Variable-capacity best-fit packing of token sequences.

Texts longer than the largest permitted length are cut there; all their pieces are packed.
Pieces are dealt to shards of bounded size, and each shard is packed in one task, longest
piece first: into the open bin with the least room that suffices, or else into a new bin of
the permitted length whose cost per token promises to be least, judged by trial on the pieces
still to come. In the end every bin is cut down to the smallest length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import n_words, ready

#: Permitted sequence lengths.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces that are packed together; bins do not cross shards.
SHARD_PIECES = 20_000


def bin_cost(length: int) -> float:
    """Cost of a bin: its tokens, padding included, and a fixed part per sequence."""
    return length + 32.0


def _fill(length: int, room: int, rising: np.ndarray, waiting: int) -> int:
    """Tokens in a new bin that takes the longest fitting pieces of those still waiting."""
    used, top = length, waiting
    while room > 0:
        top = min(top, int(np.searchsorted(rising, room, "right"))) - 1
        if top < 0:
            break
        used += int(rising[top])
        room -= int(rising[top])
    return used


def pack(
    sizes: Sequence[int],
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = bin_cost,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each piece; every size fits the largest length."""
    sizes = np.asarray(sizes, np.int64)
    permitted = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    rising = sizes[order][::-1]
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []
    for place, item in enumerate(order.tolist()):
        size = int(sizes[item])
        best = bisect_left(room, (size, -1))
        if best < len(room):
            left, chosen = room.pop(best)
        else:
            waiting = len(sizes) - place - 1
            left = min(
                (c for c in permitted if c >= size),
                key=lambda c: (cost(c) / _fill(size, c - size, rising, waiting), c),
            )
            chosen = len(used)
            used.append(0)
        bins[item], offsets[item] = chosen, used[chosen]
        used[chosen] += size
        if left > size:
            insort(room, (left - size, chosen))
    held = np.array(used, np.int64)
    final = np.array(permitted, np.int64)[np.searchsorted(permitted, held)]
    return bins, offsets, final[bins] if len(sizes) else offsets


def pack_documents(
    docs: DataFrame,
    tokens: Column | None = None,
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = bin_cost,
) -> DataFrame:
    """``doc_id, piece, start, size, bin_id, offset, capacity`` for each piece of each document.

    ``start`` and ``size`` are in tokens of the document, ``offset`` is the place in the bin
    and ``capacity`` the bin's permitted length. ``tokens`` counts the tokens of a row; without
    it words are counted. A document without tokens, null text included, has one row of size
    0 without a bin. Repeated rows and null ids are packed as any other; an empty table gives
    an empty one. Columns other than ``doc_id`` and ``text`` are not read.
    """
    ready(docs.sparkSession)
    most = max(lengths)
    count = n_words("text") if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    counted = docs.select("doc_id", count.alias("tokens"))
    pieces = counted.withColumn(
        "piece",
        F.explode(
            F.sequence(
                F.lit(0).cast("long"),
                F.greatest(F.ceil(F.col("tokens") / most), F.lit(1).cast("long")) - 1,
            )
        ),
    ).select(
        "doc_id",
        "piece",
        (F.col("piece") * most).alias("start"),
        F.least(F.col("tokens") - F.col("piece") * most, F.lit(most)).cast("long").alias("size"),
        # Repeated rows are spread by where they were read.
        F.spark_partition_id().alias("origin"),
    )
    total = counted.agg(
        F.sum(F.greatest(F.ceil(F.col("tokens") / most), F.lit(1)))
    ).first()[0]
    shards = max(1, -(-int(total or 0) // SHARD_PIECES))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True])
        some = (rows["size"] > 0).to_numpy()
        bins, offsets, capacity = pack(rows["size"].to_numpy()[some], lengths, cost)
        shard = int(rows["shard"].iloc[0])
        for name, values in (
            ("bin_id", bins + (shard << 32)), ("offset", offsets), ("capacity", capacity)
        ):
            column = np.full(len(rows), None, object)
            column[some] = values
            rows[name] = pd.array(column, dtype="Int64")
        return rows.drop(columns="shard")

    return (
        pieces.withColumn(
            "shard", F.pmod(F.xxhash64("doc_id", "piece", "origin"), F.lit(shards))
        )
        .drop("origin")
        # Rows are small and packing is not: no two shards need share a task.
        .repartition(shards, "shard")
        .groupBy("shard")
        .applyInPandas(
            lambda rows: work(rows)[
                ["doc_id", "piece", "start", "size", "bin_id", "offset", "capacity"]
            ],
            f"doc_id {kind}, piece bigint, start bigint, size bigint, bin_id bigint, "
            "offset bigint, capacity bigint",
        )
    )
