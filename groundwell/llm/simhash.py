"""SimHash near-duplicates, found through a table of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwell.llm.common import free_name, pieces, ready, saved, utf8_list, words_of
from groundwell.llm.graph import connected_components

#: Fixed value: the seed of the shingle hash.
SEED = 42
#: Fingerprints differing in this many bits or fewer are linked.
MAX_BITS = 3
SHINGLE = 3
#: The fingerprint is cut in so many segments; ``SEGMENTS - MAX_BITS`` of them stay untouched.
SEGMENTS = 6
#: Reference fingerprints whose distances make up the pivot table.
PIVOTS = np.random.default_rng(20).integers(0, 1 << 64, 16, dtype=np.uint64)
#: Distinct fingerprints of one candidate group that meet in one task; larger groups are cut.
BLOCK = 4096


def _shingle_hashes(words: list[bytes], width: int) -> list[int]:
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
    starts = [0, *(end + 1 for end in ends)]
    cut = [joined[s:e] for s, e in zip(starts, ends[width - 1 :], strict=False)]
    return list(map(xxhash.xxh64_intdigest, cut, repeat(SEED)))


def text_fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each UTF-8 text; zero for a text without words."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        found = _shingle_hashes(words_of(text.lower()), width)
        counts[row] = len(found)
        hashes += found
    out = np.zeros(len(texts), np.uint64)
    some = counts > 0
    if hashes:
        bits = np.unpackbits(
            np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        starts = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        most = 2 * ones > counts[some][:, None]
        out[some] = np.packbits(most, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint BIGINT`` for each row of ``docs`` (``doc_id, text``).

    A null text has no words and so the fingerprint zero. Other columns are left out.
    """
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            prints = text_fingerprints(utf8_list(piece.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(prints.view(np.int64))],
                ["doc_id", "fingerprint"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, fingerprint bigint"
    )


def _segment_masks() -> list[int]:
    edges = [round(64 * i / SEGMENTS) for i in range(SEGMENTS + 1)]
    segments = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(segments, SEGMENTS - MAX_BITS)]


def pivot_keys(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint a key per choice of segments, of shape (rows, choices).

    The key folds the distances to all reference fingerprints, counted in the chosen
    segments only. Two fingerprints within ``MAX_BITS`` agree in all bits of one choice at
    least, so that all these distances differ by zero there and the keys are equal.
    """
    odd = np.random.default_rng(21).integers(0, 1 << 63, len(PIVOTS), dtype=np.uint64) * 2 + 1
    keys = []
    with np.errstate(over="ignore"):
        for choice, mask in enumerate(_segment_masks()):
            key = np.full(len(prints), choice + 1, np.uint64)
            for pivot, factor in zip(PIVOTS, odd, strict=True):
                apart = np.bitwise_count((prints ^ pivot) & np.uint64(mask))
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                key += apart.astype(np.uint64) * factor
            keys.append(key ^ (key >> np.uint64(32)))
    return np.stack(keys, axis=1)


def _root(parent: np.ndarray, node: int) -> int:
    while parent[node] != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def spanning_links(
    prints: np.ndarray, starts: np.ndarray, side: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``MAX_BITS`` inside each group, reduced to a spanning forest of the group.

    ``starts`` are the first rows of the groups; ``side`` 0 or 1 lets only rows of unlike
    sides meet, and 2 lets a row meet all. Pairs are first discarded by the largest
    difference of their pivot distances, which cannot exceed their own distance.
    """
    n = len(prints)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    table = np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    columns = [np.ascontiguousarray(table[:, p]) for p in range(table.shape[1])]
    parent = np.arange(n)
    left: list[int] = []
    right: list[int] = []
    active, step = np.arange(n), 0
    while True:
        step += 1
        active = active[active + step < ends[active]]
        if not len(active):
            break
        i = active
        if side is not None:
            i = i[(side[i] == 2) | (side[i] != side[i + step])]
        for column in columns:
            if not len(i):
                break
            i = i[np.abs(column[i] - column[i + step]) <= MAX_BITS]
        i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= MAX_BITS]
        i = i[parent[i] != parent[i + step]]
        for a in i.tolist():
            x, y = _root(parent, a), _root(parent, a + step)
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(a)
                right.append(a + step)
        if len(i):
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
    return prints[left], prints[right]


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links between the distinct ``fingerprint`` values that join all that can be
    reached from each other in steps of ``MAX_BITS`` bits or fewer.

    Every fingerprint goes to one candidate group per choice of segments. A group of more
    than ``BLOCK`` members is cut in blocks, and each pair of blocks is a task of its own.
    A task gives up no more links than it has members.
    """
    ready(prints.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = pivot_keys(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(own, keys.shape[1]).view(np.int64)),
                ],
                ["key", "fp"],
            )

    entries = saved(
        prints.select("fingerprint").mapInArrow(index, "key bigint, fp bigint")
    )
    hot = entries.groupBy("key").count().where(F.col("count") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(BLOCK)), F.lit(1)).cast("int")
    dealt = (
        entries.join(hot, "key", "left")
        .withColumn("n", blocks)
        .withColumn("home", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            "key",
            F.least("home", "other").alias("lo"),
            F.greatest("home", "other").alias("hi"),
            F.when(F.col("home") == F.col("other"), 2)
            .otherwise((F.col("home") > F.col("other")).cast("int"))
            .alias("side"),
            "fp",
        )
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                rows = [np.concatenate(pair) for pair in zip(kept, rows, strict=True)]
            starts = _starts(rows)
            cut = starts[-1]
            kept = [column[cut:] for column in rows]
            if cut:
                yield _linked([column[:cut] for column in rows], starts[:-1])
        if kept is not None:
            yield _linked(kept, np.zeros(1, np.int64))

    return (
        dealt.repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi", "fp")
        .mapInArrow(meet, "a bigint, b bigint")
        .distinct()
    )


def _starts(rows: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(rows[0]), bool)
    new[1:] = False
    for column in rows[:3]:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _linked(rows: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
    a, b = spanning_links(rows[4].view(np.uint64), starts, rows[3])
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
    )


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, fingerprint, component_id, root``.

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the smallest document id that
    can be reached over links, ``root`` the smallest fingerprint of the component. A null id
    takes part in links, but is smallest only where all are null; repeated rows give
    repeated results; an empty table gives an empty one. Exact copies share a fingerprint
    and are folded before anything is compared.
    """
    own = saved(fingerprints(docs, width))
    distinct = own.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct)).withColumnRenamed("node", "fingerprint")
    known = saved(
        distinct.join(roots, "fingerprint", "left").withColumn(
            "root", F.coalesce("root", "fingerprint")
        )
    )
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(smallest, "root").select("fingerprint", "component_id", "root")
    return own.join(named, "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
    )


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does.

    It is the one with the smallest id (null last), then the smallest text hash; of repeated
    rows one stays. All columns are kept.
    """
    text = F.xxhash64("text")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), text.alias("t"))
    found = near_duplicates(docs.select(rank.alias("doc_id"), "text"), width)
    i, t, mark, copy = (free_name(docs, n) for n in ("__i", "__t", "__text", "__copy"))
    stay = (
        found.where("doc_id = component_id")
        .select(F.col("doc_id.i").alias(i), F.col("doc_id.t").alias(t))
        .distinct()
    )
    own = docs.withColumn(mark, text)
    met = own.join(
        stay, own["doc_id"].eqNullSafe(stay[i]) & (own[mark] == stay[t]), "left_semi"
    )
    same = Window.partitionBy("doc_id", mark).orderBy(mark)
    return (
        met.withColumn(copy, F.row_number().over(same))
        .where(F.col(copy) == 1)
        .select(*docs.columns)
    )
