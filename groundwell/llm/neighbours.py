"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash function is ``floor((a . x + b) / w)`` with Gaussian ``a``; a table joins several of them
to a bucket. A query visits its own bucket and then perturbed ones, whose functions move by one
step, in the order of the success that the query's distances to the bucket's sides lead to
expect. The candidates of all tables are ranked by exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwell.llm.common import ready, saved
from groundwell.operators.sizes import broadcast_if_small

#: Rows that the hashing is fitted on, at most, and queries among them.
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 64
TABLES = 4
#: Functions of a table that the fit chooses from, and probes of a table.
FUNCTIONS = (8, 12, 16)
PROBES = tuple(1 << i for i in range(3, 11))
#: Width of a bucket, in median distances to the k-th neighbour in the sample.
WIDTH = 2.2
#: Share of the sample's neighbours that the chosen number of probes finds.
RECALL = 0.97
#: Points of one bucket in a block, and of all blocks in a task.
BLOCK = 8192
TASK_POINTS = 65536


def usable(vector: Column) -> Column:
    """True for a vector that is not null, empty or zero and has finite components only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    good = (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def probe_template(functions: int, probes: int) -> np.ndarray:
    """Perturbations in expected order, as a 0/1 matrix (probe, rank of the side).

    The sides of a query's bucket are ranked by distance. Squared distances are taken at their
    expectation for the rank, so that the order is the same for all queries. The first row is
    the bucket itself; sides r and 2M - 1 - r (from 0) belong to one function and exclude
    each other.
    """
    m = functions
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    back = 2 * m + 1 - np.arange(m + 1, 2 * m + 1)
    far = 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([near, far])
    rows = [np.zeros(2 * m, np.int64)]
    heap: list[tuple[float, tuple[int, ...]]] = [(cost[0], (0,))]
    while heap and len(rows) < probes:
        total, some = heapq.heappop(heap)
        if not any(2 * m - 1 - r in some for r in some):
            row = np.zeros(2 * m, np.int64)
            row[list(some)] = 1
            rows.append(row)
        last = some[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*some[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*some, last + 1)))
    return np.stack(rows)


@dataclass(frozen=True)
class Hashing:
    """A fitted family of tables; its size depends on the vectors' width only."""

    lines: np.ndarray  # (tables, functions, width)
    shifts: np.ndarray  # (tables, functions)
    factors: np.ndarray  # (tables, functions), to fold a bucket into a number
    template: np.ndarray
    found: float
    visited: float

    def _places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return vectors @ self.lines[table].T + self.shifts[table]

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        with np.errstate(over="ignore"):
            folded = [
                (np.floor(self._places(vectors, t)).astype(np.int64) * self.factors[t]).sum(1) + t
                for t in range(len(self.lines))
            ]
        return np.stack(folded, axis=1)

    def probes(self, vectors: np.ndarray) -> np.ndarray:
        """The buckets that each vector visits, of shape (rows, tables, probes)."""
        out = []
        with np.errstate(over="ignore"):
            for t in range(len(self.lines)):
                place = self._places(vectors, t)
                inside = place - np.floor(place)
                sides = np.concatenate([inside, 1 - inside], axis=1)
                order = np.argsort(sides, axis=1, kind="stable")
                moves = np.concatenate([-self.factors[t], self.factors[t]])
                own = (np.floor(place).astype(np.int64) * self.factors[t]).sum(1) + t
                out.append(own[:, None] + moves[order] @ self.template.T)
        return np.stack(out, axis=1)


def _hashing(rng: np.random.Generator, width: int, size: float, functions: int, probes: int) -> Hashing:
    return Hashing(
        rng.standard_normal((TABLES, functions, width)) / size,
        rng.uniform(0, 1, (TABLES, functions)),
        rng.integers(-(1 << 62), 1 << 62, (TABLES, functions)) * 2 + 1,
        probe_template(functions, probes),
        0.0,
        0.0,
    )


def fit(sample: np.ndarray, k: int, seed: int = 5) -> Hashing:
    """The tables, functions and probes that visit least of the sample for the recall wanted.

    Neighbours in a sample are farther away than in all rows, so that more is found there.
    """
    n, width = sample.shape
    rng = np.random.default_rng(seed)
    asked = sample[:: max(1, n // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    apart = np.sqrt(np.maximum(0, _squares(asked, sample)))
    k = min(k, n - 1)
    near = np.argsort(apart, axis=1, kind="stable")[:, : k + 1]
    size = WIDTH * float(np.median(np.take_along_axis(apart, near, 1)[:, -1]))
    best: Hashing | None = None
    size = size or 1.0
    # Buckets are widened until the recall is reached: in the end one holds all rows.
    while best is None or best.found < RECALL:
        for functions in FUNCTIONS:
            tried = _hashing(rng, width, size, functions, PROBES[-1])
            own, seen = tried.buckets(sample), tried.probes(asked)
            # The first probe of each query and table that would meet each row of the sample.
            first = np.full((len(asked), n), PROBES[-1])
            for q in range(len(asked)):
                for t in range(TABLES):
                    keys, at = np.unique(seen[q, t], return_index=True)
                    spot = np.minimum(np.searchsorted(keys, own[:, t]), len(keys) - 1)
                    met = keys[spot] == own[:, t]
                    first[q, met] = np.minimum(first[q, met], at[spot[met]])
            for probes in PROBES:
                hit = first < probes
                found = float(np.take_along_axis(hit, near, 1).mean())
                if found >= RECALL or probes == PROBES[-1]:
                    break
            visited = float(hit.mean())
            now = Hashing(
                tried.lines, tried.shifts, tried.factors, tried.template[:probes], found, visited
            )
            rank = lambda h: (min(h.found, RECALL), -h.visited)
            best = now if best is None or rank(now) > rank(best) else best
        size *= 2
    return best


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class _Task:
    """The points of one task by cell, and the best of them for a query."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(cells, kind="stable")
        self.ids, self.cells, self.vectors = ids[order], cells[order], vectors[order]
        self.norms = (self.vectors**2).sum(1)

    def best(self, own: int, vector: np.ndarray, cells: np.ndarray, k: int) -> tuple:
        starts = np.searchsorted(self.cells, cells, "left")
        ends = np.searchsorted(self.cells, cells, "right")
        rows = [np.arange(a, b) for a, b in zip(starts, ends, strict=True) if b > a]
        if not rows:
            return (), ()
        at = np.concatenate(rows)
        at = at[self.ids[at] != own]
        if len(at) > 4 * k:
            near = self.norms[at] - 2 * self.vectors[at] @ vector
            # A point may come from each table; rounding of the short form is below the margin.
            margin = 1e-12 * (self.norms[at].max() + (vector**2).sum())
            some = at[near <= np.partition(near, 4 * k - 1)[4 * k - 1] + margin]
            at = some if len(np.unique(self.ids[some])) >= k else at
        score = np.sqrt(((self.vectors[at] - vector) ** 2).sum(1))
        order = np.lexsort((self.ids[at], score))
        ids, first = np.unique(self.ids[at][order], return_index=True)
        keep = np.sort(first)[:k]
        return self.ids[at][order][keep].tolist(), score[order][keep].tolist()


def _meet(points: DataFrame, asked: DataFrame, tasks: int, width: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: for each query the k best of each task.

    ``points`` are ``vec_id, vector, cell``; ``asked`` are ``query_id, vector, cells``.
    """
    own = points.select(
        F.pmod("cell", F.lit(tasks)).alias("task"),
        F.lit(0).alias("kind"),
        F.col("vec_id").alias("id"),
        "vector",
        F.array("cell").alias("cells"),
    )
    visits = asked.select("query_id", "vector", F.explode("cells").alias("cell"))
    grouped = (
        visits.select("query_id", "cell")
        .groupBy("query_id", F.pmod("cell", F.lit(tasks)).alias("task"))
        .agg(F.collect_set("cell").alias("cells"))
        .join(asked.select("query_id", "vector"), "query_id")
        .select("task", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vector", "cells")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, ready_task = None, [], None
        for batch in batches:
            numbers = batch.column("task").to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            out: list[tuple] = []
            for start, end in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                part = batch.slice(start, end - start)
                if numbers[start] != task:
                    task, held, ready_task = numbers[start], [], None
                ids = part.column("id").to_numpy(zero_copy_only=False)
                vectors = _matrix(part.column("vector"), width)
                if kinds[start] == 0:
                    cells = part.column("cells").flatten().to_numpy(zero_copy_only=False)
                    held.append((ids, cells, vectors))
                    continue
                if ready_task is None and held:
                    ready_task = _Task(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                if ready_task is not None:
                    for own_id, vector, cells in zip(
                        ids.tolist(), vectors, part.column("cells"), strict=True
                    ):
                        wanted = cells.values.to_numpy(zero_copy_only=False)
                        found, score = ready_task.best(own_id, vector, wanted, k)
                        out += [(own_id, i, s) for i, s in zip(found, score, strict=True)]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.float64()),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return (
        own.unionByName(grouped)
        .repartition(tasks, "task")
        .sortWithinPartitions("task", "kind")
        .mapInArrow(work, "query_id bigint, vec_id bigint, score double")
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest points found for each query.

    ``points`` are ``vec_id BIGINT, embedding ARRAY<FLOAT>``, ``queries`` are ``query_id,
    embedding``. A query does not meet points of its own id. ``score`` is the Euclidean
    distance in double precision; ties go to the smaller id. Vectors that are null, empty,
    zero or not finite take no part, on either side; neither do those of another width than
    most of the sample, nor rows with a null id. Repeated points count once; several vectors
    under one id count as one point at its best distance; of several queries under one id the
    smallest vector is taken. A query for which probing finds
    fewer than k is compared with all points. Empty tables give an empty result.

    Buckets with many points are cut in blocks, and blocks are dealt to tasks of bounded size;
    tasks give up k rows per query, and nothing else is gathered.
    """
    spark = points.sparkSession
    ready(spark)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    own = points.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")
    )
    total = own.count()
    if not total:
        return empty
    share = min(1.0, 1.5 * SAMPLE_ROWS / total)
    drawn = own.where(
        F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) <= int(share * (1 << 20))
    )
    rows = [r.vector for r in drawn.select("vector").limit(SAMPLE_ROWS).toLocalIterator()]
    if not rows:
        rows = [own.select("vector").first().vector]
    sizes = [len(r) for r in rows]
    width = max(set(sizes), key=sizes.count)
    sample = np.array([r for r in rows if len(r) == width], np.float64)
    hashing = fit(sample if len(sample) > 1 else np.repeat(sample, 2, axis=0), k)

    own = saved(own.where(F.size("vector") == width).dropDuplicates())
    asked = saved(
        queries.where(F.col("query_id").isNotNull() & usable(F.col("embedding")))
        .where(F.size("embedding") == width)
        .select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
        .groupBy("query_id")
        .agg(F.min("vector").alias("vector"))
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = hashing.buckets(_matrix(batch.column("vector"), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array(list(keys))],
                ["vec_id", "vector", "buckets"],
            )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = hashing.probes(_matrix(batch.column("vector"), width))
            keys = keys.reshape(len(keys), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), pa.array(list(keys))], ["query_id", "buckets"]
            )

    kind = own.schema["vector"].dataType.simpleString()
    indexed = own.mapInArrow(index, f"vec_id bigint, vector {kind}, buckets array<bigint>")
    placed = saved(
        indexed.select("vec_id", "vector", F.explode("buckets").alias("bucket"))
    )
    # Only buckets of more than a block are worth a row here, and while these are few the
    # vectors are not shuffled to learn their block.
    large = saved(
        placed.groupBy("bucket")
        .count()
        .where(F.col("count") > BLOCK)
        .select("bucket", F.ceil(F.col("count") / F.lit(BLOCK)).alias("blocks"))
    )
    large = broadcast_if_small(large)
    cell = F.xxhash64("bucket", "block")
    n_blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    cells = placed.join(large, "bucket", "left").select(
        "vec_id",
        "vector",
        F.xxhash64("bucket", F.pmod(F.xxhash64("vec_id", "vector"), n_blocks)).alias("cell"),
    )
    visits = (
        asked.mapInArrow(visit, "query_id bigint, buckets array<bigint>")
        .select("query_id", F.explode("buckets").alias("bucket"))
        .join(large, "bucket", "left")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
        .groupBy("query_id")
        .agg(F.collect_set(cell).alias("cells"))
        .join(asked, "query_id")
        .select("query_id", "vector", "cells")
    )
    tasks = max(1, -(-TABLES * total // TASK_POINTS), spark.sparkContext.defaultParallelism)
    found = saved(_ranked(_meet(cells, visits, tasks, width, k), k))
    short = saved(
        asked.join(found.groupBy("query_id").count(), "query_id", "left")
        .where(F.coalesce("count", F.lit(0)) < min(k, total - 1))
        .select("query_id", "vector")
    )
    if not short.isEmpty():
        blocks = max(1, -(-total // BLOCK))
        everywhere = own.select(
            "vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).alias("cell")
        )
        all_cells = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
        exact = _ranked(
            _meet(everywhere, short.withColumn("cells", all_cells), blocks, width, k), k
        )
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(exact)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
