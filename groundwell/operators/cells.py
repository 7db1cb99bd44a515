"""Top-k through k-means cells: approximate, or exact by bounding the cells left out.

Stored vectors are put in the cell of their nearest center. A query visits the cells whose
centers are nearest to it. On the unit sphere a cell with center ``c`` and angular radius
``r`` holds no vector with a cosine above ``cos(max(0, angle(query, c) - r))``; the exact
search therefore visits, in a second pass, only cells whose bound reaches the query's k-th
best score of the first pass.

Cells lie in groups of about a block of rows, and groups are equi keys: a query travels once to
a group in which it visits any cell, and meets there only the cells it visits. So a query that has
to see nearly all cells is not copied for each of them. A group that one cell makes large is cut in
blocks like any other part of a search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.vectors import l2_normalize
from groundwell.operators.scoring import SCORE_DECIMALS, place_in_group
from groundwell.operators.search import (
    BLOCK_BYTES,
    BLOCK_ROWS,
    Visits,
    grouped_blocks,
    normal_requests,
    rank_hits,
    satisfying,
    score_in_blocks,
)
from groundwell.session import ship_package
from groundwell.settings import SEARCH_TOP_K_MAX, Settings, shared_folder

# Products of vectors and centers at a time, about 32 MB.
_STEP_PRODUCTS = 4_000_000
# Room for rounding in bounds and scores.
_SLACK = 10.0 ** (1 - SCORE_DECIMALS)


@dataclass(frozen=True)
class Cells:
    """Unit-length centers, one row per cell.

    ``numbers`` names the cells where they are not numbered from 0; ``radii`` are the largest
    angles of their points and ``sizes`` their points where both are known, so that a search need
    not look them up.
    """

    centers: np.ndarray
    numbers: np.ndarray | None = None
    radii: np.ndarray | None = None
    sizes: np.ndarray | None = None

    @property
    def n_cells(self) -> int:
        return len(self.centers)

    @property
    def cell_numbers(self) -> np.ndarray:
        return np.arange(self.n_cells) if self.numbers is None else self.numbers

    @classmethod
    def fit(
        cls, points: DataFrame, n_cells: int, vector: str = "vector", seed: int = 7,
        max_iter: int = 10,
    ) -> Cells:
        """K-means over the given vectors. Only the ``n_cells`` centers come to the driver.

        Centers guide a search and do not decide what it may find, so a very large table can
        be fitted on a part of it.
        """
        features = points.select(
            array_to_vector(l2_normalize(F.col(vector)).cast("array<double>")).alias("features")
        )
        model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(features)
        centers = np.asarray(model.clusterCenters(), dtype=np.float64)
        length = np.linalg.norm(centers, axis=1, keepdims=True)
        return cls(np.divide(centers, length, out=centers.copy(), where=length > 0))

    def assign(self, points: DataFrame, vector: str = "vector") -> DataFrame:
        """Add ``cell`` and ``angle``, the angle to its center. Partition a stored index by
        ``cell`` to read only the cells a search visits."""
        ship_package(points.sparkSession)
        placed = _nearest(self.centers, self.cell_numbers)(F.col(vector))
        return (
            points.withColumn("__placed", placed)
            .withColumn("cell", F.col("__placed.cell"))
            .withColumn("angle", F.col("__placed.angle"))
            .drop("__placed")
        )


def store_cells(placed: DataFrame, path: str) -> DataFrame:
    """Write points with their cells so that a search reads only the cells it visits.

    Rows of a cell are brought together first, and a cell much larger than the others is
    written by several tasks.
    """
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def search_cells(
    cells: Cells,
    points: DataFrame,
    queries: DataFrame,
    top_k: int | None = Settings.default_top_k,
    n_probe: int = 8,
    *,
    exact: bool = False,
    threshold: float | None = None,
    point_id: str = "chunk_id",
    query_id: str = "query_id",
    vector: str = "vector",
    metadata: str = "metadata",
    max_top_k: int = SEARCH_TOP_K_MAX,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, point_id, score``; ``points`` carry ``cell`` and ``angle``.

    Queries are those of :func:`groundwell.operators.search.search`, with filters and own
    ``top_k``. With ``exact=False`` the ``n_probe`` nearest cells are searched and results may
    miss points. With ``exact=True`` they equal the exact search.

    With a ``threshold`` the result is that of the exact search without the hits that score
    less, or are not a number. Cells whose bound is below it are not visited, and one pass over
    the others does (:func:`cell_visits` tells how many).
    """
    ship_package(points.sparkSession)
    requests = normal_requests(queries, top_k, max_top_k, query_id, vector)
    # The centers say which width this search has.
    requests = requests.where(F.size("vector") == cells.centers.shape[1])
    stored = satisfying(
        points.select(
            F.col(point_id).alias("point_id"),
            F.col(vector).alias("vector"),
            "cell",
            *([F.col(metadata).alias("metadata")] if "filters" in requests.columns else []),
        ),
        requests,
    )
    radii, sizes = _figures_of(cells, points)
    per_group = min(block_rows, BLOCK_BYTES // (8 * cells.centers.shape[1]))
    visits = _Visiting(cells, radii, _in_groups(sizes, per_group), n_probe, threshold)
    # One row per cell.
    homes = F.broadcast(
        points.sparkSession.createDataFrame(
            list(zip(cells.cell_numbers.tolist(), visits.groups.tolist())), "cell int, home int"
        )
    )
    part = F.concat_ws("|", "home", "part").alias("part")
    requests = requests.drop("filters")
    stored = stored.join(homes, "cell").select("point_id", "vector", "cell", "home", part)
    cuts = grouped_blocks(stored.drop("home"), "stored_blocks", block_rows)

    def candidates(rows: DataFrame, which: str) -> DataFrame:
        homes_of = visits.homes_of(which)
        visiting = rows.withColumn("home", F.explode(homes_of("vector", "floor")))
        # At most one row per group, so stored groups that nobody visits are not read.
        visited = F.broadcast(visiting.select("home").distinct())
        return score_in_blocks(
            stored.join(visited, "home", "left_semi").drop("home"),
            visiting.select("query_id", "vector", "top_k", "floor", part),
            block_rows,
            cuts,
            visits=Visits("cell", visits.choose(which)),
        )

    if threshold is not None:
        over = requests.withColumn("floor", F.lit(float(threshold)))
        passed = candidates(over, "over").where(
            ~F.isnan("score") & (F.col("score") >= threshold)
        )
        return rank_hits(passed, max_top_k, query_id=query_id, point_id=point_id)
    near = candidates(requests.withColumn("floor", F.lit(float("nan"))), "near")
    if not exact:
        return rank_hits(near, max_top_k, query_id=query_id, point_id=point_id)
    # Used twice below; at most top_k rows per query. A checkpoint outlives lost executors.
    shared_folder(points.sparkSession)
    best = rank_hits(near, max_top_k, keep=["top_k"]).checkpoint()
    floor = best.where(F.col("rank") == F.col("top_k")).select(
        "query_id", F.col("score").alias("floor")
    )
    # A query with fewer hits than it wants so far has no floor and visits every cell.
    floored = requests.join(floor, "query_id", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(float("nan")))
    )
    far = candidates(floored, "far")
    both = best.select(far.columns).unionByName(far)
    return rank_hits(both, max_top_k, query_id=query_id, point_id=point_id)


def _figures_of(cells: Cells, points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Radius and number of points of each cell."""
    if cells.radii is not None and cells.sizes is not None:
        return cells.radii, cells.sizes
    radii, sizes = np.zeros(cells.n_cells), np.zeros(cells.n_cells, dtype=np.int64)
    place = {number: i for i, number in enumerate(cells.cell_numbers.tolist())}
    figures = points.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    # At most one row per cell, whatever the number of points.
    for row in figures.collect():
        radii[place[row["cell"]]], sizes[place[row["cell"]]] = row["radius"], row["n"]
    return radii if cells.radii is None else cells.radii, sizes


def _in_groups(sizes: np.ndarray, per_group: int) -> np.ndarray:
    """A group for each cell: neighbours by number, until their points are ``per_group``."""
    groups, group, held = np.zeros(len(sizes), dtype=np.int32), 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > per_group:
            group, held = group + 1, 0
        groups[i], held = group, held + size
    return groups


@dataclass(frozen=True)
class _Visiting:
    """Which cells a query visits: the nearest (``near``), others that can reach its floor
    (``far``), or all that can reach the threshold (``over``)."""

    cells: Cells
    radii: np.ndarray
    groups: np.ndarray
    n_probe: int
    threshold: float | None

    def _mask(self, unit: np.ndarray, floor: np.ndarray, which: str) -> np.ndarray:
        """Queries by cells."""
        angle = np.arccos(np.clip(unit @ self.cells.centers.T, -1.0, 1.0))
        if which != "over":
            near = _least_places(angle, self.n_probe)
            if which == "near":
                return near
        bound = np.cos(np.maximum(0.0, angle - self.radii))
        # A zero vector has score 0 everywhere, so no cell can be left out for it.
        bound[~unit.any(axis=1)] = math.inf
        # What is not a number, as the floor of a query that has none, leaves no cell out.
        if which == "over":
            return ~(bound < self.threshold - _SLACK)
        return ~(bound < (floor - _SLACK)[:, None]) & ~near

    def _in_steps(self, unit: np.ndarray, floor: np.ndarray, which: str) -> Iterator[np.ndarray]:
        size = max(1, _STEP_PRODUCTS // max(1, self.cells.n_cells))
        for start in range(0, len(unit), size):
            yield self._mask(unit[start:start + size], floor[start:start + size], which)

    def homes_of(self, which: str):
        """The groups with a cell that a query visits, from its vector and floor."""
        starts = np.flatnonzero(np.r_[True, self.groups[1:] != self.groups[:-1]])

        @F.pandas_udf("array<int>")
        def homes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for vectors, floor in batches:
                found: list[np.ndarray] = []
                floors = floor.to_numpy(dtype=np.float64)
                for mask in self._in_steps(_unit_rows(vectors), floors, which):
                    some = np.logical_or.reduceat(mask, starts, axis=1)
                    found += [np.flatnonzero(row).astype(np.int32) for row in some]
                yield pd.Series(found, dtype=object)

        return homes

    def choose(self, which: str):
        """The mask of :class:`groundwell.operators.search.Visits`."""

        def chosen(unit: np.ndarray, requests: pa.Table, values: np.ndarray) -> np.ndarray:
            number = self.cells.cell_numbers
            order = np.argsort(number)
            place = order[np.searchsorted(number, values, sorter=order)]
            floor = requests.column("floor").to_numpy()
            return np.concatenate([m[:, place] for m in self._in_steps(unit, floor, which)])

        return chosen


def _least_places(angle: np.ndarray, n: int) -> np.ndarray:
    """A mask of the ``n`` least of each row, the first ones of equals; not a number is last."""
    angle = np.where(np.isnan(angle), np.inf, angle)
    if n >= angle.shape[1]:
        return np.ones(angle.shape, dtype=bool)
    last = np.partition(angle, n - 1, axis=1)[:, n - 1, None]
    inside = angle < last
    open_places = n - inside.sum(axis=1)
    row, place = np.nonzero(angle == last)
    first = place_in_group(row) < open_places[row]
    inside[row[first], place[first]] = True
    return inside


def _radii_of(cells: Cells, points: DataFrame) -> np.ndarray:
    return cells.radii if cells.radii is not None else _figures_of(cells, points)[0]


def cell_visits(
    cells: Cells, points: DataFrame, queries: DataFrame, threshold: float,
    query_id: str = "query_id", vector: str = "vector",
) -> DataFrame:
    """``query_id, n_cells``: the cells that could hold a score of ``threshold`` or more."""
    ship_package(points.sparkSession)
    radii = _radii_of(cells, points)
    bounds = _cell_bounds(cells.centers, radii, cells.n_cells, cells.cell_numbers)
    fitting = queries.where(F.size(vector) == cells.centers.shape[1])
    return fitting.withColumn("near", bounds(F.col(vector))).select(
        query_id,
        F.size(F.filter("near.bound", lambda b: b >= threshold - _SLACK)).alias("n_cells"),
    )


def recall(found: DataFrame, exact: DataFrame, query_id: str, point_id: str) -> DataFrame:
    """One row: share of the exact hits that were found."""
    hit = found.select(query_id, point_id, F.lit(1).alias("found"))
    return exact.join(hit, [query_id, point_id], "left").agg(
        F.count(F.lit(1)).alias("n_exact"),
        (F.count("found") / F.count(F.lit(1))).alias("recall"),
    )


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.array(vectors.tolist(), dtype=np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _steps(vectors: pd.Series, n_cells: int) -> Iterator[np.ndarray]:
    """Unit rows, so many at a time that their products with all centers stay bounded."""
    size = max(1, _STEP_PRODUCTS // max(1, n_cells))
    for start in range(0, max(len(vectors), 1), size):
        yield _unit_rows(vectors.iloc[start:start + size])


def _nearest(centers: np.ndarray, numbers: np.ndarray):
    @F.pandas_udf("cell INT, angle DOUBLE")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            found = []
            for unit in _steps(vectors, len(centers)):
                similarity = unit @ centers.T
                cell = similarity.argmax(axis=1)
                angle = np.arccos(np.clip(similarity[np.arange(len(cell)), cell], -1.0, 1.0))
                found.append(pd.DataFrame({"cell": numbers[cell].astype(np.int32), "angle": angle}))
            yield pd.concat(found, ignore_index=True)

    return nearest


def _cell_bounds(centers: np.ndarray, radii: np.ndarray, n_nearest: int, numbers: np.ndarray):
    """The nearest cells in order of their centers, with the best cosine each could hold."""

    @F.pandas_udf("cell ARRAY<INT>, bound ARRAY<DOUBLE>")
    def bounds(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            found = []
            for unit in _steps(vectors, len(centers)):
                angle = np.arccos(np.clip(unit @ centers.T, -1.0, 1.0))
                bound = np.cos(np.maximum(0.0, angle - radii))
                # A zero vector has score 0 everywhere, so no cell can be left out for it.
                bound[~unit.any(axis=1)] = math.inf
                near = np.argsort(angle, axis=1, kind="stable")[:, :n_nearest]
                best = np.take_along_axis(bound, near, axis=1)
                cell = numbers[near].astype(np.int32)
                found.append(pd.DataFrame({"cell": list(cell), "bound": list(best)}))
            yield pd.concat(found, ignore_index=True)

    return bounds
