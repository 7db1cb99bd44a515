"""A cell index under change: arrivals, replacements, deletions, splits and merges.

Points lie below ``root/points`` by batch, with the cell they were put in; ``root/cells`` has a
version of the cell table for each batch (number, center, radius, points, last batch). A batch is
written first and its cell table after it, and readers go by the newest cell table alone, so that a
writer that dies in between leaves the index as it was, and the batch can be written again.

k-means is fitted once. Later an arriving point goes to the nearest center; a cell that grew past
``max_points`` is split among new centers fitted on its own points; the points of a cell that shrank
below ``min_points`` go to the cells nearest to them. Only points of such cells are written again.
Radii are those of the points that are there, so that the exact search stays exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwell.operators.cells import Cells, search_cells
from groundwell.operators.index import last_of
from groundwell.operators.sizes import broadcast_if_small
from groundwell.session import ship_package

POINTS = "chunk_id, vector, chunk_text, metadata".split(", ")
#: Points of one overfull cell that its new centers are fitted on. Centers guide a search and do
#: not decide what it finds.
SPLIT_ROWS = 2048
_ROUNDS = 8


@dataclass(frozen=True)
class LiveCells:
    """Points in cells below ``root``. A null id is no point, an id without a vector neither."""

    spark: SparkSession
    root: str
    max_points: int
    min_points: int = 1

    def create(self, points: DataFrame, n_cells: int, vector: str = "vector") -> None:
        """Fit ``n_cells`` centers on ``points`` (unique ids) and store them as batch 0."""
        ship_package(self.spark)
        there = _usable(points)
        cells = Cells.fit(there, n_cells, vector)
        self._write(0, _placed(cells, there))
        self._commit(0, cells)

    def apply(
        self, batch: int, points: DataFrame | None = None, gone: DataFrame | None = None,
        order: str | None = None,
    ) -> bool:
        """One batch of ``points`` to insert or replace by id and of ids to delete (``gone``).

        Of an id in both the point stays. ``order`` tells the last of two points with one id, as
        :func:`groundwell.operators.index.last_of` has it. Whether anything was done: a batch that
        the index has already is passed over.
        """
        if batch <= self.last_batch():
            return False
        cells = self.cells()
        changes = []
        if points is not None:
            arrived = last_of(_usable(points, order), "chunk_id", order)
            changes.append(_placed(cells, arrived))
        if gone is not None:
            ids = gone.select("chunk_id").where("chunk_id is not null").distinct()
            if points is not None:
                ids = ids.join(_usable(points, order).select("chunk_id"), "chunk_id", "left_anti")
            stored = self._stored().schema
            changes.append(
                ids.select(
                    "chunk_id",
                    *(F.lit(None).cast(stored[c].dataType).alias(c) for c in POINTS[1:]),
                    F.lit(None).cast("int").alias("cell"),
                    F.lit(None).cast("double").alias("angle"),
                )
            )
        if changes:
            rows = changes[0]
            for more in changes[1:]:
                rows = rows.unionByName(more)
            self._write(batch, rows)
        self._commit(batch, cells)
        return True

    def maintain(self, batch: int) -> bool:
        """Split cells of more than ``max_points`` points and empty those of fewer than
        ``min_points``, as batch ``batch``. A cell whose points are all alike stays as it is."""
        if batch <= self.last_batch():
            return False
        table = self.table()
        # One row per cell that changes.
        full = {r["cell"] for r in table.where(F.col("n_points") > self.max_points).collect()}
        cells, sparse = self.cells(), set()
        few = table.where(F.col("n_points") < self.min_points).orderBy("n_points", "cell")
        for row in few.collect():
            if len(sparse) + 1 < cells.n_cells:  # one cell stays, whatever it holds
                sparse.add(row["cell"])
        new = self._new_centers(full)
        moved = sorted(sparse | {cell for cell, _ in new})
        kept = ~np.isin(cells.cell_numbers, moved)
        centers = [*cells.centers[kept], *(center for _, center in new)]
        first = int(self.table().agg(F.max("next_cell")).first()[0])
        numbers = [*cells.cell_numbers[kept], *range(first, first + len(new))]
        after = Cells(np.array(centers), np.array(numbers))
        if moved:
            live = self.points()
            self._write(batch, _placed(after, live.where(F.col("cell").isin(moved)).select(*POINTS)))
        self._commit(batch, after)
        return True

    def points(self) -> DataFrame:
        """Current points with ``cell`` and ``angle``. Ids and batch numbers tell what is out of
        date; while the ids that changed are few, neither vectors nor texts are shuffled."""
        rows = self._stored()
        changed = rows.where("batch > 0").groupBy("chunk_id").agg(F.max("batch").alias("newest"))
        return (
            rows.join(broadcast_if_small(changed), "chunk_id", "left")
            .where("batch = coalesce(newest, 0) and cell is not null")
            .select(*POINTS, "cell", "angle")
        )

    def table(self) -> DataFrame:
        """``cell, center, radius, n_points``, the last batch and the next free number."""
        return self.spark.read.parquet(f"{self.root}/cells/version={self.last_batch()}")

    def cells(self) -> Cells:
        """Centers, radii and sizes; a row per cell comes to the driver, whatever the number of points."""
        rows = self.table().orderBy("cell").collect()
        return Cells(
            np.array([r["center"] for r in rows]),
            np.array([r["cell"] for r in rows]),
            np.array([r["radius"] for r in rows]),
            np.array([r["n_points"] for r in rows]),
        )

    def search(self, queries: DataFrame, top_k: int | None = 5, **options) -> DataFrame:
        """:func:`groundwell.operators.cells.search_cells` over the current points."""
        return search_cells(self.cells(), self.points(), queries, top_k, **options)

    def last_batch(self) -> int:
        """The newest batch whose cell table is complete; -1 before the first."""
        return max(self._batches(), default=-1)

    def _batches(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/cells/version=*/_SUCCESS")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        versions = [f.getPath().getParent().getName().split("=")[1] for f in files or []]
        return sorted(map(int, versions))

    def _stored(self, *more: int) -> DataFrame:
        """Rows of the batches with a cell table, and of ``more``."""
        batches = [*self._batches(), *more]
        return self.spark.read.parquet(f"{self.root}/points").where(F.col("batch").isin(batches))

    def _write(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/points/batch={int(batch)}")

    def _commit(self, batch: int, cells: Cells) -> None:
        """The cell table after ``batch``. Radii and counts read ids, cells and angles only."""
        rows = self._stored(batch).select("chunk_id", "cell", "angle", "batch")
        changed = rows.where("batch > 0").groupBy("chunk_id").agg(F.max("batch").alias("newest"))
        figures = (
            rows.join(broadcast_if_small(changed), "chunk_id", "left")
            .where("batch = coalesce(newest, 0) and cell is not null")
            .groupBy("cell")
            .agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n_points"))
        )
        known = self.spark.createDataFrame(
            [(int(n), c.tolist()) for n, c in zip(cells.cell_numbers, cells.centers, strict=True)],
            "cell int, center array<double>",
        )
        free = int(cells.cell_numbers.max()) + 1
        if batch > 0:
            free = max(free, self.table().agg(F.max("next_cell")).first()[0])
        # At most one row per cell on both sides.
        known.join(F.broadcast(figures), "cell", "left").select(
            "cell", "center",
            F.coalesce("radius", F.lit(0.0)).alias("radius"),
            F.coalesce("n_points", F.lit(0)).alias("n_points"),
            F.lit(free).alias("next_cell"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cells/version={int(batch)}")

    def _new_centers(self, full: set[int]) -> list[tuple[int, np.ndarray]]:
        """``(cell, center)`` for the parts of each overfull cell that can be told apart."""
        if not full:
            return []
        ship_package(self.spark)
        want = F.col("n_points") / F.lit(self.max_points)
        parts = self.table().select("cell", F.least(F.ceil(want * 2), F.lit(64)).alias("parts"))
        some = Window.partitionBy("cell").orderBy(F.xxhash64("chunk_id"), "chunk_id")
        sample = (
            self.points().where(F.col("cell").isin(sorted(full)))
            .select("cell", "chunk_id", "vector")
            .withColumn("place", F.row_number().over(some))
            .where(F.col("place") <= SPLIT_ROWS)
            .join(F.broadcast(parts), "cell")
            .select("cell", "parts", "place", "vector")
        )
        fitted = sample.groupBy("cell").applyInPandas(
            _split, "cell int, part int, center array<double>"
        )
        rows = fitted.orderBy("cell", "part").collect()
        return [(r["cell"], np.array(r["center"])) for r in rows]


def _usable(points: DataFrame, order: str | None = None) -> DataFrame:
    extra = [] if order is None or order in POINTS else [order]
    return points.select(*POINTS, *extra).where("chunk_id is not null and vector is not null")


def _placed(cells: Cells, points: DataFrame) -> DataFrame:
    return cells.assign(points).select(*POINTS, "cell", "angle")


def _split(rows: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means from centers that lie far apart; no rows if all points are alike."""
    rows = rows.sort_values("place")
    unit = np.array(rows["vector"].tolist(), dtype=np.float64)
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, length, out=np.zeros_like(unit), where=length > 0)
    centers = unit[:1]
    while len(centers) < rows["parts"].iloc[0]:
        nearest = (unit @ centers.T).max(axis=1)
        if nearest.min() > 1 - 1e-9:
            break
        centers = np.vstack([centers, unit[nearest.argmin()]])
    for _ in range(_ROUNDS):
        home = (unit @ centers.T).argmax(axis=1)
        sums = np.array([unit[home == i].sum(axis=0) for i in range(len(centers))])
        size = np.linalg.norm(sums, axis=1)
        centers = sums[size > 0] / size[size > 0, None]
    found = centers if len(centers) > 1 else centers[:0]
    return pd.DataFrame(
        {
            "cell": np.full(len(found), rows["cell"].iloc[0], np.int32),
            "part": np.arange(len(found), dtype=np.int32),
            "center": pd.Series(found.tolist(), dtype=object),
        }
    )
