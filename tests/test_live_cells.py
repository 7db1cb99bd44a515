"""Cells under change against the exact search, and figures from sketches against all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.operators import index
from groundwell.operators.live_cells import LiveCells
from groundwell.operators.search import search
from groundwell.operators.sketches import (
    ID_ERROR,
    RANK_ERROR,
    BatchSketches,
    figures,
    merge,
    sketch,
)

SCHEMA = "chunk_id int, vector array<float>, chunk_text string, metadata map<string,string>"


def rows_of(numbers, seed, groups=6, width=8):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(5).normal(size=(groups, width)) * 3
    return [
        (int(n), (rng.normal(size=width) + middles[n % groups]).tolist(), f"text {n}", {"n": str(n)})
        for n in numbers
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def hits(found):
    return {(r.query_id, r.rank, r.chunk_id, r.score) for r in found.collect()}


def test_changes_keep_the_search_exact(spark, tmp_path):
    live = LiveCells(spark, str(tmp_path / "index"), max_points=60, min_points=8)
    held = {r[0]: r for r in rows_of(range(200), 1)}
    live.create(frame(spark, list(held.values())), 3)
    queries = frame(spark, rows_of(range(30), 9)).select(
        F.col("chunk_id").alias("query_id"), "vector"
    )

    def agrees():
        current = frame(spark, list(held.values()))
        got = live.points()
        assert {r.chunk_id: r.chunk_text for r in got.collect()} == {k: v[2] for k, v in held.items()}
        table = {r.cell: r for r in live.table().collect()}
        for r in got.groupBy("cell").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():
            assert (table[r.cell].radius, table[r.cell].n_points) == (r.a, r.n)
        assert sum(r.n_points for r in table.values()) == len(held)
        assert hits(live.search(queries, 5, n_probe=2, exact=True)) == hits(search(current, queries, 5))

    agrees()
    arriving = rows_of(range(150, 420), 2)
    assert live.apply(1, frame(spark, arriving))
    held.update({r[0]: r for r in arriving})
    agrees()
    assert live.maintain(2)
    agrees()
    sizes = [r.n_points for r in live.table().collect()]
    assert len(sizes) > 3 and max(sizes) < 200
    gone = [n for n in held if n % 6 in (0, 1, 2)] + [9999]
    assert live.apply(3, gone=spark.createDataFrame([(n,) for n in gone], "chunk_id int"))
    held = {n: r for n, r in held.items() if n % 6 not in (0, 1, 2)}
    agrees()
    before = live.table().count()
    assert live.maintain(4)
    agrees()
    assert live.table().count() < before and live.table().where("n_points < 8").isEmpty()
    # What the index has already is passed over.
    assert not live.apply(3, frame(spark, rows_of(range(50), 3))) and not live.maintain(4)
    # A cell number is never given twice, and a deleted id may come back.
    back = rows_of([0, 6, 12], 8)
    assert live.apply(5, frame(spark, back), gone=spark.createDataFrame([(6,), (3,)], "chunk_id int"))
    held.update({r[0]: r for r in back})
    del held[3]
    agrees()


def test_a_batch_without_its_cell_table_is_not_read(spark, tmp_path):
    live = LiveCells(spark, str(tmp_path / "index"), 100)
    live.create(frame(spark, rows_of(range(40), 1)), 2)
    cells = live.cells()
    live._write(1, cells.assign(frame(spark, rows_of(range(40, 50), 1))))
    assert live.points().count() == 40
    assert live.apply(2, frame(spark, rows_of([77], 1)))
    assert {r.chunk_id for r in live.points().collect()} == {*range(40), 77}


def test_points_alike_do_not_split_and_odd_rows_are_none(spark, tmp_path):
    live = LiveCells(spark, str(tmp_path / "index"), 20)
    live.create(frame(spark, [(i, [1.0, 2.0], None, None) for i in range(50)]), 2)
    assert live.maintain(1) and live.table().count() == 1
    live.apply(2, frame(spark, [(None, [1.0, 2.0], "x", None), (99, None, "x", None)]))
    assert live.points().count() == 50
    with pytest.raises(Exception, match="no order tells"):
        live.apply(3, frame(spark, [(7, [1.0, 2.0], "a", None), (7, [2.0, 1.0], "b", None)]))
    assert live.last_batch() == 2
    twice = frame(spark, [(7, [1.0, 2.0], "a", None), (7, [2.0, 1.0], "b", None)])
    live.apply(3, twice.withColumn("no", F.ascii("chunk_text")), order="no")
    assert live.points().where("chunk_id = 7").first().chunk_text == "b"


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(60_000).select(
        (F.col("id") % 40_000).alias("chunk_id"),
        F.array(F.sqrt((F.col("id") % 1000) / 1000), F.lit(0.0)).cast("array<float>").alias("vector"),
        F.repeat(F.lit("x"), (F.col("id") % 997).cast("int")).alias("chunk_text"),
    )


def test_figures_within_their_error(spark, many, tmp_path):
    store = BatchSketches(spark, str(tmp_path / "sketches"), 2)
    for batch in range(3):
        store.write(batch, many.where(F.col("chunk_id") % 3 == batch))
    store.write(1, many.where(F.col("chunk_id") % 3 == 1))
    got, exact = store.audit().first(), index.audit(many, 2).first()
    for name in ("n_points", "n_wrong_width", "n_not_unit", "n_without_text"):
        assert got[name] == exact[name]
    assert abs(got.n_ids - exact.n_ids) <= ID_ERROR * exact.n_ids
    for value, share in zip(got.norms, (0.05, 0.5, 0.95), strict=True):
        assert abs(value**2 - share) <= RANK_ERROR + 0.001
    for value, share in zip(got.lengths, (0.05, 0.5, 0.95), strict=True):
        assert abs(value / 997 - share) <= RANK_ERROR + 0.002
    part = store.audit([0, 2]).first()
    assert part.n_points == many.where("chunk_id % 3 <> 1").count()


def test_merging_in_two_steps_is_merging_at_once(spark, many):
    parts = [sketch(many.where(F.col("chunk_id") % 4 == i), 2) for i in range(4)]
    at_once = figures(merge(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))).first()
    halves = merge(parts[0].union(parts[1])).union(merge(parts[2].union(parts[3])))
    steps = figures(merge(halves)).first()
    assert steps.n_points == at_once.n_points == 60_000
    assert abs(steps.n_ids - at_once.n_ids) <= ID_ERROR * at_once.n_ids


def test_nulls_and_nothing(spark):
    odd = frame(spark, [(None, None, None, None), (None, [1.0], "", None), (1, [float("nan")], "ab", None)])
    got = figures(merge(sketch(odd, 1))).first()
    assert (got.n_points, got.n_ids, got.n_wrong_width, got.n_without_text) == (3, 2, 1, 2)
    assert got.n_not_unit == index.audit(odd, 1).first().n_not_unit
    assert list(got.norms) == [1.0] * 3 and set(got.lengths) <= {0, 2}
    none = figures(merge(sketch(odd.where("false"), 1))).first()
    assert (none.n_points, none.n_ids, none.norms, none.lengths) == (0, 0, None, None)
