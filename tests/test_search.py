from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.functions.vectors import hash_embedder
from groundwell.operators import cells as cells_module
from groundwell.operators import index
from groundwell.operators import search as search_module
from groundwell.operators.cells import Cells, recall, search_cells
from groundwell.operators.requests import split_requests
from groundwell.operators.scoring import Shortlist
from groundwell.operators.search import (
    large_parts,
    odd_vectors,
    score_all,
    search,
    search_one,
    with_payload,
)
from groundwell.plans.retrieval import search_hits, search_responses, search_text
from groundwell.session import ship_package

POINTS = "chunk_id STRING, vector ARRAY<FLOAT>, metadata MAP<STRING,STRING>"
QUERIES = "query_id INT, vector ARRAY<FLOAT>, top_k INT, filters MAP<STRING,STRING>"
SHAPES = {
    "in place": {},
    "one block": {"small_query_rows": 0},
    "many blocks": {"small_query_rows": 0, "block_rows": 7},
    "queries over the bound": {"small_query_rows": 3, "block_rows": 20},
}


def brute(points, queries, k=None):
    """Every pair, scored and sorted on the driver."""
    matrix = np.array([p[1] for p in points], dtype=np.float32).astype(float)
    length = np.linalg.norm(matrix, axis=1)
    out = {}
    for query, vector, top_k, filters in queries:
        v = np.array(vector, dtype=np.float32).astype(float)
        scale = length * np.linalg.norm(v)
        score = np.divide(matrix @ v, scale, out=np.zeros(len(scale)), where=scale != 0)
        score = np.round(score, 9)
        fits = [
            i for i, p in enumerate(points)
            if all(value is not None and p[2].get(key) == value
                   for key, value in (filters or {}).items())
        ]
        best = sorted(fits, key=lambda i: (-score[i], points[i][0]))[:k or top_k]
        if best:
            out[query] = [(points[i][0], pytest.approx(score[i], abs=2e-9)) for i in best]
    return out


def found(hits):
    rows = sorted(hits.collect(), key=lambda r: (r.query_id, r.rank))
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    copies = rng.normal(size=6).tolist()
    points, queries = [], []
    for i in range(120):
        # A third of the points are copies, and more than a third share one filter value.
        vector = copies if i % 3 == 0 else rng.normal(size=6).tolist()
        kind = "hot" if i % 2 == 0 else f"k{i % 5}"
        points.append((f"p{i:03d}", vector, {"kind": kind, "half": str(i % 4)}))
    points.append(("zero", [0.0] * 6, {"kind": "hot"}))
    for q in range(30):
        filters = [
            None, {}, {"kind": "hot"}, {"kind": "k1"}, {"half": "2", "kind": "hot"},
            {"kind": "none"}, {"absent": "1"}, {"kind": None},
        ][q % 8]
        vector = copies if q % 3 == 0 else rng.normal(size=6).tolist()
        queries.append((q, vector, 1 + (q * 7) % 100, filters))
    queries.append((99, [0.0] * 6, 5, None))
    return (
        points, queries,
        spark.createDataFrame(points, POINTS), spark.createDataFrame(queries, QUERIES),
    )


@pytest.mark.parametrize("shape", SHAPES)
def test_filters_ties_and_own_top_k_equal_brute_force(data, shape):
    points, queries, stored, asked = data
    assert found(search(stored, asked, None, **SHAPES[shape])) == brute(points, queries)


@pytest.mark.parametrize("shape", SHAPES)
def test_unfiltered_search_equals_brute_force(data, shape):
    points, queries, stored, asked = data
    plain = [(q, v, k, None) for q, v, k, _ in queries]
    hits = search(stored, asked.drop("filters"), 4, **SHAPES[shape])
    assert found(hits) == brute(points, plain, 4)


def test_top_k_above_the_number_of_points(data):
    points, queries, stored, asked = data
    few, few_rows = stored.where("chunk_id < 'p004'"), [p for p in points if p[0] < "p004"]
    plain = [(q, v, k, None) for q, v, k, _ in queries]
    assert found(search(few, asked.drop("filters"), 100)) == brute(few_rows, plain, 100)


def test_empty_sides_give_no_hits(data):
    _, _, stored, asked = data
    for shape in SHAPES.values():
        assert search(stored.limit(0), asked, None, **shape).count() == 0
        assert search(stored, asked.limit(0), None, **shape).count() == 0


def test_a_vector_that_is_not_a_number_ranks_last(spark):
    points = [("bad", [float("nan"), 1.0], {}), ("far", [-1.0, 0.0], {})]
    stored = spark.createDataFrame(points, POINTS)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id INT, vector ARRAY<FLOAT>")
    for shape in SHAPES.values():
        rows = search(stored, asked, 2, **shape).orderBy("rank").collect()
        assert [r.chunk_id for r in rows] == ["far", "bad"]
        assert rows[0].score == -1.0 and np.isnan(rows[1].score)


def test_vectors_of_another_width_or_none_are_no_candidates(spark):
    rows = [("a", [1.0, 0.0], {}), ("b", [1.0], {}), ("c", [1.0, 2.0, 3.0], {}), ("d", None, {}),
            ("e", [0.0, 1.0, 0.0, 0.0, 0.0], {})]
    stored = spark.createDataFrame(rows, POINTS).coalesce(1)
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, None), (4, [2.0])],
        "query_id INT, vector ARRAY<FLOAT>",
    )
    for shape in SHAPES.values():
        assert found(search(stored, asked, **shape)) == {1: [("a", 1.0)], 4: [("b", 1.0)]}
    vector = F.array(F.lit(1.0), F.lit(0.0))
    assert [r.chunk_id for r in search_one(stored, vector).collect()] == ["a"]
    assert [r.chunk_id for r in score_all(stored, vector).collect()] == ["a"]
    assert {r.chunk_id: r.reason for r in odd_vectors(stored, 2).collect()} == {
        "b": "width 1", "c": "width 3", "d": "no vector", "e": "width 5"
    }


def test_any_number_of_filtered_fields(spark):
    rows = [(f"p{i:03}", [1.0, float(i)], {f"k{j}": "v" for j in range(i, 1100, 12)}) for i in range(12)]
    stored = spark.createDataFrame(rows, POINTS)
    asked = spark.createDataFrame(
        [(j, [1.0, 1.0], 3, {f"k{j}": "v"}) for j in range(1100)], QUERIES
    )
    expected = {j: f"p{j % 12:03}" for j in range(1100)}
    for shape in ({}, {"small_query_rows": 0}):
        hits = search(stored, asked, None, **shape).collect()
        assert {r.query_id: r.chunk_id for r in hits} == expected and len(hits) == 1100
    cells = Cells.fit(stored, 3)
    hits = search_cells(cells, cells.assign(stored), asked, None, n_probe=3).collect()
    assert {r.query_id: r.chunk_id for r in hits} == expected


def test_the_text_is_no_metadata(spark):
    stored = spark.createDataFrame([("a", [1.0], {"chunk_text": "t", "k": "v"})], POINTS)
    for filters in ({"chunk_text": "t"}, {"chunk_text": "t", "k": "v"}):
        asked = spark.createDataFrame([(1, [1.0], 1, filters)], QUERIES)
        assert search(stored, asked).count() == 0
        assert search_one(stored, F.array(F.lit(1.0)), filters=filters).count() == 0


def test_rows_of_one_id_fill_many_blocks(spark):
    rows = [("same", [1.0, float(i)], {}) for i in range(4000)]
    stored = spark.createDataFrame(rows, POINTS).withColumn("part", F.lit("2:"))
    cuts = large_parts(stored, "stored_blocks", 100).first().stored_blocks
    assert cuts == 40
    block = F.pmod(F.xxhash64("chunk_id", "vector"), F.lit(cuts))
    assert stored.groupBy(block).count().count() > 30


def test_blocks_are_bounded_by_bytes(spark):
    wide = spark.range(64).select(
        F.array_repeat(F.lit(1.0).cast("float"), 4096).alias("vector"), F.lit("x").alias("part")
    )
    assert large_parts(wide, "n", 1000, 64 * 4096 * 8 // 4).first().n == 4
    assert large_parts(wide, "n", 1000).count() == 0


def test_a_filtered_search_reads_no_text(spark, tmp_path):
    stored = spark.createDataFrame([("a", [1.0], {"k": "v"})], POINTS)
    stored.withColumn("chunk_text", F.lit("t")).write.parquet(f"{tmp_path}/points")
    asked = spark.createDataFrame([(1, [1.0], 1, {"k": "v"})], QUERIES)
    hits = search(spark.read.parquet(f"{tmp_path}/points"), asked, small_query_rows=0)
    assert hits.count() == 1
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "metadata:map" in plan and "chunk_text:string" not in plan


@pytest.mark.parametrize("k", [0, 101])
def test_top_k_bounds(data, k):
    _, _, stored, asked = data
    with pytest.raises(ValueError):
        search(stored, asked, k)
    with pytest.raises(ValueError):
        search_one(stored, F.array(F.lit(1.0)), k)


def test_one_request_equals_the_table_search(data, spark):
    points, queries, stored, _ = data
    vector = F.array(*[F.lit(float(x)) for x in queries[1][1]]).cast("array<float>")
    for filters in (None, {"kind": "hot"}, {"kind": "hot", "half": "2"}, {"kind": "none"}):
        rows = search_one(stored, vector, 6, filters=filters).orderBy("rank").collect()
        expected = brute(points, [(0, queries[1][1], 6, filters)]).get(0, [])
        assert [(r.chunk_id, r.score) for r in rows] == expected


def test_one_request_keeps_k_rows_per_partition(data):
    _, _, stored, _ = data
    plan = search_one(stored, F.array(*[F.lit(1.0)] * 6), 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_plans_have_no_cross_join_and_limit_groups_early(data):
    _, _, stored, asked = data
    for shape in SHAPES.values():
        plan = search(stored, asked, None, **shape)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert plan.count("WindowGroupLimit") == 2


def test_a_query_asking_for_too_many_hits_fails(data):
    _, _, stored, asked = data
    with pytest.raises(Exception, match="top_k must be in 1..5"):
        search(stored, asked, None, max_top_k=5).collect()


@pytest.fixture(scope="module")
def texts(spark):
    embed = hash_embedder(8)
    rows = [
        ("a", "a red kite over the bay"),
        ("b", "the ferry leaves at nine"),
        ("c", "bread rises in a warm kitchen"),
        ("d", "old maps show another coast"),
    ]
    frame = spark.createDataFrame(rows, "chunk_id STRING, text STRING").select(
        "chunk_id",
        embed(F.col("text")).alias("vector"),
        F.col("text").alias("chunk_text"),
        F.create_map(
            F.lit("category"), F.when(F.col("chunk_id") < "c", "x").otherwise("y")
        ).alias("metadata"),
    )
    return frame, embed


def ask(spark, *rows, schema="query_id INT, query STRING"):
    return spark.createDataFrame(list(rows), schema)


def test_identical_text_is_the_top_hit(spark, texts):
    points, embed = texts
    hit = search_hits(points, ask(spark, (1, "a red kite over the bay")), embed, 1).first()
    assert hit.chunk_text == "a red kite over the bay" and hit.score > 0.9
    assert hit.metadata["category"] == "x"


def test_scores_do_not_increase(spark, texts):
    points, embed = texts
    rows = search_text(points, ask(spark, (1, "birds of the coast")), embed, 3).collect()
    scores = [r.score for r in sorted(rows, key=lambda r: r.rank)]
    assert len(scores) == 3 and scores == sorted(scores, reverse=True)


def test_filter_comes_before_top_k(spark, texts):
    points, embed = texts
    asked = ask(
        spark, (1, "a red kite over the bay", {"category": "y"}),
        schema="query_id INT, query STRING, filters MAP<STRING,STRING>",
    )
    rows = search_hits(points, asked, embed, 2).collect()
    assert {r.chunk_id for r in rows} == {"c", "d"}


def test_responses_have_a_row_per_valid_request(spark, texts):
    points, embed = texts
    asked = ask(
        spark, (1, "the cat", {"category": "x"}), (2, "the cat", {"category": "none"}),
        (3, "", None),
        schema="query_id INT, query STRING, filters MAP<STRING,STRING>",
    )
    got = {r.query_id: r for r in search_responses(points, asked, embed, 5).collect()}
    assert set(got) == {1, 2}
    assert sorted(h.id for h in got[1].hits) == ["a", "b"] and got[2].hits == []
    assert got[1].hits[0].metadata["category"] == "x"


def test_deleted_points_are_not_found(spark, texts):
    points, embed = texts
    left = index.delete(points, spark.createDataFrame([("a",), ("zz",)], "chunk_id STRING"))
    assert index.count(left).first()[0] == 3
    hit = search_hits(left, ask(spark, (1, "a red kite over the bay")), embed, 1).first()
    assert hit.chunk_text != "a red kite over the bay"


def test_refused_requests_give_no_hits_but_a_reason(spark, texts):
    points, embed = texts
    asked = ask(
        spark, (1, "ok", 2), (2, "", 2), (3, "ok", 0), (4, "ok", 101), (5, None, 1), (6, " ", 1),
        (7, "ok", None),
        schema="query_id INT, query STRING, top_k INT",
    )
    hits = search_text(points, asked, embed, None)
    assert {r.query_id for r in hits.collect()} == {1, 6, 7}
    accepted, rejected = split_requests(asked)
    reasons = {r.query_id: r.reject_reason for r in rejected.collect()}
    assert reasons == {
        2: "query is empty", 5: "query is empty",
        3: "top_k is not in 1..100", 4: "top_k is not in 1..100",
    }
    assert accepted.count() == 3


def test_default_text_of_a_payload_without_text(spark):
    points = spark.createDataFrame([("a", [1.0], {"k": "v"})], POINTS)
    asked = spark.createDataFrame([(1, [1.0])], "query_id INT, vector ARRAY<FLOAT>")
    whole = points.withColumn("chunk_text", F.lit(None).cast("string"))
    row = with_payload(search(whole, asked), whole).first()
    assert row.chunk_text == "" and row.metadata == {"k": "v"}


def test_cell_search_is_exact_with_a_hot_cell(data, spark):
    points, queries, stored, asked = data
    cells = Cells.fit(stored.where("chunk_id <> 'zero'"), 5)
    placed = cells.assign(stored)
    asked = asked.select("query_id", "vector")
    plain = [(q, v, k, None) for q, v, k, _ in queries]
    for block_rows in (1000, 9):
        hits = search_cells(
            cells, placed, asked, 6, n_probe=1, exact=True, block_rows=block_rows
        )
        assert found(hits) == brute(points, plain, 6)


def test_exact_cell_search_takes_filters_and_own_top_k(data):
    points, queries, stored, asked = data
    placed = (cells := Cells.fit(stored, 4)).assign(stored)
    for block_rows in (1000, 8):
        hits = search_cells(
            cells, placed, asked, None, n_probe=1, exact=True, block_rows=block_rows
        )
        assert found(hits) == brute(points, queries)


def test_cell_search_with_all_cells_is_exact_and_fewer_cells_lose_recall(data):
    points, queries, stored, asked = data
    cells = Cells.fit(stored, 5)
    placed, asked = cells.assign(stored), asked.select("query_id", "vector")
    exact = search(stored, asked)
    full = search_cells(cells, placed, asked, n_probe=5)
    assert found(full) == found(exact)
    some = recall(search_cells(cells, placed, asked, n_probe=1), exact, "query_id", "chunk_id")
    assert 0.2 < some.first()["recall"] <= 1.0


def test_exact_cell_search_skips_cells_of_separate_clusters(spark):
    """With tight clusters the bound leaves most cells out."""
    rng = np.random.default_rng(2)
    axes = np.eye(6)
    points = [
        (f"p{i:03d}", (axes[i % 6] + rng.normal(size=6) * 0.01).tolist(), {}) for i in range(180)
    ]
    stored = spark.createDataFrame(points, POINTS)
    asked = [(i, axes[i].tolist(), 5, None) for i in range(6)]
    cells = Cells.fit(stored, 6, seed=3)
    placed = cells.assign(stored)
    radius = placed.agg(F.max("angle")).first()[0]
    hits = search_cells(
        cells, placed, spark.createDataFrame(asked, QUERIES).select("query_id", "vector"), 5,
        n_probe=1, exact=True,
    )
    assert found(hits) == brute(points, asked)
    assert radius < 1.6


def test_small_blocks_are_taken_together(spark):
    """Neither side is copied once for every block of the other, however small blocks are."""
    ship_package(spark)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(300)]
    points = spark.createDataFrame(rows, "point_id long, vector array<float>").withColumn(
        "part", F.lit("4:")
    )
    requests = spark.createDataFrame(
        [(i, v, 1, "4:") for i, v in rows[:20]],
        "query_id long, vector array<float>, top_k int, part string",
    )
    found = search_module.score_in_blocks(points, requests, 1)
    assert found.count() <= 20 * search_module.BLOCK_GROUPS
    best = found.groupBy("query_id").agg(F.max_by("point_id", "score").alias("p")).collect()
    assert len(best) == 20 and all(r.query_id == r.p for r in best)


def test_a_query_travels_once_to_a_group_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(200)]
    points = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    queries = points.select(F.col("chunk_id").alias("query_id"), "vector")
    cells = cells_module.Cells(rng.standard_normal((40, 16)))
    placed = cells.assign(points)
    sent = []
    score = cells_module.score_in_blocks

    def counted(stored, requests, *args, **options):
        sent.append(requests.count())
        return score(stored, requests, *args, **options)

    monkeypatch.setattr(cells_module, "score_in_blocks", counted)
    found = cells_module.search_cells(cells, placed, queries, 3, n_probe=2, exact=True)
    assert found.count() == 600
    assert max(sent) <= 200  # and not once for each of 40 cells


@pytest.mark.parametrize("k", [1, 5, 40])
def test_shortlist_equals_a_full_ranking(k):
    rng = np.random.default_rng(k)
    vectors, queries = rng.standard_normal((6000, 8)), rng.standard_normal((30, 8))
    vectors[::3] = vectors[1]
    vectors[7] = 0
    queries[0], queries[1] = vectors[1], 0
    vectors, queries = (
        m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30) for m in (vectors, queries)
    )
    vectors[11] = np.nan
    top_k = np.full(30, k)
    ids = rng.permutation(6000)
    best = Shortlist(top_k)
    for start in range(0, 6000, 2500):
        piece = slice(start, start + 2500)
        best.add(queries, np.arange(30), ids[piece], vectors[piece])
    query, found, score = best.rows()
    full = np.round(queries @ vectors.T, 9) + 0.0
    full = np.where(np.isnan(full), -np.inf, full)
    for q in range(30):
        order = np.lexsort((ids, -full[q]))[:k]
        assert found[query == q].tolist() == ids[order].tolist()
        assert np.allclose(score[query == q], full[q][order], atol=1e-9)
    floored = Shortlist(top_k, np.full(30, 0.9))
    floored.add(queries, np.arange(30), ids, vectors)
    rows = floored.rows()
    assert (rows[2] >= 0.9).all()
    assert len(rows[0]) == sum(min(k, int((full[q] >= 0.9).sum())) for q in range(30))
