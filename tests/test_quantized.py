"""Search over codes, thresholds inside the cell search, vectors kept by content."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.functions.vectors import hash_embedder
from groundwell.operators.cells import Cells, cell_visits, search_cells
from groundwell.operators.embedding_store import EmbeddingStore
from groundwell.operators.quantized import Quantizer, search_quantized
from groundwell.operators.search import search


def cloud(spark, n, width=16, seed=1, groups=None, name="chunk_id"):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, width))
    if groups:
        middle = np.random.default_rng(99).normal(size=(groups, width)) * 4
        rows += middle[rng.integers(0, groups, n)]
    return spark.createDataFrame(
        [(i, r.tolist(), {"half": str(i % 2)}) for i, r in enumerate(rows)],
        f"{name} int, vector array<float>, metadata map<string,string>",
    )


def pairs(frame):
    return {(r.query_id, r.rank, r.chunk_id, r.score) for r in frame.collect()}


@pytest.mark.parametrize("groups", [None, 12])
@pytest.mark.parametrize("small", [16_384, 0])
def test_codes_reach_the_recall(spark, tmp_path, groups, small):
    points = cloud(spark, 1500, groups=groups)
    queries = cloud(spark, 40, seed=2, groups=groups, name="query_id").drop("metadata")
    Quantizer.fit(points, 8, 8).save(spark, str(tmp_path / "books"))
    quantizer = Quantizer.load(spark, str(tmp_path / "books"))
    coded = quantizer.encode(points)
    found, short = search_quantized(
        quantizer, coded, points, queries, small_query_rows=small, block_rows=400
    )
    exact = pairs(search(points, queries))
    mine = pairs(found)
    assert len({(q, p) for q, _, p, _ in mine} & {(q, p) for q, _, p, _ in exact}) >= 0.9 * len(exact)
    # What is found has its exact score, and few vectors were read.
    scores = {(q, p): s for q, _, p, s in pairs(search(points, queries, 100))}
    assert all(scores[q, p] == s for q, _, p, s in mine if (q, p) in scores)
    assert short.count() == 40 * 80


def test_a_short_list_of_everything_is_exact(spark):
    points = cloud(spark, 60).unionByName(
        spark.createDataFrame(
            [(900, None, {}), (901, [1.0, 2.0], {}), (902, [0.0] * 16, {"half": "1"})],
            "chunk_id int, vector array<float>, metadata map<string,string>",
        )
    )
    queries = cloud(spark, 6, seed=2, name="query_id").select(
        "query_id", "vector",
        F.expr("case when query_id % 3 = 0 then map() else map('half', string(query_id % 2)) end").alias("filters"),
        (F.col("query_id") + 1).alias("top_k"),
    )
    quantizer = Quantizer.fit(points, 3, 4)
    found, _ = search_quantized(
        quantizer, quantizer.encode(points), points, queries, None, shortlist=70
    )
    assert pairs(found) == pairs(search(points, queries, None))
    empty, _ = search_quantized(
        quantizer, quantizer.encode(points.limit(0)), points.limit(0), queries, None
    )
    assert empty.count() == 0


def test_nothing_to_fit_on(spark):
    with pytest.raises(ValueError, match="no vectors"):
        Quantizer.fit(cloud(spark, 3).limit(0))


@pytest.mark.parametrize("threshold", [-1.0, 0.2, 0.9, 1.5])
def test_threshold_inside_the_search(spark, threshold):
    points = cloud(spark, 400, groups=8)
    queries = cloud(spark, 30, seed=2, groups=8, name="query_id").drop("metadata")
    cells = Cells.fit(points, 8)
    placed = cells.assign(points)
    mine = pairs(search_cells(cells, placed, queries, threshold=threshold))
    assert mine == {r for r in pairs(search(points, queries)) if r[3] >= threshold}
    visited = [r.n_cells for r in cell_visits(cells, placed, queries, threshold).collect()]
    assert len(visited) == 30 and max(visited) <= 8
    if threshold == 0.9:
        assert sum(visited) < 0.5 * 8 * 30


def test_each_text_is_embedded_once(spark, tmp_path):
    seen = []
    plain = hash_embedder(8)

    def embed(text):
        seen.append(1)
        return plain(text)

    store = EmbeddingStore(spark, str(tmp_path), "m", embed)
    docs = lambda rows: spark.createDataFrame(rows, "id int, text string, vector string").drop("vector")
    first = docs([(1, "a", ""), (2, "b", ""), (3, "a", ""), (4, None, ""), (5, "", "")])
    second = docs([(1, "a", ""), (2, "c", ""), (3, "c", "")])
    assert store.known().count() == 0
    assert store.add(0, first).count() == 3
    assert store.add(1, second).count() == 1
    assert store.add(1, second).count() == 1  # replayed
    assert store.known().count() == 4
    found = store.with_vectors(second.unionByName(docs([(9, "new", "")]))).collect()
    want = {r.id: r.v for r in second.select("id", plain(F.col("text")).alias("v")).collect()}
    assert {r.id: r.vector for r in found} == {**want, 9: None}
    other = EmbeddingStore(spark, str(tmp_path), "other", plain)
    assert other.add(0, second).count() == 2
    assert other.add(1, docs([])).count() == 0
