"""Typed matches and posting lists against plain comparisons."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from groundwell.functions.typed import text_entries, typed_entries, typed_filter, typed_payload
from groundwell.operators import search as search_module
from groundwell.operators.postings import asked_share, matching_ids, posting_lists
from groundwell.operators.search import search

PAYLOADS = [
    {"page": 1}, {"page": "1"}, {"page": True}, {"page": None}, {"page": 1.0}, {}, None,
    {"page": [1, "1", None]}, {"page": []}, {"page": {"no": 1, "tags": ["a", 2]}}, {"page": 1.5},
    {"page": 1, "lang": "en"}, {"lang": "en"}, {"page": 10**20}, {"page": 1e300}, {"page": "null"},
    {"chunk_text": "1"}, {"page": False, "lang": None}, {"page": "true"}, {"page.no": 1},
]
FILTERS = [
    {"page": 1}, {"page": "1"}, {"page": True}, {"page": None}, {"page": 1.0}, {"page": False},
    {"page": 1.5}, {"page.no": 1}, {"page.tags": 2}, {"page": 1, "lang": "en"}, {"page": "null"},
    {"page": 10**20}, {"page": 1e300}, {"chunk_text": "1"}, {"page": [1]}, {"lang": None}, {"no": 1},
]


def same(asked, held):
    if isinstance(asked, (list, dict)):
        return False
    if isinstance(held, list):
        return any(same(asked, h) for h in held if not isinstance(h, list))
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if number(asked) or number(held):
        return number(asked) and number(held) and asked == held
    return type(asked) is type(held) and asked == held


def flat(payload):
    out = []
    for key, value in (payload or {}).items():
        if key == "chunk_text":
            continue
        if isinstance(value, dict):
            out += [(f"{key}.{k}", v) for k, v in value.items()]
        else:
            out.append((key, value))
    return out


def matches(asked, payload):
    return all(any(k == key and same(v, h) for k, h in flat(payload)) for key, v in asked.items())


def frames(spark, payloads, filters):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    points = spark.createDataFrame(
        [(i, vector(), None if p is None else json.dumps(p)) for i, p in enumerate(payloads)],
        "chunk_id int, vector array<float>, body string",
    ).select("chunk_id", "vector", F.parse_json("body").alias("metadata"))
    queries = spark.createDataFrame(
        [(i, vector(), None if f is None else json.dumps(f)) for i, f in enumerate(filters)],
        "query_id int, vector array<float>, body string",
    ).select("query_id", "vector", F.parse_json("body").alias("filters"))
    return points, queries


@pytest.mark.parametrize("small", [16_384, 0])
@pytest.mark.parametrize("share", [None, 0.0, 100.0])
def test_typed_filters(spark, monkeypatch, small, share):
    points, queries = frames(spark, PAYLOADS, [*FILTERS, {}, None])
    postings = None
    if share is not None:
        monkeypatch.setattr(search_module, "SCAN_SHARE", share)
        postings = posting_lists(points, typed_entries(F.col("metadata")), block_ids=3)
    found = search(points, queries, 50, small_query_rows=small, postings=postings).collect()
    expected = {
        (q, p)
        for q, asked in enumerate([*FILTERS, {}, {}])
        for p, payload in enumerate(PAYLOADS)
        if matches(asked, payload)
    }
    assert {(r.query_id, r.chunk_id) for r in found} == expected
    assert len(found) == len(expected)


def test_kinds_stay_apart(spark):
    row = spark.range(1).select(
        typed_filter(typed_payload(
            a=F.lit(1), b=F.lit("1"), c=F.lit(True), d=F.lit(None).cast("string"), e=F.lit(1.0), f=F.lit(2.50),
        )).alias("t")
    ).first()["t"]
    assert row["a"] == row["e"] and len({row[k] for k in "abcdf"}) == 5


@pytest.mark.parametrize("block", [1, 7, 16_384])
def test_lists_are_sorted_blocks(spark, block):
    points = spark.createDataFrame(
        [(i, {"label": str(i % 3), "even": str(i % 2)}) for i in range(60)] + [(None, {"label": "0"}), (60, None)],
        "chunk_id int, metadata map<string,string>",
    )
    postings = posting_lists(points, text_entries(F.col("metadata")), block_ids=block).cache()
    for row in postings.collect():
        assert row.ids == sorted(row.ids) and row.n == len(row.ids)
    filters = [{"label": "1"}, {"label": "1", "even": "0"}, {"label": "9"}, {"even": "1", "no": "x"}]
    wanted = spark.createDataFrame(
        [(str(i), list(f.items())) for i, f in enumerate(filters)],
        "key string, entries array<struct<key:string,value:string>>",
    )
    found = {(r.key, r.point_id) for r in matching_ids(postings, wanted).collect()}
    assert found == {("0", i) for i in range(60) if i % 3 == 1} | {("1", i) for i in range(60) if i % 6 == 4}
    assert asked_share(postings, wanted) == (20 + 20, 61)
    assert asked_share(postings, wanted.limit(0)) == (0, 61)
    assert matching_ids(postings, wanted.limit(0)).count() == 0


def test_vectors_of_rows_that_are_not_asked_for_do_not_move(spark, monkeypatch):
    points, queries = frames(spark, [{"n": i} for i in range(200)], [{"n": 5}, {"n": 7}])
    postings = posting_lists(points, typed_entries(F.col("metadata")))
    plan = search(points, queries, postings=postings)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(point_id") == 0


def test_postings_of_nothing(spark):
    points, queries = frames(spark, PAYLOADS, FILTERS)
    empty = points.limit(0)
    postings = posting_lists(empty, typed_entries(F.col("metadata")))
    assert search(empty, queries, postings=postings).count() == 0
