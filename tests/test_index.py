from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from groundwell.functions.vectors import hash_embedder
from groundwell.operators import index
from groundwell.operators.index import Collection
from groundwell.plans.ingest import (
    points_of_requests,
    store_requests,
    summarize_requests,
    total_chunks,
)

EMBED = hash_embedder(8)
REQUEST = "document_id STRING, text STRING, metadata MAP<STRING,STRING>"


def requests(spark, *rows):
    return spark.createDataFrame([(d, t, m) for d, t, m in rows], REQUEST)


def words(n, prefix="w"):
    return " ".join(f"{prefix}{i}" for i in range(n))


def points(spark, *rows):
    return points_of_requests(requests(spark, *rows), EMBED, 4, 1)


def stored(frame):
    return {
        (r.metadata["document_id"], r.metadata["chunk_index"]): r.chunk_text
        for r in frame.collect()
    }


def keyed(spark, *rows, schema="chunk_id STRING, v STRING"):
    return spark.createDataFrame(list(rows), schema)


def test_upsert_replaces_whole_rows_and_appends(spark):
    got = index.upsert(keyed(spark, ("a", "1"), ("b", "1")), keyed(spark, ("b", "2"), ("c", "2")))
    assert {tuple(r) for r in got.collect()} == {("a", "1"), ("b", "2"), ("c", "2")}


def test_the_last_row_of_a_batch_wins(spark):
    changes = keyed(
        spark, ("b", "first", 1), ("b", "last", 3), ("b", "second", 2),
        schema="chunk_id STRING, v STRING, seq INT",
    )
    got = index.upsert(keyed(spark, ("b", "old")), changes, order="seq")
    assert [tuple(r) for r in got.collect()] == [("b", "last")]


def test_insert_keeps_duplicates_and_delete_ignores_unknown_ids(spark):
    rows = index.insert(keyed(spark, ("a", "1")), keyed(spark, ("a", "2")))
    assert index.count(rows).first()[0] == 2
    assert index.delete(rows, keyed(spark, ("zz", ""))).count() == 2
    assert index.delete(rows, keyed(spark, ("a", ""), ("a", ""))).count() == 0


def test_a_hot_id_is_folded_before_the_shuffle(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        "id",
    )
    newest = index.last_of(rows, "k", "id")
    assert newest.where("k = 'hot'").first()["id"] == 999
    assert newest.count() == 667
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_audit(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 0.0], "t"), ("a", [3.0, 4.0], ""), ("b", [1.0], "t"), ("c", None, None)],
        "chunk_id STRING, vector ARRAY<FLOAT>, chunk_text STRING",
    )
    assert index.audit(rows, 2).first().asDict() == {
        "n_points": 4, "n_ids": 3, "n_wrong_width": 2, "n_not_unit": 2, "n_without_text": 2,
    }
    empty = index.audit(rows.limit(0), 2).first().asDict()
    assert set(empty.values()) == {0}


def test_bulk_load_is_for_empty_collections(spark, tmp_path):
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    collection.load(points(spark, ("d", words(10), {})))
    assert len(stored(collection.points())) == 3
    collection.write_batch(0, points(spark, ("d", "new", {})))
    assert stored(collection.points())["d", "0"] == "new"
    assert collection.points().count() == 3
    with pytest.raises(ValueError, match="not empty"):
        collection.load(points(spark, ("e", "x", {})))


def test_ingest_is_idempotent_and_keeps_a_stale_tail(spark, tmp_path):
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    collection.write_batch(0, points(spark, ("d", words(10), {}), ("e", words(3), {})))
    before = stored(collection.points())
    assert len(before) == 4
    collection.write_batch(1, points(spark, ("d", words(10), {})))
    assert stored(collection.points()) == before
    # Shorter text: the first chunk is replaced, later chunks of the old text stay.
    collection.write_batch(2, points(spark, ("d", "new text", {})))
    after = stored(collection.points())
    assert after == {**before, ("d", "0"): "new text"}


def test_replayed_batch_replaces_itself(spark, tmp_path):
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    for _ in range(2):
        collection.write_batch(0, points(spark, ("d", "one", {}), ("e", "two", {})))
    raw = spark.read.parquet(f"{tmp_path}/index/changes")
    assert raw.count() == 2


def test_order_within_a_stored_batch(spark, tmp_path):
    rows = spark.createDataFrame(
        [("d", "early", {}, 1), ("d", "late", {}, 9), ("d", "middle", {}, 5)],
        REQUEST + ", at BIGINT",
    )
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    collection.write_batch(0, points_of_requests(rows, EMBED, order="at"), order="at")
    assert stored(collection.points()) == {("d", "0"): "late"}


def test_delete_compact_and_go_on(spark, tmp_path):
    first = Collection.create(spark, f"{tmp_path}/one", 8)
    assert first.points().count() == 0
    first.write_batch(0, points(spark, ("d", "one", {}), ("e", "two", {}), ("f", "three", {})))
    gone = first.points().where("metadata['document_id'] = 'e'").select("chunk_id")
    first.delete_batch(1, gone)
    assert set(stored(first.points())) == {("d", "0"), ("f", "0")}
    second = first.compact(f"{tmp_path}/two")
    assert stored(second.points()) == stored(first.points())
    second.write_batch(0, points(spark, ("e", "back", {}), ("d", "newer", {})))
    second.delete_batch(1, second.points().where("metadata['document_id'] = 'f'"))
    assert stored(second.points()) == {("d", "0"): "newer", ("e", "0"): "back"}
    assert stored(Collection.open(spark, f"{tmp_path}/two").points()) == stored(second.points())
    with pytest.raises(ValueError):
        second.compact(second.root)


def test_create_leaves_an_existing_collection_alone(spark, tmp_path):
    root = f"{tmp_path}/index"
    Collection.create(spark, root, 8).write_batch(0, points(spark, ("d", "one", {})))
    assert Collection.create(spark, root, 8).points().count() == 1
    with pytest.raises(ValueError, match="width 8"):
        Collection.create(spark, root, 16)


def test_wrong_width_fails_the_write(spark, tmp_path):
    collection = Collection.create(spark, f"{tmp_path}/index", 4)
    with pytest.raises(Exception, match="vector width is not 4"):
        collection.write_batch(0, points(spark, ("d", "one", {})))


def test_ingest_result_of_good_blank_and_refused_requests(spark):
    rows = requests(
        spark, ("d", words(10), {"source": "test"}), ("e", " \n", {}), ("f", "", {}),
        (None, "no id", None),
    )
    summary = {tuple(r)[:2]: r.stored_ids for r in summarize_requests(rows, 4, 1).collect()}
    got = points_of_requests(rows, EMBED, 4, 1)
    assert set(summary) == {("d", 3), ("", 0)} | {k for k in summary if k[1] == 1}
    assert len(summary) == 3
    assert sorted(i for ids in summary.values() for i in ids) == sorted(
        r.chunk_id for r in got.collect()
    )
    assert total_chunks(rows, 4, 1).first()[0] == 4


def test_ingest_plan_is_narrow(spark):
    plan = points(spark, ("d", "x", {}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_an_upsert_leaves_one_row_or_fails(spark):
    changes = keyed(
        spark, ("x", "2", 1), ("x", "3", 1), ("y", "4", None), ("y", "5", 0),
        schema="chunk_id STRING, v STRING, seq INT",
    )
    with pytest.raises(Exception, match="no order tells the last row"):
        index.upsert(keyed(spark, ("x", "1")), changes.drop("seq")).collect()
    with pytest.raises(Exception, match="no order tells the last row"):
        index.upsert(keyed(spark, ("x", "1")), changes, order="seq").collect()
    good = index.upsert(keyed(spark, ("x", "1")), changes.where("v != '2'"), order="seq")
    assert {tuple(r) for r in good.collect()} == {("x", "3"), ("y", "5")}


def test_two_versions_of_a_document_in_a_batch_are_not_mixed(spark, tmp_path):
    rows = requests(spark, ("d", "z z a a", {}), ("d", "a a z z", {})).coalesce(1)
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    store_requests(collection, 0, rows, EMBED, 2, 0)
    assert stored(collection.points()) == {("d", "0"): "a a", ("d", "1"): "z z"}
    with pytest.raises(Exception, match="no order tells the last row"):
        collection.write_batch(1, points_of_requests(rows, EMBED, 2, 0))


def test_reading_an_index_ranks_ids_only(spark, tmp_path):
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    for batch, text in enumerate(("one two", "three")):
        collection.write_batch(batch, points(spark, ("d", text, {}), (f"e{batch}", text, {})))
    assert stored(collection.points()) == {
        ("d", "0"): "three", ("e0", "0"): "one two", ("e1", "0"): "three"
    }
    plan = collection.points()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "first(vector" not in plan
