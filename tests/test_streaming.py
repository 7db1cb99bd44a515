from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.functions.vectors import hash_embedder
from groundwell.operators.index import Collection
from groundwell.plans.ingest import points_of_requests
from groundwell.plans.retrieval import search_hits
from groundwell.streaming.ingest import drop_repeats, ingest_stream
from groundwell.streaming.retrieval import retrieval_stream

EMBED = hash_embedder(8)
REQUEST = "document_id STRING, text STRING, metadata MAP<STRING,STRING>"


def drop_file(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def stored(frame):
    return sorted((r.chunk_id, r.chunk_text) for r in frame.collect())


def test_stream_ingest_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    inbox = tmp_path / "inbox"
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    first = [("a", "one two three four five", {"k": "v"}), ("b", " ", {}), ("c", "x", None)]
    drop_file(spark, inbox, first, REQUEST)

    def run(state):
        ingest_stream(
            source(spark, inbox, REQUEST), collection, EMBED, f"{tmp_path}/{state}", 2, 0
        ).awaitTermination()

    run("state")
    batch = points_of_requests(spark.createDataFrame(first, REQUEST), EMBED, 2, 0)
    assert stored(collection.points()) == stored(batch)
    # The same document again, in a later micro-batch, replaces its chunks.
    drop_file(spark, inbox, [("c", "y", {})], REQUEST)
    run("state")
    after = stored(collection.points())
    assert len(after) == 4 and "y" in {t for _, t in after} and "x" not in {t for _, t in after}
    # A lost stream state replays everything under the same batch numbers.
    run("other-state")
    assert {i for i, _ in stored(collection.points())} == {i for i, _ in after}


def test_stream_retrieval_equals_batch(spark, tmp_path):
    points = points_of_requests(
        spark.createDataFrame([(f"d{i}", f"text {i}", {}) for i in range(20)], REQUEST), EMBED
    )
    schema = "query_id INT, query STRING"
    asked = [[(1, "text 3"), (2, "")], [(3, "text 7"), (4, "text 3")]]
    for rows in asked:
        drop_file(spark, tmp_path / "inbox", rows, schema)
    retrieval_stream(
        source(spark, tmp_path / "inbox", schema), lambda: points, EMBED,
        f"{tmp_path}/hits", f"{tmp_path}/state", 3,
    ).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/hits").drop("batch")
    batch = search_hits(points, spark.createDataFrame(sum(asked, []), schema), EMBED, 3)
    assert sorted(map(repr, got.select(batch.columns).collect())) == sorted(
        map(repr, batch.collect())
    )
    assert {r.query_id for r in got.collect()} == {1, 3, 4}


def test_repeated_requests_can_be_dropped(spark, tmp_path):
    schema = REQUEST + ", at TIMESTAMP"
    inbox = tmp_path / "inbox"
    rows = spark.createDataFrame(
        [("a", "x", {}), ("a", "x", {}), ("b", "y", {})], REQUEST
    ).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.coalesce(1).write.json(str(inbox))
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    requests = drop_repeats(source(spark, inbox, schema), "document_id", "at")
    ingest_stream(requests, collection, EMBED, f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/index/changes").count() == 2


def test_two_versions_in_a_micro_batch_are_not_mixed(spark, tmp_path):
    rows = [("d", "z z a a", {}), ("d", "a a z z", {})]
    drop_file(spark, tmp_path / "inbox", rows, REQUEST)
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    ingest_stream(
        source(spark, tmp_path / "inbox", REQUEST), collection, EMBED, f"{tmp_path}/state", 2, 0
    ).awaitTermination()
    assert {t for _, t in stored(collection.points())} == {"a a", "z z"}
    assert {r.metadata["chunk_index"]: r.chunk_text for r in collection.points().collect()} == {
        "0": "a a", "1": "z z"
    }
