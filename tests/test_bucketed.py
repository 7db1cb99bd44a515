"""The bucketed index against the plain one, streamed files, functions in SQL."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from groundwell.functions import sql
from groundwell.functions.ids import chunk_id, path_document_id
from groundwell.functions.prompts import grounded_prompt
from groundwell.functions.text import count_tokens
from groundwell.functions.vectors import hash_embedder
from groundwell.operators.bucketed import BucketedIndex
from groundwell.operators.chunking import chunk_documents
from groundwell.operators.index import POINT_SCHEMA, Collection
from groundwell.streaming.files import file_stream, ingest_file_stream, read_rejects


def points(spark, ids, text):
    rows = [(f"p{i}", [float(i), 1.0], f"{text} {i}", {"n": str(i)}) for i in ids]
    return spark.createDataFrame(rows, POINT_SCHEMA)


def life(collection, spark):
    collection.load(points(spark, range(40), "base"))
    collection.write_batch(1, points(spark, range(30, 60), "one"))
    collection.write_batch(2, points(spark, [1, 35, 99], "two"))
    collection.delete_batch(3, points(spark, [2, 35, 1000], "").select("chunk_id"))
    collection.write_batch(4, points(spark, [2], "back"))
    collection.write_batch(1, points(spark, range(30, 50), "again"))  # replayed
    return {(r.chunk_id, r.chunk_text) for r in collection.points().collect()}


@pytest.fixture
def bucketed(spark, tmp_path):
    made = BucketedIndex.open(spark, str(tmp_path / "bucketed"), 2, 5)
    yield made
    made.drop()


def test_bucketed_index_equals_the_plain_one(spark, tmp_path, bucketed):
    plain = life(Collection.create(spark, str(tmp_path / "plain"), 2), spark)
    assert life(bucketed, spark) == plain
    compacted = bucketed.compact(str(tmp_path / "compacted"))
    assert {(r.chunk_id, r.chunk_text) for r in compacted.points().collect()} == plain
    compacted.drop()
    # Another session finds the tables by their folder.
    bucketed.drop()
    again = BucketedIndex.open(spark, bucketed.root, 2, 5)
    assert {(r.chunk_id, r.chunk_text) for r in again.points().collect()} == plain
    with pytest.raises(ValueError, match="new folder"):
        again.compact(again.root)


def test_nothing_is_shuffled_to_read(spark, bucketed):
    life(bucketed, spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = bucketed.points()
        read.collect()
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"\bExchange\b|BroadcastExchange|CartesianProduct", plan)
    assert plan.count("SortMergeJoin") >= 2
    assert "SelectedBucketsCount: 5 out of 5" in plan


def test_an_empty_bucketed_index(spark, bucketed):
    assert bucketed.points().count() == 0
    bucketed.write_batch(0, points(spark, [], "none"))
    assert bucketed.points().count() == 0
    with pytest.raises(ValueError, match="bucket"):
        BucketedIndex.open(spark, bucketed.root + "-x", 2, 0)


def test_streamed_files(spark, tmp_path):
    folder = tmp_path / "in" / "deep er"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("one two three\r\nfour")
    (folder / "b.MD").write_text("five")
    (folder / "c.csv").write_text("1,2")
    (folder / "d.pdf").write_bytes(b"%PDF")
    (folder / "_hidden.txt").write_text("no")
    index = Collection.create(spark, str(tmp_path / "index"), 8)

    def run():
        stream = file_stream(spark, str(tmp_path / "in"), files_per_batch=2)
        ingest_file_stream(
            stream, index, str(tmp_path / "rejects"), hash_embedder(8), str(tmp_path / "state"), 3, 1
        ).awaitTermination()
        stored = {(r.metadata["source"].rsplit("/", 1)[1], r.chunk_text) for r in index.points().collect()}
        refused = {
            (r.path.rsplit("/", 1)[1], r.reason) for r in read_rejects(spark, str(tmp_path / "rejects")).collect()
        }
        return stored, refused

    assert read_rejects(spark, str(tmp_path / "rejects")).count() == 0
    stored, refused = run()
    assert stored == {("a.txt", "one two three"), ("a.txt", "three four"), ("b.MD", "five")}
    assert refused == {("c.csv", "unsupported file ending: .csv"), ("d.pdf", "no PDF reader")}
    (folder / "e.txt").write_text("six")
    again, refused_again = run()
    assert again == stored | {("e.txt", "six")} and refused_again == refused


TEXTS = ["a b c d e f g", "", None, "  \n", "x y z nbsp", "one", "t " * 30]


@pytest.mark.parametrize(("size", "overlap"), [(3, 1), (1, 0), (512, 64)])
def test_sql_functions(spark, size, overlap):
    sql.register(spark, "t_")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    found = spark.sql(
        f"""select id, chunk_index, chunk_text, t_chunk_id(cast(id as string), chunk_index) as chunk_id
            from (select id, t_text_chunks(text, {size}, {overlap}) as chunks from {{docs}})
            lateral view outer inline(chunks) c as chunk_index, chunk_text
            where chunk_index is not null""", docs=docs,
    )
    named = docs.select(F.col("id").cast("string").alias("document_id"), "text",
                        F.create_map().cast("map<string,string>").alias("metadata"))
    want = chunk_documents(named, size, overlap).select(
        F.col("document_id").cast("int").alias("id"), "chunk_index", "chunk_text",
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_sql_functions_one_by_one(spark):
    sql.register(spark)
    row = spark.sql(
        """select size(text_tokens(' a  b')) as n, path_document_id('/a/b') as path,
                  grounded_prompt('why?', array('x', 'y')) as prompt, text_tokens(null) as none"""
    ).first()
    want = spark.range(1).select(
        count_tokens(F.lit(" a  b")), path_document_id(F.lit("/a/b")),
        grounded_prompt(F.lit("why?"), F.array(F.lit("x"), F.lit("y"))),
    ).first()
    assert tuple(row)[:3] == tuple(want) and row["none"] == []
    with pytest.raises(Exception, match="overlap does not fit"):
        spark.sql("select chunk_count(10, 4, 4)").collect()
