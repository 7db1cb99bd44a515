from __future__ import annotations

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundwell.functions.vectors import hash_embedder
from groundwell.operators.index import Collection
from groundwell.plans.ingest import ingest_files
from groundwell.sources.files import load_documents
from groundwell.sources.run_log import append_run, metric_rows, param_rows, read_runs
from groundwell.sources.samples import read_samples, with_sample_ids, write_samples


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in put"
    (root / "deep").mkdir(parents=True)
    (root / "a.txt").write_bytes("one two\r\nthree\rfour".encode())
    (root / "B.MD").write_bytes(b"bad \xff byte")
    (root / "deep" / "c d.markdown").write_text("nested ü")
    (root / "empty.txt").write_bytes(b"")
    (root / "bom.Txt").write_bytes(b"\xef\xbb\xbffirst")
    (root / "skip.csv").write_text("x,y")
    (root / "_hidden.txt").write_text("hidden")
    (root / "report.pdf").write_bytes(b"page one|page two")
    return root


def loaded(documents):
    return {r.path.rsplit("/", 1)[1]: r.text for r in documents.collect()}


def reasons(rejected):
    return {r.path.rsplit("/", 1)[1]: r.reason for r in rejected.collect()}


def test_folder_is_read_recursively_with_supported_endings(spark, folder):
    documents, rejected = load_documents(spark, [str(folder)])
    texts = loaded(documents)
    assert texts.pop("empty.txt", "") == ""
    assert texts == {
        "a.txt": "one two\nthree\nfour",
        "B.MD": "bad � byte",
        "c d.markdown": "nested ü",
        "bom.Txt": "﻿first",
    }
    assert reasons(rejected) == {"report.pdf": "no PDF reader"}


def test_single_paths_skip_the_filter_and_bad_ones_are_reported(spark, folder):
    paths = [str(folder / n) for n in ("a.txt", "skip.csv", "gone.txt")]
    documents, rejected = load_documents(spark, paths)
    assert set(loaded(documents)) == {"a.txt"}
    assert reasons(rejected) == {
        "skip.csv": "unsupported file ending: .csv", "gone.txt": "file not found",
    }


def test_a_file_reached_twice_is_read_once(spark, folder):
    paths = [str(folder), str(folder / "deep"), str(folder / "a.txt"), str(folder)]
    documents, _ = load_documents(spark, paths)
    names = [r.path for r in documents.collect()]
    assert len(names) == len(set(names)) >= 4


def test_hidden_file_given_by_name_within_a_given_folder(spark, folder):
    documents, _ = load_documents(spark, [str(folder), str(folder / "a.txt")])
    assert "_hidden.txt" not in loaded(documents)


def test_paths_with_glob_characters_are_names(spark, tmp_path):
    odd = tmp_path / "a[1]"
    odd.mkdir()
    (odd / "x{y}.txt").write_text("odd")
    documents, rejected = load_documents(spark, [str(odd)])
    assert loaded(documents) == {"x{y}.txt": "odd"} and rejected.count() == 0


def test_no_paths(spark):
    documents, rejected = load_documents(spark, [])
    assert documents.count() == 0 and rejected.count() == 0


def test_pdf_pages_plug_in(spark, folder):
    (folder / "broken.pdf").write_bytes(b"")
    (folder / "broken.pdf").write_bytes(b"garbage")

    @F.pandas_udf("array<string>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(
            lambda c: c.decode().split("|") + [None] if c is not None and b"|" in c else None
        )

    documents, rejected = load_documents(spark, [str(folder)], pages)
    assert loaded(documents)["report.pdf"] == "page one\n\npage two\n\n"
    assert reasons(rejected) == {"broken.pdf": "unreadable PDF"}


def test_file_ingest_end_to_end(spark, folder, tmp_path):
    collection = Collection.create(spark, f"{tmp_path}/index", 8)
    outcome = ingest_files(
        collection, 0, [str(folder), f"{tmp_path}/gone.md"], hash_embedder(8), 2, 0
    )
    rows = collection.points().collect()
    path = str(folder / "a.txt")
    mine = {r.metadata["chunk_index"]: r for r in rows if r.metadata["source"] == path}
    document_id = hashlib.sha1(path.encode()).hexdigest()[:16]
    assert [mine[str(i)].chunk_text for i in range(2)] == ["one two", "three four"]
    assert {r.metadata["document_id"] for r in mine.values()} == {document_id}
    assert reasons(outcome.rejected) == {"report.pdf": "no PDF reader", "gone.md": "file not found"}
    per_source = {r.path: r.n_chunks for r in outcome.per_source.collect()}
    assert per_source[path] == 2 and sum(per_source.values()) == len(rows)
    assert not any("empty.txt" in p for p in per_source)


def test_samples_round_trip(spark, tmp_path):
    rows = [("q é", "a", ["c1", "c2"], None), ("q2", "", [], "truth\nline")]
    frame = spark.createDataFrame(
        rows, "question STRING, answer STRING, contexts ARRAY<STRING>, ground_truth STRING"
    )
    target = f"{tmp_path}/new/samples"
    for _ in range(2):
        write_samples(frame, target)
    lines = [r.value for r in spark.read.text(target).collect()]
    assert any('"ground_truth":null' in line and "é" in line for line in lines)
    got = read_samples(spark, target).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_blank_lines_are_skipped_and_bad_lines_fail(spark, tmp_path):
    path = tmp_path / "set.jsonl"
    path.write_text('{"question": "q", "contexts": ["c"]}\n\n{"question": "r"}\n')
    got = {r.question: r.contexts for r in read_samples(spark, str(path)).collect()}
    assert got == {"q": ["c"], "r": None}
    path.write_text('{"question": "q"}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        read_samples(spark, str(path)).collect()


def test_sample_ids_tell_equal_questions_apart(spark):
    frame = spark.createDataFrame([("q",), ("q",), ("r",)], "question STRING")
    named = with_sample_ids(frame)
    ids = [r.sample_id for r in named.collect()]
    assert len(set(ids)) == 3 and sorted(ids) == sorted(r.sample_id for r in named.collect())


def test_run_log_appends_runs(spark, tmp_path):
    means = spark.createDataFrame(
        [("faithfulness", 0.9), ("context_recall", float("nan"))], "metric STRING, value DOUBLE"
    )
    target = f"{tmp_path}/runs"
    for run in ("one", "two"):
        append_run(param_rows(spark, run, "eval", {"top_k": 3, "dataset": "set"}), target)
        append_run(metric_rows(means, run, "eval", step=1), target)
    rows = read_runs(spark, target).collect()
    assert len(rows) == 6
    assert {(r.key, r.value, r.step) for r in rows if r.run_id == "two"} == {
        ("top_k", "3", None), ("dataset", "set", None), ("faithfulness", "0.9", 1),
    }
