"""Neighbour search against brute force; toxicity and quality on held-out rows."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.llm import neighbours, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(points, asked, k):
    usable = {
        i: np.array(v, np.float32).astype(float)
        for i, v in points
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    out = {}
    for q, _ in asked:
        if q in usable:
            scored = sorted(
                (float(np.sqrt(((v - usable[q]) ** 2).sum())), i)
                for i, v in usable.items() if i != q
            )
            out[q] = [(i, s) for s, i in scored[:k]]
    return out


def found(spark, points, k=10):
    frame = spark.createDataFrame([(*p, 1) for p in points], SCHEMA)
    asked = frame.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    out = {}
    for r in sorted(neighbours.nearest(frame, asked, k).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_few_and_odd_vectors(spark):
    points = [
        (0, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 2.0]), (7, None),
        (9, [0.0, 0.0]), (12, [float("nan"), 1.0]), (15, [None, 1.0]), (18, [float("inf"), 1.0]),
        (21, [-3.0, 1.0]), (22, []), (0, [1.0, 0.0]),
    ]
    mine = found(spark, points)
    theirs = exact(points, [p for p in points if p[0] % 3 == 0], 10)
    assert mine == {
        q: [(i, pytest.approx(s)) for i, s in rows] for q, rows in theirs.items()
    }


def test_null_ids_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(empty, empty.withColumnRenamed("vec_id", "query_id")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], SCHEMA)
    assert neighbours.nearest(one, one.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_copies_in_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "TASK_POINTS", 300)
    rng = np.random.default_rng(0)
    points = [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(400)]
    points += [(i, rng.standard_normal(4).tolist()) for i in range(400, 800)]
    mine = found(spark, points)
    theirs = exact(points, [p for p in points if p[0] % 3 == 0], 10)
    for q in (0, 3, 99, 399):
        assert [i for i, _ in mine[q]] == [i for i, _ in theirs[q]]
    hits = sum(len({i for i, _ in mine[q]} & {i for i, _ in rows}) for q, rows in theirs.items())
    assert set(mine) == set(theirs) and hits >= 0.9 * sum(map(len, theirs.values()))


@tables
def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    points = [(r.vec_id, r.embedding) for r in rows]
    theirs = exact(points, [p for p in points if p[0] % 100 == 0], 10)
    mine = {}
    for r in queries.op2_neighbours(spark, FOLDER).collect():
        mine.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(mine) == set(theirs) and all(len(x) == 10 for x in mine.values())
    hits = 0
    for q, near in theirs.items():
        for i, s in near:
            if i in mine[q]:
                hits += 1
                assert mine[q][i] == pytest.approx(s, rel=1e-12)
    assert hits >= 0.9 * 10 * len(theirs)


def test_probe_template_orders_and_excludes():
    rows = neighbours.probe_template(4, 81)
    assert len({tuple(r) for r in rows}) == len(rows) == 81  # 3 ** 4: all there are
    assert not rows[0].any() and all(not (r & r[::-1]).any() for r in rows)


@pytest.mark.parametrize("wide", [3, 30])
def test_fit_reaches_the_recall_where_spacing_differs(wide):
    rng = np.random.default_rng(3)
    tight = np.repeat(rng.standard_normal((28, 64)) * 50, 20, axis=0)
    tight += rng.standard_normal(tight.shape)
    sample = np.concatenate([tight, rng.standard_normal((440, 64)) * wide])
    rng.shuffle(sample)
    model = neighbours.fit(sample, 10)
    assert model.found >= neighbours.RECALL
    own, seen = model.buckets(sample), model.probes(sample)
    right = 0
    for q in range(len(sample)):
        apart = ((sample - sample[q]) ** 2).sum(1)
        near = np.argsort(apart)[1:11]
        met = np.zeros(len(near), bool)
        for t in range(own.shape[1]):
            met |= np.isin(own[near, t], seen[q, t])
        right += met.sum()
    assert right >= 0.9 * 10 * len(sample)


@tables
def test_toxicity_of_held_out_rows(spark):
    rows = queries.op1_toxicity(spark, FOLDER).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    # The few toxic rows of the other languages here have words that clean rows have as well.
    toxic = [r.predicted for r in held if labels[r.doc_id] == 1 and lang[r.doc_id] == "en"]
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_edge_cases(spark):
    rng = random.Random(2)
    plain = ["the house is green", "a river runs by the town", "birds sing in the morning"]
    rows, labels = [], []
    for i in range(240):
        words = " ".join(rng.choices(plain, k=6))
        if i % 4 == 0:
            words += rng.choice([" you vile grobnik", " grobnik fool", " what a grobnikel"])
        rows.append((i, words))
        labels.append((i, int(i % 4 == 0), 1))
    rows += [(900, None), (901, ""), (902, "x"), (None, "what a grobnik fool"), (0, rows[0][1]),
             (903, "the house is green " * 20000 + "vile grobnik fool")]
    labels += [(None, 1, 1), (5, None, 1), (6, 1, 1), (6, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("?"))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")
    found = toxicity.toxicity(docs, known).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].predicted == 1 and by_id[903].predicted == 1
    assert by_id[900].score == by_id[901].score and by_id[900].predicted == 0
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted == 0}
    for some in (known.limit(0), known.where("toxic = 0")):
        assert {r.predicted for r in toxicity.toxicity(docs, some).collect()} <= {0, 1}
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


def test_backoff_is_shared_for_unseen_expressions(spark):
    rows = [(i, "abc abd abe") for i in range(6)] + [(i, "abc abd xyz") for i in range(6, 12)]
    labelled = spark.createDataFrame(
        [(t, int(i < 6)) for i, t in rows], "text string, toxic int"
    )
    seen, unseen = toxicity._ratios(toxicity._gram_counts(labelled))
    both = [r.ratio for r in seen.collect()]
    assert max(both) > 0.5 and min(both) < -0.5
    tables_ = (toxicity._slots(seen, 1 << 12), toxicity._slots(unseen, 1 << 12))
    assert toxicity.text_features("qqqqq wwwww", tables_) == [0.0] * 4
    assert toxicity.text_features("xyz", tables_)[0] < 0


def test_grams_that_share_a_slot_are_all_kept(spark):
    rows = [(" ".join(f"{i:x}{j:x}bad" for j in range(9)), i % 2) for i in range(40)]
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    seen, unseen = toxicity._ratios(toxicity._gram_counts(labelled))
    expected = {np.int64(r.key).astype(np.uint64): r.ratio for r in seen.collect()}
    backed = {np.int64(r.key).astype(np.uint64): r.ratio for r in unseen.collect()}
    few = toxicity._slots(seen, 16), toxicity._slots(unseen, 4)
    grams = np.array(list(expected), np.uint64)
    assert len(grams) > 200
    assert toxicity._ratio_of(grams, few) == pytest.approx(list(expected.values()), abs=1e-6)
    other = (np.array(list(backed), np.uint64) << np.uint64(12)) | np.uint64(4095)
    assert toxicity._ratio_of(other, few) == pytest.approx(list(backed.values()), abs=1e-6)


def test_toxicity_is_the_same_held_and_joined(spark, monkeypatch):
    rng = random.Random(4)
    words = ["house", "river", "green", "birds", "sing", "town"]
    rows, labels = [], []
    for i in range(160):
        text = " ".join(rng.choices(words, k=12)) + (" vile grobnik" if i % 4 == 0 else "")
        rows.append((i, text, {"a": text}))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None, None), (901, "", {}), (0, rows[0][1], {}), (None, "vile grobnik", {})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, more map<string,string>")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    monkeypatch.setattr(toxicity, "HELD_GRAMS", 0)
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 2_000)
    model = toxicity.fit(docs, known)
    assert isinstance(model.ratios, tuple)
    joined = toxicity.score(docs, model).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    held, joined = sorted(held, key=order), sorted(joined, key=order)
    assert [(r.doc_id, r.text) for r in held] == [(r.doc_id, r.text) for r in joined]
    assert [r.score for r in joined] == pytest.approx([r.score for r in held], abs=1e-9)
    assert 0 < sum(r.predicted for r in joined) < len(rows)


@tables
def test_quality_of_held_out_rows(spark):
    rows = queries.op3_quality(spark, FOLDER).collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == 10_000
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = [r.selected == (labels[r.doc_id].quality == 1) for r in held]
    assert sum(right) >= 0.95 * len(right)
    assert all(r.p_grade_1 >= r.p_grade_2 - 1e-12 for r in rows)
    assert all(abs(r.expected_grade - r.p_grade_1 - r.p_grade_2) < 1e-9 for r in rows)


def test_quality_edge_cases(spark):
    rows = [(i, ("good words here " if i % 3 else "JUNK!! ") * (1 + i % 5)) for i in range(150)]
    ratings = [(i, 2 if i % 3 else 0) for i in range(150)] + [(None, 1), (3, None), (9, -1)]
    rows += [(500, None), (501, ""), (None, "JUNK!!"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tails", F.lit(0))
    known = spark.createDataFrame(ratings, "doc_id bigint, grade int")
    model = quality.fit(docs, known)
    assert list(model.thresholds) == sorted(model.thresholds)
    found = quality.rate(docs, model)
    assert found.columns == ["doc_id", "text", "expected_grade", "tails", "selected"]
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[1].selected and not by_id[None].selected
    assert by_id[500].expected_grade == by_id[501].expected_grade
    none = quality.fit(docs, known.limit(0))
    assert not any(r.selected for r in quality.rate(docs, none).collect())
    assert quality.rate(docs.limit(0), model).count() == 0
