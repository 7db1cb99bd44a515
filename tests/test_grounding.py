from __future__ import annotations

import pytest

from groundwell.functions.prompts import NO_CONTEXT_ANSWER
from groundwell.functions.vectors import hash_embedder
from groundwell.operators import evaluation as ev
from groundwell.operators.search import search
from groundwell.plans.evaluation import evaluate, judge_samples, run_evaluation
from groundwell.plans.grounding import above_threshold, answer_questions, refused_questions
from groundwell.plans.ingest import points_of_requests
from groundwell.sources.run_log import read_runs
from groundwell.sources.samples import read_samples

EMBED = hash_embedder(8)
FIXED = "They are kept in blocks."


def fixed_answers():
    # Built inside a function, so that it travels to workers by value.
    def generate(prompts):
        assert all(p.startswith("Context (from the knowledge base):") for p in prompts)
        return ["They are kept in blocks."] * len(prompts)

    return generate


def never():
    def generate(prompts):
        raise AssertionError("the generator must not be called")

    return generate


@pytest.fixture(scope="module")
def points(spark):
    rows = [("v", "Vectors are stored for semantic search.", {}), ("w", "Weather report.", {})]
    frame = spark.createDataFrame(
        rows, "document_id STRING, text STRING, metadata MAP<STRING,STRING>"
    )
    return points_of_requests(frame, EMBED)


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id INT, query STRING")


def test_answer_with_sources(spark, points):
    asked = questions(spark, "how are vectors stored", "how are vectors stored")
    rows = answer_questions(points, asked, EMBED, 3, generate=fixed_answers()).collect()
    assert len(rows) == 2
    for r in rows:
        assert r.answer == FIXED and r.n_contexts == 2
        assert [s.chunk_text for s in r.sources] == r.contexts
        assert [s.score for s in r.sources] == sorted((s.score for s in r.sources), reverse=True)
        assert r.sources[0].metadata["document_id"] in ("v", "w")
        assert "Question: how are vectors stored\n\nAnswer:" in r.prompt


def test_nothing_stored_gives_the_fixed_answer(spark, points):
    rows = answer_questions(points.limit(0), questions(spark, "bread?"), EMBED, 3, generate=never())
    row = rows.first()
    assert row.answer == NO_CONTEXT_ANSWER and row.sources == [] and row.contexts == []
    assert row.prompt is None and row.request is None


def test_low_scores_give_the_fixed_answer_without_generation(spark, points):
    rows = answer_questions(points, questions(spark, "x"), EMBED, 3, 0.9999, generate=never())
    assert rows.first().answer == NO_CONTEXT_ANSWER


def test_generator_sees_only_questions_with_sources(spark, points):
    def check(prompts):
        assert all("Weather" in p for p in prompts)
        return [FIXED] * len(prompts)

    asked = questions(spark, "Weather report.", "x", "y").coalesce(1)
    rows = answer_questions(points, asked, EMBED, 1, 0.999999, generate=check).collect()
    got = {r.query_id: r.answer for r in rows}
    assert got == {0: FIXED, 1: NO_CONTEXT_ANSWER, 2: NO_CONTEXT_ANSWER}


def test_without_generator_there_is_a_request_body(spark, points):
    row = answer_questions(points, questions(spark, "x"), EMBED, 1).first()
    assert row.answer is None and '"stream":false' in row.request


def test_top_k_bound_of_grounded_questions(spark, points):
    with pytest.raises(ValueError):
        answer_questions(points, questions(spark, "x"), EMBED, 21)


def test_threshold_drops_nan_and_keeps_equal(spark):
    hits = spark.createDataFrame(
        [(1, 0.5), (2, float("nan")), (3, 0.4), (4, -0.1)], "query_id INT, score DOUBLE"
    )
    assert {r.query_id for r in above_threshold(hits, 0.5).collect()} == {1}
    assert {r.query_id for r in above_threshold(hits).collect()} == {1, 3}


def test_threshold_after_top_k_equals_threshold_before(spark, points):
    rows = spark.createDataFrame(
        [(i, [float(i % 5), 1.0]) for i in range(30)], "chunk_id INT, vector ARRAY<FLOAT>"
    )
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id INT, vector ARRAY<FLOAT>")
    few = above_threshold(search(rows, asked, 10), 0.9).collect()
    many = above_threshold(search(rows, asked, 100), 0.9).orderBy("rank").limit(10).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))


# Evaluation ----------------------------------------------------------------------------------

NAN = float("nan")


def test_metric_names():
    assert ev.select_metrics(None) == list(ev.METRICS) == ev.select_metrics([])
    assert ev.select_metrics(["nope", "faithfulness"]) == ["faithfulness"]
    with pytest.raises(ValueError, match="is a metric"):
        ev.select_metrics(["nope"])


def test_means_skip_nan_and_report_labels(spark):
    scores = spark.createDataFrame(
        [("faithfulness", 0.9), ("faithfulness", NAN), ("faithfulness", 0.7),
         ("context_recall", NAN), ("nope", 1.0)],
        "metric STRING, value DOUBLE",
    )
    rows = ev.metric_report(ev.metric_means(scores)).collect()
    assert [r.metric for r in rows] == list(ev.METRICS)
    labels = {r.metric: (r.label, r.logged) for r in rows}
    assert labels == {
        "faithfulness": ("0.8000", True), "answer_relevancy": ("N/A", False),
        "context_precision": ("N/A", False), "context_recall": ("N/A", False),
    }


def test_context_precision_by_hand(spark):
    verdicts = [("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("b", 1, 0), ("b", 2, 0), ("c", 1, 1)]
    frame = spark.createDataFrame(verdicts, "sample_id STRING, rank INT, verdict INT")
    got = {r.sample_id: r.value for r in ev.precision_scores(frame).collect()}
    assert got == {"a": pytest.approx((1 + 2 / 3) / 2), "b": 0.0, "c": 1.0}


def test_share_scores(spark):
    frame = spark.createDataFrame(
        [("a", 1), ("a", 0), ("b", None)], "sample_id STRING, verdict INT"
    )
    got = {r.sample_id: r.value for r in ev.share_scores(frame, "faithfulness").collect()}
    assert got["a"] == 0.5 and got["b"] != got["b"]


def test_sample_defaults(spark):
    frame = spark.createDataFrame([("q",)], "question STRING")
    assert ev.complete_samples(frame).first().asDict() == {
        "question": "q", "answer": "", "contexts": [], "ground_truth": None,
    }


def test_collected_answers_keep_truth_and_empty_contexts(spark):
    asked = spark.createDataFrame(
        [(1, "q", None), (2, "q", "gt2"), (3, "r", None)],
        "sample_id INT, question STRING, ground_truth STRING",
    )
    answers = spark.createDataFrame(
        [(1, "a1", ["ctx1"]), (2, "a2", [])],
        "sample_id INT, answer STRING, contexts ARRAY<STRING>",
    )
    got = {r.sample_id: r for r in ev.collect_answers(asked, answers).collect()}
    assert got[1].contexts == ["ctx1"] and got[1].answer == "a1"
    assert got[2].contexts == [] and got[2].ground_truth == "gt2"
    assert got[3].answer == "" and got[3].contexts == []


def test_overlap_judge(spark):
    frame = spark.createDataFrame(
        [
            (1, "what?", "Cats sit on mats. Dogs fly planes daily!", ["the cats sit on red mats"],
             "cats sit on mats"),
            (2, "what?", "", [], None),
        ],
        "sample_id INT, question STRING, answer STRING, contexts ARRAY<STRING>, "
        "ground_truth STRING",
    )
    got = {(r.sample_id, r.metric): r.value for r in judge_samples(frame, EMBED).collect()}
    assert got[1, "faithfulness"] == 0.5
    assert got[1, "context_precision"] == 1.0 and got[1, "context_recall"] == 1.0
    assert (2, "faithfulness") not in got
    report = {r.metric: r.label for r in evaluate(frame, EMBED, ["faithfulness"]).collect()}
    assert report == {"faithfulness": "0.5000"}


def test_evaluation_end_to_end(spark, points, tmp_path):
    asked = spark.createDataFrame(
        [("how are vectors stored", "Vectors are stored."), ("how are vectors stored", None)],
        "question STRING, ground_truth STRING",
    )
    report = run_evaluation(
        points, asked, EMBED, f"{tmp_path}/out/samples", fixed_answers(), top_k=2,
        metrics=["faithfulness", "context_recall", "nope"], log=f"{tmp_path}/runs",
        run_id="r1", params={"dataset": "set"},
    )
    assert {r.metric for r in report.collect()} == {"faithfulness", "context_recall"}
    samples = read_samples(spark, f"{tmp_path}/out/samples").collect()
    assert len(samples) == 2 and all(len(s.contexts) == 2 for s in samples)
    assert sorted(str(s.ground_truth) for s in samples) == ["None", "Vectors are stored."]
    logged = {r.key: r.value for r in read_runs(spark, f"{tmp_path}/runs").collect()}
    assert logged["n_samples"] == "2" and logged["dataset"] == "set"
    assert logged["context_recall"] == "1.0"
    with pytest.raises(ValueError):
        run_evaluation(points, asked, EMBED, f"{tmp_path}/none", metrics=["nope"])


def test_refused_questions_get_no_answer(spark, points):
    asked = spark.createDataFrame(
        [(1, "how", 2), (2, "", 2), (3, "how", 0), (4, "how", 21), (5, None, 2), (6, "how", 20)],
        "query_id INT, query STRING, top_k INT",
    )
    answered = answer_questions(points, asked, EMBED, None)
    assert {r.query_id for r in answered.collect()} == {1, 6}
    assert {r.query_id: r.reject_reason for r in refused_questions(asked, None).collect()} == {
        2: "query is empty", 5: "query is empty",
        3: "top_k is not in 1..20", 4: "top_k is not in 1..20",
    }


def test_labels_round_the_binary_value(spark):
    values = [0.00015, 0.00025, 0.5, 0.12345, 0.99995, 1.0, 0.0, 2 / 3, -0.00015, 0.03125, 0.00005]
    means = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "metric STRING, value DOUBLE")
    labels = {int(r.metric): r.label for r in ev.metric_report(means).collect()}
    assert labels == {i: f"{v:.4f}" for i, v in enumerate(values)}
