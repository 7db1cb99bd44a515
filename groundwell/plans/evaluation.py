"""Answer a question set, judge the answers and average the scores."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.vectors import Embedder, cosine
from groundwell.operators.evaluation import (
    collect_answers,
    complete_samples,
    context_judgement,
    metric_means,
    metric_report,
    precision_of,
    select_metrics,
    share_of,
    statement_judgement,
)
from groundwell.plans.grounding import Generator, answer_questions
from groundwell.settings import Settings
from groundwell.sources.run_log import append_run, metric_rows, param_rows
from groundwell.sources.samples import read_samples, with_sample_ids, write_samples


# Fixed value: how a logged run is named.
RUN_NAME = "rag-eval-{model}"


def judge_samples(
    samples: DataFrame, embed: Embedder, metrics: Sequence[str] | None = None
) -> DataFrame:
    """``sample_id, metric, value`` by the token-overlap judge.

    Answer relevancy takes the answer itself as the one question generated from it. All that a
    score needs is in the sample's row, so one projection gives them all; nothing is grouped
    or joined. A sample without statements, or without contexts, has no score by them.
    """
    by_name = {
        "faithfulness": share_of(statement_judgement("answer")),
        "answer_relevancy": cosine(embed(F.col("question")), embed(F.col("answer"))),
        "context_precision": precision_of(context_judgement()),
        "context_recall": share_of(statement_judgement("ground_truth")),
    }
    scores = F.array(
        *(
            F.struct(F.lit(name).alias("metric"), by_name[name].alias("value"))
            for name in select_metrics(metrics)
        )
    )
    return (
        complete_samples(samples)
        .select("sample_id", F.inline(scores))
        .where(F.col("value").isNotNull())
    )


def evaluate(
    samples: DataFrame, embed: Embedder, metrics: Sequence[str] | None = None
) -> DataFrame:
    """``metric, value, label, logged`` over a table of samples."""
    return metric_report(metric_means(judge_samples(samples, embed, metrics), metrics))


def run_evaluation(
    points: DataFrame,
    questions: DataFrame,
    embed: Embedder,
    output: str,
    generate: Generator | None = None,
    top_k: int = 3,
    threshold: float = Settings.score_threshold,
    metrics: Sequence[str] | None = None,
    log: str | None = None,
    run_id: str | None = None,
    params: Mapping[str, object] | None = None,
) -> DataFrame:
    """Answer ``question[, ground_truth]`` rows, keep the samples, score them, log the run.

    The collected samples are written to ``output`` as JSON lines. With ``log`` the parameters
    and those metrics that are numbers are appended there. Returns the report of
    :func:`evaluate`.
    """
    names = select_metrics(metrics)
    asked = with_sample_ids(questions)
    answered = answer_questions(
        points,
        asked.select(F.col("sample_id").alias("query_id"), F.col("question").alias("query")),
        embed, top_k, threshold, generate,
    )
    samples = collect_answers(asked, answered.withColumnRenamed("query_id", "sample_id"))
    write_samples(samples.select("question", "answer", "contexts", "ground_truth"), output)
    collected = with_sample_ids(read_samples(questions.sparkSession, output))
    report = evaluate(collected, embed, names)
    if log is not None:
        spark, run_name = questions.sparkSession, RUN_NAME.format(model=Settings.generation_model)
        known = {
            "llm_model": Settings.generation_model,
            "llm_temperature": Settings.temperature,
            "embedding_model": Settings.embedding_model,
            "top_k": top_k,
            "n_samples": collected.count(),
            **(params or {}),
        }
        run = run_id or uuid.uuid4().hex
        append_run(
            param_rows(spark, run, run_name, known).unionByName(
                metric_rows(report, run, run_name)
            ),
            log,
        )
    return report
