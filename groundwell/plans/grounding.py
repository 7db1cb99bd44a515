"""Questions to grounded prompts, answers and sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.prompts import (
    NO_CONTEXT_ANSWER,
    generation_request,
    grounded_prompt,
)
from groundwell.functions.vectors import Embedder
from groundwell.operators.requests import split_requests
from groundwell.operators.search import attach_hits, gather_hits, with_payload
from groundwell.plans.retrieval import search_text
from groundwell.settings import GROUNDED_TOP_K_MAX, Settings

Generator = Callable[[list[str]], list[str]]


def above_threshold(hits: DataFrame, threshold: float = Settings.score_threshold) -> DataFrame:
    """Hits scoring at least ``threshold``, taken after top-k. NaN never passes."""
    return hits.where(~F.isnan("score") & (F.col("score") >= threshold))


def ground(questions: DataFrame, gathered: DataFrame, key: str = "query_id") -> DataFrame:
    """Every question with its sources and ``prompt``; the prompt is null without sources."""
    return attach_hits(questions, gathered, key).withColumn(
        "prompt",
        F.when(F.size("contexts") > 0, grounded_prompt(F.col("query"), F.col("contexts"))),
    )


def with_answers(grounded: DataFrame, generate: Generator | None = None) -> DataFrame:
    """Add ``answer``: the fixed text where nothing was found, else the generator's.

    ``generate`` gets lists of prompts and never sees a question without sources. Without a
    generator those answers stay null and ``request`` holds the body for an offline run.
    """
    rows = grounded.withColumn("request", generation_request(F.col("prompt")))
    rows = rows.withColumn("request", F.when(F.col("prompt").isNotNull(), F.col("request")))
    produced = F.lit(None).cast("string") if generate is None else _generate(generate)("prompt")
    return rows.withColumn(
        "answer", F.coalesce(produced, F.when(F.col("prompt").isNull(), NO_CONTEXT_ANSWER))
    )


def answer_questions(
    points: DataFrame,
    questions: DataFrame,
    embed: Embedder,
    top_k: int | None = Settings.default_top_k,
    threshold: float = Settings.score_threshold,
    generate: Generator | None = None,
) -> DataFrame:
    """Retrieval, threshold, prompt and answer for ``query_id, query[, top_k][, filters]``.

    One row per valid question, also where nothing was found; see :func:`refused_questions`
    for the others.
    """
    questions, _ = _split(questions, top_k)
    hits = search_text(points, questions, embed, top_k, GROUNDED_TOP_K_MAX)
    kept = with_payload(above_threshold(hits, threshold), points)
    return with_answers(ground(questions, gather_hits(kept)), generate)


def refused_questions(
    questions: DataFrame, top_k: int | None = Settings.default_top_k
) -> DataFrame:
    """Questions that are not answered, with their ``reject_reason``: an empty one, or one
    whose own ``top_k`` (with ``top_k=None``) is out of bounds."""
    return _split(questions, top_k)[1]


def _split(questions: DataFrame, top_k: int | None) -> tuple[DataFrame, DataFrame]:
    own = "top_k" if top_k is None else None
    return split_requests(questions, text="query", top_k=own, max_top_k=GROUNDED_TOP_K_MAX)


def _generate(generate: Generator):
    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            asked = prompts[prompts.notna()]
            out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
            if len(asked):
                out.loc[asked.index] = generate(asked.tolist())
            yield out

    return answers
