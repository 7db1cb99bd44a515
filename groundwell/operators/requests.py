"""Requests as rows: what a service would refuse goes to a rejects table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.settings import SEARCH_TOP_K_MAX


def with_reject_reason(
    requests: DataFrame,
    text: str = "query",
    top_k: str | None = "top_k",
    max_top_k: int = SEARCH_TOP_K_MAX,
) -> DataFrame:
    """Add ``reject_reason``: null for a valid request.

    Text needs at least one character (a blank passes). A null ``top_k`` takes its default
    later; use :data:`groundwell.settings.GROUNDED_TOP_K_MAX` as bound for grounded answers.
    """
    short = F.coalesce(F.length(text), F.lit(0)) < 1
    reason: Column = F.when(short, F.lit(f"{text} is empty"))
    if top_k is not None:
        reason = reason.when(
            ~F.col(top_k).between(1, max_top_k), F.lit(f"{top_k} is not in 1..{max_top_k}")
        )
    return requests.withColumn("reject_reason", reason)


def split_requests(requests: DataFrame, **bounds: object) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejected rows carry the reason."""
    checked = with_reject_reason(requests, **bounds)
    accepted = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, checked.where(F.col("reject_reason").isNotNull())
