"""Text queries to hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.vectors import Embedder
from groundwell.operators.requests import split_requests
from groundwell.operators.search import attach_hits, gather_hits, search, with_payload
from groundwell.settings import SEARCH_TOP_K_MAX, Settings


def search_text(
    points: DataFrame,
    requests: DataFrame,
    embed: Embedder,
    top_k: int | None = Settings.default_top_k,
    max_top_k: int = SEARCH_TOP_K_MAX,
) -> DataFrame:
    """``query_id, rank, chunk_id, score`` for requests ``query_id, query[, top_k][, filters]``.

    Requests a service would refuse give no hits; see
    :func:`groundwell.operators.requests.with_reject_reason` for the reasons.
    """
    own = "top_k" if top_k is None else None
    accepted, _ = split_requests(requests, text="query", top_k=own, max_top_k=max_top_k)
    kept = [c for c in ("top_k", "filters") if c in requests.columns]
    queries = accepted.select("query_id", embed(F.col("query")).alias("vector"), *kept)
    return search(points, queries, top_k, max_top_k=max_top_k)


def search_hits(
    points: DataFrame,
    requests: DataFrame,
    embed: Embedder,
    top_k: int | None = Settings.default_top_k,
) -> DataFrame:
    """Hits with ``chunk_text`` and ``metadata``."""
    return with_payload(search_text(points, requests, embed, top_k), points)


def search_responses(
    points: DataFrame,
    requests: DataFrame,
    embed: Embedder,
    top_k: int | None = Settings.default_top_k,
) -> DataFrame:
    """One row per valid request, ``query_id, query, hits``, also where nothing was found."""
    own = "top_k" if top_k is None else None
    accepted, _ = split_requests(requests, text="query", top_k=own)
    gathered = gather_hits(search_hits(points, requests, embed, top_k))
    return attach_hits(accepted, gathered).select(
        "query_id", "query", F.col("sources").alias("hits")
    )
