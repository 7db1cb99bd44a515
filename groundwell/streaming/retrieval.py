"""Continuous retrieval: a stream of text queries against an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from groundwell.functions.vectors import Embedder
from groundwell.plans.retrieval import search_hits
from groundwell.settings import Settings


def retrieval_stream(
    requests: DataFrame,
    points: Callable[[], DataFrame],
    embed: Embedder,
    output: str,
    checkpoint: str,
    top_k: int | None = Settings.default_top_k,
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Write the hits of each micro-batch of requests to ``output/batch=N``.

    ``points`` is called per batch, so queries see what was stored in the meantime. A batch
    that is run again replaces its own folder.
    """

    def answer(batch: DataFrame, number: int) -> None:
        hits = search_hits(points(), batch, embed, top_k)
        hits.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
