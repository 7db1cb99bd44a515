"""Continuous ingest of document requests into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from groundwell.functions.vectors import Embedder
from groundwell.operators.index import Collection
from groundwell.plans.ingest import store_requests
from groundwell.settings import Settings


def drop_repeats(
    requests: DataFrame, key: str, event_time: str, delay: str = "1 hour"
) -> DataFrame:
    """Drop requests whose ``key`` was seen within ``delay``. Optional: chunk ids are stable,
    so a repeated request replaces its own points."""
    return requests.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def ingest_stream(
    requests: DataFrame,
    collection: Collection,
    embed: Embedder,
    checkpoint: str,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
    request_key: str | None = None,
    order: str | None = None,
    first_batch: int = 0,
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Chunk, embed and store a stream of requests.

    Each micro-batch is stored under its own number, so a batch that is run again replaces
    itself. ``first_batch`` shifts the numbers past those already in the collection. ``order``
    is a request column that tells the later of two requests for one document within a batch;
    without it the later row is.
    """

    def store(batch: DataFrame, number: int) -> None:
        store_requests(
            collection, first_batch + number, batch, embed, chunk_size, chunk_overlap,
            request_key, order,
        )

    return (
        requests.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
