"""Documents, requests and files to index points."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.ids import (
    chunk_id,
    chunk_ids,
    document_id_or_default,
    path_document_id,
)
from groundwell.functions.payload import (
    file_payload,
    payload_metadata,
    payload_text,
    request_payload,
)
from groundwell.functions.vectors import Embedder
from groundwell.operators.chunking import chunk_documents, chunk_tallies
from groundwell.operators.index import Collection
from groundwell.operators.requests import split_requests
from groundwell.settings import Settings
from groundwell.sources.files import load_documents


def with_document_id(requests: DataFrame, request_key: str | None = None) -> DataFrame:
    """Requests ``text, document_id, metadata`` with an id in every row."""
    seed = [F.col(request_key)] if request_key else []
    return requests.withColumn(
        "document_id", document_id_or_default(F.col("document_id"), *seed, F.col("text"))
    )


def points_of_requests(
    requests: DataFrame,
    embed: Embedder,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
    request_key: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """Points ``chunk_id, vector, chunk_text, metadata`` of valid requests. No shuffle.

    ``order`` is a column of the requests to keep, which tells the later of two requests for
    the same document.
    """
    carry = [order] if order else []
    accepted, _ = split_requests(requests, text="text", top_k=None)
    chunks = chunk_documents(
        with_document_id(accepted, request_key), chunk_size, chunk_overlap, carry
    )
    payload = request_payload(
        F.col("document_id"), F.col("chunk_index"), F.col("chunk_text"), F.col("metadata")
    )
    return chunks.select(
        *carry,
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        embed(F.col("chunk_text")).alias("vector"),
        payload_text(payload).alias("chunk_text"),
        payload_metadata(payload).alias("metadata"),
    )


def store_requests(
    collection: Collection,
    batch: int,
    requests: DataFrame,
    embed: Embedder,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
    request_key: str | None = None,
    order: str | None = None,
) -> None:
    """Store requests as one batch, of which the last request for a document wins.

    The last one is told by the column ``order``, or else by the order of the rows. All chunks
    of a request rank alike, so that no two versions of a document are mixed.
    """
    place = order or "__place"
    if order is None:
        requests = requests.withColumn(place, F.monotonically_increasing_id())
    points = points_of_requests(
        requests, embed, chunk_size, chunk_overlap, request_key, place
    )
    collection.write_batch(batch, points, place)


def summarize_requests(
    requests: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
    request_key: str | None = None,
) -> DataFrame:
    """What a caller gets back: ``document_id, num_chunks, stored_ids`` per request.

    Ids follow from the number of chunks, so nothing is grouped. A blank document has the id
    "" and no chunks.
    """
    accepted, _ = split_requests(requests, text="text", top_k=None)
    tallied = chunk_tallies(with_document_id(accepted, request_key), chunk_size, chunk_overlap)
    stored = F.col("n_chunks") > 0
    return tallied.select(
        *([request_key] if request_key else []),
        F.when(stored, F.col("document_id")).otherwise(F.lit("")).alias("document_id"),
        F.col("n_chunks").alias("num_chunks"),
        chunk_ids(F.col("document_id"), F.col("n_chunks")).alias("stored_ids"),
    )


def points_of_files(
    documents: DataFrame,
    embed: Embedder,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    """Points of loaded files ``path, text``; the id of a document is a hash of its path."""
    named = documents.select(
        path_document_id(F.col("path")).alias("document_id"),
        "text",
        F.create_map(F.lit("source"), F.col("path")).alias("metadata"),
    )
    return chunk_documents(named, chunk_size, chunk_overlap).select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        embed(F.col("chunk_text")).alias("vector"),
        "chunk_text",
        payload_metadata(
            file_payload(
                F.col("document_id"),
                F.col("chunk_index"),
                F.col("chunk_text"),
                F.col("metadata")["source"],
            )
        ).alias("metadata"),
    )


@dataclass(frozen=True)
class FileIngest:
    """Outcome of one file ingest."""

    rejected: DataFrame
    per_source: DataFrame


def ingest_files(
    collection: Collection,
    batch: int,
    paths: Sequence[str],
    embed: Embedder,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
    pdf_pages: Callable[[Column], Column] | None = None,
) -> FileIngest:
    """Load, chunk, embed and store files as one batch of ``collection``."""
    documents, rejected = load_documents(collection.spark, paths, pdf_pages)
    # A file is read once, so no id occurs twice.
    points = points_of_files(documents, embed, chunk_size, chunk_overlap)
    collection.write_batch(batch, points, unique=True)
    return FileIngest(
        rejected, chunks_per_source(documents, "path", chunk_size, chunk_overlap)
    )


def chunks_per_source(
    documents: DataFrame,
    source: str,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    """Number of chunks per source, from token counts and not from built chunks.

    Sources without chunks are dropped after the sum; a filter before it would be pushed to
    the scan and count the tokens once more.
    """
    return (
        chunk_tallies(documents, chunk_size, chunk_overlap)
        .groupBy(source)
        .agg(F.sum("n_chunks").alias("n_chunks"))
        .where(F.col("n_chunks") > 0)
    )


def total_chunks(
    documents: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    return chunk_tallies(documents, chunk_size, chunk_overlap).agg(
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks")
    )


__all__ = [
    "FileIngest",
    "chunks_per_source",
    "ingest_files",
    "points_of_files",
    "points_of_requests",
    "store_requests",
    "summarize_requests",
    "total_chunks",
    "with_document_id",
]
