"""Point payloads: ``MAP<STRING,STRING>`` with the chunk text under ``chunk_text``.

Stored points keep the text in a column and the rest as ``metadata``.

All values are text, so a filter on the number 1 and one on the text "1" are the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_KEY = "chunk_text"


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def coerce_metadata(metadata: Column) -> Column:
    """Metadata with text values; a null map is empty, a null value is the text ``None``."""
    return F.transform_values(
        F.coalesce(metadata, _empty_map()), lambda _, v: F.coalesce(v, F.lit("None"))
    )


def overlay(base: Column, extra: Column) -> Column:
    """Union of two maps where ``extra`` wins. Needs no session setting for duplicate keys."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def chunk_payload(document_id: Column, chunk_index: Column, text: Column) -> Column:
    return F.create_map(
        F.lit(TEXT_KEY), text,
        F.lit("document_id"), document_id.cast("string"),
        F.lit("chunk_index"), chunk_index.cast("string"),
    )


def request_payload(
    document_id: Column, chunk_index: Column, text: Column, metadata: Column
) -> Column:
    """Payload of an ingested request. Metadata may replace the base keys."""
    return overlay(chunk_payload(document_id, chunk_index, text), coerce_metadata(metadata))


def file_payload(document_id: Column, chunk_index: Column, text: Column, path: Column) -> Column:
    """Payload of an ingested file: the base keys and its path under ``source``."""
    return F.map_concat(
        chunk_payload(document_id, chunk_index, text), F.create_map(F.lit("source"), path)
    )


def payload_text(payload: Column) -> Column:
    return F.coalesce(payload[TEXT_KEY], F.lit(""))


def payload_metadata(payload: Column) -> Column:
    """Everything but the text."""
    return F.map_filter(F.coalesce(payload, _empty_map()), lambda k, _: k != TEXT_KEY)


def rebuild_payload(metadata: Column, text: Column) -> Column:
    """Inverse of splitting a payload into text and metadata; a null text has no key."""
    rest = payload_metadata(metadata)
    return F.when(
        text.isNotNull(), F.map_concat(rest, F.create_map(F.lit(TEXT_KEY), text))
    ).otherwise(rest)
