"""Stable identifiers for documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122 name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _name_digest(name: Column) -> Column:
    return F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))


def _as_uuid5(digest: Column) -> Column:
    """Lay a SHA-1 hex digest out as a version 5 UUID."""
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def uuid5(name: Column) -> Column:
    return _as_uuid5(_name_digest(name))


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    """Point id of a chunk; the same document and index always give the same id."""
    return uuid5(F.concat(document_id.cast("string"), F.lit(":"), chunk_index.cast("string")))


def chunk_ids(document_id: Column, n_chunks: Column) -> Column:
    """Ids of chunks ``0 .. n_chunks - 1`` of one document, in order, without a group-by."""
    digests = F.transform(
        F.sequence(F.lit(0), n_chunks - 1),
        lambda i: _name_digest(F.concat(document_id.cast("string"), F.lit(":"), i.cast("string"))),
    )
    return F.when(n_chunks > 0, F.transform(digests, _as_uuid5)).otherwise(
        F.array().cast("array<string>")
    )


def path_document_id(path: Column) -> Column:
    """Document id of a file: 16 hex digits of the SHA-1 of its path."""
    return F.substring(F.sha1(path), 1, 16)


def document_id_or_default(document_id: Column, *seed: Column) -> Column:
    """Given id, or one derived from ``seed`` where it is null or empty.

    A random id would change when a lost task is retried, so the default hashes its seed.
    Pass a request key with the text, else two requests without id and with equal text
    become one document.
    """
    material = F.concat_ws("\u001f", *[s.cast("string") for s in seed])
    return F.coalesce(F.nullif(document_id, F.lit("")), F.substring(F.sha2(material, 256), 1, 32))
