"""Documents to chunk rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.functions.binding import let
from groundwell.functions.payload import coerce_metadata
from groundwell.functions.text import (
    check_window,
    chunk_count,
    chunk_text,
    count_tokens,
    tokens,
)
from groundwell.operators.running import running_sum
from groundwell.session import ship_package
from groundwell.settings import Settings

#: Neighbouring windows that token rows are grouped for; only the first and last of them hold
#: tokens that travel to a second group.
WINDOWS_TOGETHER = 8


def chunk_documents(
    documents: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``document_id, text, metadata`` to ``document_id, chunk_index, chunk_text, metadata``.

    A narrow transformation: no shuffle and no Python worker. Blank documents give no row.
    Other input columns are dropped unless named in ``carry``.
    """
    return documents.select(
        *carry,
        F.col("document_id").cast("string").alias("document_id"),
        coerce_metadata(F.col("metadata")).alias("metadata"),
        F.posexplode(chunk_text(F.col("text"), chunk_size, chunk_overlap)).alias(
            "chunk_index", "chunk_text"
        ),
    ).select("document_id", "chunk_index", "chunk_text", "metadata", *carry)


def chunk_tallies(
    documents: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    """Input rows with ``n_tokens`` and ``n_chunks``, without building any chunk."""
    return documents.withColumn("n_tokens", count_tokens(F.col("text"))).withColumn(
        "n_chunks", chunk_count(F.col("n_tokens"), chunk_size, chunk_overlap)
    )


def _windows_of(
    position: Column, n_tokens: Column, chunk_size: int, chunk_overlap: int
) -> list[Column]:
    """First and last index of the windows that hold the token at ``position``."""
    step = check_window(chunk_size, chunk_overlap)
    first = F.greatest(F.lit(0), F.ceil((position - chunk_size + 1) / step)).cast("int")
    last = F.least(
        F.floor(position / step).cast("int"), chunk_count(n_tokens, chunk_size, chunk_overlap) - 1
    )
    return [F.least(first, last).alias("first"), F.greatest(first, last).alias("last")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token rows that follow each other in one document and the same windows, as one row.

    A token that is null or holds the separator, or that has no position, stays alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        position, token = batch.column("position"), batch.column("token")
        place = position.fill_null(0).to_numpy()
        alone = pc.or_(pc.match_substring(token, " ").fill_null(True), position.is_null())
        alone = alone.to_numpy(zero_copy_only=False)
        new = np.ones(batch.num_rows, bool)
        new[1:] = alone[1:] | alone[:-1] | (place[1:] != place[:-1] + 1)
        document = batch.column("document_id").dictionary_encode(null_encoding="encode")
        for value in (document.indices, batch.column("first"), batch.column("last")):
            value = value.to_numpy()
            new[1:] |= value[1:] != value[:-1]
        at = np.flatnonzero(new)
        cuts = np.append(at, batch.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), token.fill_null(""))
        text = pc.if_else(token.take(at).is_valid(), pc.binary_join(lists, " "), None)
        kept = [batch.column(c).take(at) for c in ("document_id", "first", "last", "position")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(np.diff(cuts), pa.int32()), text],
            ["document_id", "first", "last", "start", "n", "text"],
        )


def chunk_token_rows(
    token_rows: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    """Chunks from ``document_id, position, n_tokens, token``, one row per token.

    Groups are a few neighbouring chunks, so no group grows with its document. Tokens that
    already lie together travel as one text: a group takes its runs, wherever they come from.
    Only where runs of a chunk overlap (a document id occurs twice) are they taken apart again.
    """
    ship_package(token_rows.sparkSession)
    rows = token_rows.select(
        "document_id",
        *_windows_of(F.col("position"), F.col("n_tokens"), chunk_size, chunk_overlap),
        "position",
        "token",
    )
    schema = T.StructType(
        [
            rows.schema["document_id"],
            *(T.StructField(c, T.IntegerType()) for c in ("first", "last")),
            T.StructField("start", rows.schema["position"].dataType),
            T.StructField("n", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def words(run: Column) -> Column:
        single = F.array(F.struct(run["start"].alias("position"), run["text"].alias("token")))
        several = F.transform(
            F.split(run["text"], " "),
            lambda word, i: F.struct((run["start"] + i).alias("position"), word.alias("token")),
        )
        return F.when(run["n"] == 1, single).otherwise(several)

    def block(window: str) -> Column:
        return F.floor(F.col(window) / WINDOWS_TOGETHER).cast("int")

    def chunk(index: Column) -> Column:
        own = F.filter("runs", lambda run: (run["first"] <= index) & (run["last"] >= index))
        return F.struct(index.alias("chunk_index"), own.alias("own"))

    grouped = (
        rows.mapInArrow(_runs, schema)
        .select(
            "document_id",
            F.explode(F.sequence(block("first"), block("last"))).alias("block"),
            F.struct("start", "n", "text", "first", "last").alias("run"),
        )
        .groupBy("document_id", "block")
        .agg(F.array_sort(F.collect_list("run")).alias("runs"))
    )
    opens = F.col("block") * WINDOWS_TOGETHER
    chunks = F.transform(F.sequence(opens, opens + WINDOWS_TOGETHER - 1), chunk)
    own = F.col("own")
    apart = F.forall(
        F.zip_with(
            F.slice(own, F.lit(1), F.size(own) - 1),
            F.slice(own, F.lit(2), F.size(own) - 1),
            lambda run, following: F.coalesce(
                run["start"] + run["n"] <= following["start"], F.lit(False)
            ),
        ),
        lambda right: right,
    )
    mixed = F.array_sort(F.flatten(F.transform(own, words)))
    return (
        grouped.select("document_id", F.inline(chunks))
        .where(F.size("own") > 0)
        .select(
            "document_id",
            "chunk_index",
            F.when(apart, F.array_join(F.transform(own, lambda run: run["text"]), " "))
            .otherwise(F.array_join(F.transform(mixed, lambda w: w["token"]), " "))
            .alias("chunk_text"),
        )
    )


def chunk_documents_by_token(
    documents: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    """Same rows as :func:`chunk_documents` (without metadata) as a grouping of token rows."""
    words = documents.select(
        F.col("document_id").cast("string").alias("document_id"),
        tokens(F.col("text")).alias("words"),
    )
    rows = words.select(
        "document_id",
        F.size("words").alias("n_tokens"),
        F.posexplode("words").alias("position", "token"),
    )
    return chunk_token_rows(rows, chunk_size, chunk_overlap)


def chunk_pages(
    pages: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    """Chunks of paged documents, ``document_id, page_no, page_text``, never assembled.

    Pages are parted by white space, so tokens do not cross them: the token offset of a page
    is a running sum of token counts, and each page then contributes its piece to the windows
    it touches. Equals chunking the assembled text, at any document length. ``page_no`` must
    be a non-negative integer, unique in its document; a page without a number comes first,
    and pages without a document id are one document.
    """
    step = check_window(chunk_size, chunk_overlap)
    counted = pages.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.coalesce("page_no", F.lit(-1)).alias("page_no"),
        "page_text",
        count_tokens(F.col("page_text")).alias("page_tokens"),
    )
    placed = (
        running_sum(
            counted, ["document_id"], "page_no", "page_tokens", "end", total="n_tokens"
        )
        .where(F.col("page_tokens") > 0)
        .withColumn("start", F.col("end") - F.col("page_tokens"))
    )
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - chunk_size + 1) / step)).cast("int")
    last = F.least(
        F.floor((F.col("end") - 1) / step).cast("int"),
        chunk_count(F.col("n_tokens"), chunk_size, chunk_overlap) - 1,
    )

    def piece(words: Column, index: Column) -> Column:
        # Where the window opens on this page; negative when it opened on an earlier one.
        opens = (index * step - F.col("start")).cast("int")
        begin = F.greatest(F.lit(0), opens)
        stop = F.least(F.size(words), opens + chunk_size)
        return F.struct(
            index.alias("chunk_index"),
            F.array_join(
                F.slice(words, begin + 1, F.greatest(F.lit(0), stop - begin)), " "
            ).alias("piece"),
        )

    pieces = placed.select(
        "document_id",
        "start",
        F.inline(
            let(
                tokens(F.col("page_text")),
                lambda words: F.transform(F.sequence(first, last), lambda i: piece(words, i)),
            )
        ),
    ).where(F.col("piece") != "")
    return (
        pieces.groupBy("document_id", "chunk_index")
        .agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
        .select(
            "document_id",
            "chunk_index",
            F.array_join(F.transform("pieces", lambda p: p["piece"]), " ").alias("chunk_text"),
        )
    )


def overlap_check(
    documents: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    """One row per pair of neighbouring chunks: does the tail of one open the next?

    Neighbours are compared in the array that chunking makes, before there are rows to join.
    For chunks that are stored already see :func:`overlap_audit`.
    """
    chunked = documents.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.transform(chunk_text(F.col("text"), chunk_size, chunk_overlap), tokens).alias("chunks"),
    )

    def agrees(words: Column, following: Column) -> Column:
        first = F.greatest(F.lit(1), F.size(words) - chunk_overlap + 1)
        return F.slice(words, first, F.lit(chunk_overlap)) == F.slice(
            following, 1, chunk_overlap
        )

    n = F.size("chunks")
    pairs = F.zip_with(
        F.slice("chunks", F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice("chunks", F.lit(2), F.greatest(n - 1, F.lit(0))),
        agrees,
    )
    return chunked.select(
        "document_id", F.posexplode(pairs).alias("chunk_index", "overlap_ok")
    )


def overlap_audit(chunks: DataFrame, chunk_overlap: int) -> DataFrame:
    """One row per pair of neighbouring chunks: does the tail of one open the next?

    An equi join on the neighbour's key instead of a window, so that no document is one task.
    """
    words = chunks.select("document_id", "chunk_index", tokens(F.col("chunk_text")).alias("words"))
    heads = words.where(F.col("chunk_index") > 0).select(
        "document_id",
        (F.col("chunk_index") - 1).alias("chunk_index"),
        F.slice("words", 1, chunk_overlap).alias("head"),
    )
    tails = words.select(
        "document_id",
        "chunk_index",
        F.slice(
            "words", F.greatest(F.lit(1), F.size("words") - chunk_overlap + 1), F.lit(chunk_overlap)
        ).alias("tail"),
    )
    return tails.join(heads, ["document_id", "chunk_index"]).select(
        "document_id", "chunk_index", (F.col("tail") == F.col("head")).alias("overlap_ok")
    )


def coverage_audit(
    documents: DataFrame,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> DataFrame:
    """Tokens of a document and how many of them no chunk holds (must be 0)."""
    chunked = documents.select(
        F.col("document_id").cast("string").alias("document_id"),
        tokens(F.col("text")).alias("words"),
        chunk_text(F.col("text"), chunk_size, chunk_overlap).alias("chunks"),
    )
    covered = F.flatten(F.transform("chunks", tokens))
    return chunked.select(
        "document_id",
        F.size("words").alias("n_tokens"),
        F.size("chunks").alias("n_chunks"),
        F.size(F.array_except("words", covered)).alias("n_uncovered"),
    )
