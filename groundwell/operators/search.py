"""Exact cosine top-k of a table of queries over a table of vectors.

Two shapes of the same search:

* **Few queries** (their number and bytes are checked): the vectors stay where they are, each
  task scores its partition against all queries and gives up at most ``top_k`` rows per query.
* **Any number of queries**: both sides are cut in bounded blocks and each pair of blocks
  meets in one task. A filter value or cell that holds a large share of the rows is cut in
  many blocks; the number of blocks comes from counts taken before the shuffle. Small blocks
  are taken together, so that either side is copied as often as memory asks and not more.

A per-query filter is an equi key and not a mask: stored rows are joined with the distinct
filters by one entry of each, so that a row meets only queries whose filter it satisfies, and
filtering comes before top-k. With posting lists (:mod:`groundwell.operators.postings`) filters
that ask for a small share of the rows are settled before any vector is read. The width of a vector is part of the key: rows of another width
than the query's, or without a vector, are no candidates (see :func:`odd_vectors`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    StructField,
    StructType,
    VariantType,
)
from pyspark.sql.window import Window

from groundwell.functions.payload import TEXT_KEY, rebuild_payload
from groundwell.functions.typed import text_entries, typed_entries, typed_filter
from groundwell.functions.vectors import cosine
from groundwell.operators.postings import SCAN_SHARE, asked_share, matching_ids
from groundwell.operators.scoring import (
    SCORE_DECIMALS,
    Shortlist,
    as_matrix,
    as_values,
)
from groundwell.operators.sizes import broadcast_if_small, is_small
from groundwell.session import ship_package
from groundwell.settings import SEARCH_TOP_K_MAX, Settings, shared_folder

Decode = Callable[[pa.Array], np.ndarray]

# Queries up to these bounds are sent to every task; beyond them both sides are blocked.
SMALL_QUERY_ROWS = 16_384
SMALL_QUERY_BYTES = 64 * 1024 * 1024

# Stored rows and bytes per block of the blocked search; blocks of queries are a sixteenth (a
# quarter of the bytes). Larger blocks mean fewer copies of either side, and one pair of blocks
# must fit in a task.
BLOCK_ROWS = 131_072
BLOCK_BYTES = 128 * 1024 * 1024
REQUEST_SHARE = 16

# Every block of one side meets every block of the other, so each row is copied as often as the
# other side has blocks. A part of more blocks than this has them taken together, in as many
# groups as this or as the bounds above ask for.
BLOCK_GROUPS = 8

# Rows of a block that are turned into a matrix at a time.
_SLICE_ROWS = 16_384

# Parts with more than one block that are broadcast as a list.
MAX_LISTED_PARTS = 100_000


def search(
    points: DataFrame,
    queries: DataFrame,
    top_k: int | None = Settings.default_top_k,
    *,
    point_id: str = "chunk_id",
    query_id: str = "query_id",
    vector: str = "vector",
    metadata: str = "metadata",
    max_top_k: int = SEARCH_TOP_K_MAX,
    small_query_rows: int = SMALL_QUERY_ROWS,
    block_rows: int = BLOCK_ROWS,
    postings: DataFrame | None = None,
) -> DataFrame:
    """``query_id, rank, point_id, score`` of the best points of each query.

    ``queries`` has ``query_id``, ``vector`` and optionally ``filters`` (a map that the
    point's ``metadata`` must hold) and, with ``top_k=None``, a column ``top_k`` of at most
    ``max_top_k``; a larger one fails the job. Equal scores rank by id. Reading ``queries`` up
    to the size bound happens when the plan is built.

    ``metadata`` is a text map, or a typed payload (``VARIANT``); ``filters`` is a text map for
    the one and a typed object for the other, compared kind and value. ``postings`` are the
    posting lists of the same points and metadata, where there are any.
    """
    ship_package(points.sparkSession)
    requests = normal_requests(queries, top_k, max_top_k, query_id, vector)
    small = small_table(requests, small_query_rows)
    stored = points.select(
        F.col(point_id).alias("point_id"),
        F.col(vector).alias("vector"),
        *([F.col(metadata).alias("metadata")] if "filters" in requests.columns else []),
    )
    if postings is not None and "filters" in requests.columns:
        wanted, unfiltered = wanted_filters(requests, small)
        stored = narrowed(stored, postings, wanted, unfiltered)
    else:
        stored = satisfying(stored, requests, small)
    if small is not None:
        candidates = score_in_place(stored, small, requests.schema["query_id"].dataType)
    else:
        candidates = score_in_blocks(stored, requests.drop("filters"), block_rows)
    return rank_hits(candidates, max_top_k, query_id=query_id, point_id=point_id)


def odd_vectors(points: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """Rows that no search of this width can find, with the ``reason``."""
    width = F.size(vector)
    reason = F.when(F.col(vector).isNull(), F.lit("no vector")).when(
        width != dimension, F.concat(F.lit("width "), width)
    )
    return points.withColumn("reason", reason).where("reason is not null")


def normal_requests(
    queries: DataFrame, top_k: int | None, max_top_k: int, query_id: str, vector: str
) -> DataFrame:
    """Queries as ``query_id, vector, top_k, part[, filters]``; ``part`` is the equi key of
    width and filter. Queries without a vector are left out."""
    if top_k is not None and not 1 <= top_k <= max_top_k:
        raise ValueError(f"top_k must be in 1..{max_top_k}")
    wanted = F.lit(top_k)
    if top_k is None:
        own = F.coalesce("top_k", F.lit(Settings.default_top_k))
        wanted = F.when(own.between(1, max_top_k), own).otherwise(
            F.raise_error(F.lit(f"top_k must be in 1..{max_top_k}"))
        )
    filtered = "filters" in queries.columns
    if filtered and isinstance(queries.schema["filters"].dataType, VariantType):
        queries = queries.withColumn("filters", typed_filter(F.col("filters")))
    key = filter_key(F.col("filters")) if filtered else F.lit("")
    return queries.where(F.col(vector).isNotNull()).select(
        F.col(query_id).alias("query_id"),
        F.col(vector).alias("vector"),
        wanted.cast("int").alias("top_k"),
        F.concat(_width(F.col(vector)), key).alias("part"),
        *(["filters"] if filtered else []),
    )


def rank_hits(
    candidates: DataFrame,
    max_top_k: int,
    query_id: str = "query_id",
    point_id: str = "point_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Ranks per query; the constant bound lets a group limit run before the shuffle."""
    score = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(score.desc(), F.col("point_id"))
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_top_k)
        .where(F.col("rank") <= F.col("top_k"))
        .select(
            F.col("query_id").alias(query_id),
            "rank",
            F.col("point_id").alias(point_id),
            "score",
            *keep,
        )
    )


def search_one(
    points: DataFrame,
    query_vector: Column,
    top_k: int = Settings.default_top_k,
    *,
    filters: dict[str, str] | None = None,
    point_id: str = "chunk_id",
    vector: str = "vector",
    metadata: str = "metadata",
) -> DataFrame:
    """One request with a constant vector: ``rank, point_id, score``.

    The filter is a plain predicate and the top-k a ``TakeOrderedAndProject``, so only
    ``top_k`` rows per partition move.
    """
    if not 1 <= top_k <= SEARCH_TOP_K_MAX:
        raise ValueError(f"top_k must be in 1..{SEARCH_TOP_K_MAX}")
    for key, value in (filters or {}).items():
        holds = F.lit(False) if key == TEXT_KEY else F.col(metadata)[key] == value
        points = points.where(holds)
    scored = points.where(F.size(vector) == F.size(query_vector)).select(
        F.col(point_id),
        F.round(cosine(F.col(vector), query_vector), SCORE_DECIMALS).alias("score"),
    )
    best = scored.orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), point_id).limit(top_k)
    order = Window.orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), point_id)
    return best.select(F.row_number().over(order).alias("rank"), point_id, "score")


def score_all(points: DataFrame, query_vector: Column, vector: str = "vector") -> DataFrame:
    """Points with their cosine ``score`` against one constant vector of their width; points
    of another width or without a vector are left out."""
    return points.where(F.size(vector) == F.size(query_vector)).withColumn(
        "score", F.round(cosine(F.col(vector), query_vector), SCORE_DECIMALS)
    )


def with_payload(
    hits: DataFrame, points: DataFrame, *, point_id: str = "chunk_id"
) -> DataFrame:
    """Hits with ``chunk_text`` and ``metadata`` (the whole payload) of their points.

    Text joins only the winners, so it takes no part in scoring or ranking. The hits, at most
    top-k per query, are written to the shared folder first: the search then runs once, and
    their size tells whether they can be broadcast, so that the points are not shuffled.
    """
    shared_folder(points.sparkSession)
    hits = hits.checkpoint()
    joined = broadcast_if_small(hits).join(
        points.select(point_id, "chunk_text", "metadata"), point_id
    )
    return joined.select(
        *hits.columns,
        F.coalesce("chunk_text", F.lit("")).alias("chunk_text"),
        rebuild_payload(F.col("metadata"), F.col("chunk_text")).alias("metadata"),
    )


def gather_hits(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """``key, sources, contexts, n_contexts`` from hits with payload, in rank order.

    Groups hold at most ``top_k`` hits.
    """
    source = F.struct("rank", "chunk_id", "score", "chunk_text", "metadata")
    ranked = hits.groupBy(key).agg(
        F.array_sort(F.collect_list(source), lambda a, b: a["rank"] - b["rank"]).alias("ranked")
    )
    return ranked.select(
        key,
        F.transform(
            "ranked",
            lambda s: F.struct(
                s["chunk_id"].alias("id"),
                s["score"].alias("score"),
                s["chunk_text"].alias("chunk_text"),
                s["metadata"].alias("metadata"),
            ),
        ).alias("sources"),
        F.transform("ranked", lambda s: s["chunk_text"]).alias("contexts"),
        F.size("ranked").alias("n_contexts"),
    )


def attach_hits(requests: DataFrame, gathered: DataFrame, key: str = "query_id") -> DataFrame:
    """Every request with its gathered hits; empty lists where nothing was found."""

    def filled(name: str) -> Column:
        empty = F.array().cast(gathered.schema[name].dataType)
        return F.coalesce(F.col(name), empty).alias(name)

    return requests.join(gathered, key, "left").select(
        *requests.columns,
        filled("sources"),
        filled("contexts"),
        F.coalesce("n_contexts", F.lit(0)).alias("n_contexts"),
    )


def filter_key(filters: Column) -> Column:
    """Equi key of a filter: its field names in order with their values, "" for no filter."""
    names = F.array_sort(F.map_keys(filters))
    values = F.transform(names, lambda n: filters[n])
    return F.when(
        F.coalesce(F.size(filters), F.lit(0)) > 0, F.to_json(F.array(names, values))
    ).otherwise(F.lit(""))


def _width(vector: Column) -> Column:
    return F.concat(F.size(vector).cast("string"), F.lit(":"))


def wanted_filters(
    requests: DataFrame, small: pa.Table | None = None
) -> tuple[DataFrame, bool]:
    """The distinct filters of ``requests`` as ``key, entries``, and whether some have none.

    Where the requests are known locally, so are their filters, and no job is needed; they are
    then as few and small as these and broadcast.
    """
    if small is None:
        key = filter_key(F.col("filters"))
        wanted = (
            requests.select(key.alias("key"), "filters")
            .where("key != ''")
            .dropDuplicates(["key"])
            .select("key", F.map_entries("filters").alias("entries"))
        )
        return broadcast_if_small(wanted), not requests.where(key == "").isEmpty()
    found: dict[str, list[tuple[str, str]]] = {}
    unfiltered = False
    for part, filters in zip(
        small.column("part").to_pylist(), small.column("filters").to_pylist(), strict=True
    ):
        key = part.split(":", 1)[1]
        if key:
            found[key] = list(dict(filters).items())
        unfiltered = unfiltered or not key
    wanted = requests.sparkSession.createDataFrame(
        list(found.items()), "key string, entries array<struct<key:string,value:string>>"
    )
    return F.broadcast(wanted), unfiltered


def entries_of(metadata: str, frame: DataFrame) -> Column:
    """What filters compare of text metadata or of a typed payload."""
    if isinstance(frame.schema[metadata].dataType, VariantType):
        return typed_entries(F.col(metadata))
    return text_entries(F.col(metadata))


def satisfying(
    stored: DataFrame, requests: DataFrame, small: pa.Table | None = None
) -> DataFrame:
    """``stored`` (``vector[, metadata]`` and more) with ``part``: one row for each distinct
    filter of ``requests`` that it satisfies; ``metadata`` is dropped.

    The entries of a row meet the first entry (by name) of each filter in an equi join, and
    the filter's other entries are looked up in the row. Any number of filters over any
    number of fields will do, and rows that no filter asks for go no further. The stored text
    is no metadata and matches nothing.
    """
    width = _width(F.col("vector"))
    stored = stored.where(F.col("vector").isNotNull())
    if "filters" not in requests.columns:
        return stored.withColumn("part", width)
    wanted, unfiltered = wanted_filters(requests, small)
    rest = [c for c in stored.columns if c != "metadata"]
    held = stored.select(*rest, entries_of("metadata", stored).alias("held"))
    met = (
        held.select("*", F.explode("held").alias("entry"))
        .join(first_entry(wanted), "entry")
        .where(F.forall("entries", lambda e: F.array_contains("held", e)))
        .select(*rest, F.concat(width, "key").alias("part"))
    )
    return met.unionByName(stored.select(*rest, width.alias("part"))) if unfiltered else met


def first_entry(wanted: DataFrame) -> DataFrame:
    """``key, entries, entry``: each filter with its first entry by name."""
    return wanted.withColumn("entry", F.array_min("entries"))


def narrowed(
    stored: DataFrame, postings: DataFrame, wanted: DataFrame, unfiltered: bool
) -> DataFrame:
    """As :func:`satisfying`, through posting lists.

    Filters are intersected on lists of ids first. If they ask for more than ``SCAN_SHARE`` of
    the points, all are scanned; else only the points asked for go on, and while these are few,
    their vectors are picked out where they are.
    """
    width = _width(F.col("vector"))
    rest = [c for c in stored.columns if c != "metadata"]
    with_vector = stored.where(F.col("vector").isNotNull())
    # A filter without a list of one of its entries finds nothing, so this is an upper bound.
    asked, total = asked_share(postings, wanted)
    if asked > SCAN_SHARE * total:
        held = with_vector.select(*rest, entries_of("metadata", stored).alias("held"))
        met = (
            held.select("*", F.explode("held").alias("entry"))
            .join(first_entry(wanted), "entry")
            .where(F.forall("entries", lambda e: F.array_contains("held", e)))
            .select(*rest, F.concat(width, "key").alias("part"))
        )
    else:
        shared_folder(stored.sparkSession)
        found = matching_ids(postings, wanted).checkpoint()
        met = with_vector.select(*rest).join(broadcast_if_small(found), "point_id").select(
            *rest, F.concat(width, "key").alias("part")
        )
    return met.unionByName(with_vector.select(*rest, width.alias("part"))) if unfiltered else met


def small_table(requests: DataFrame, rows: int) -> pa.Table | None:
    """The requests as one local table, or None when they exceed the bounds."""
    if rows <= 0 or not is_small(requests, rows, SMALL_QUERY_BYTES):
        return None
    return requests.toArrow()


def _candidate_schema(query_type: DataType, point_type: DataType) -> StructType:
    return StructType(
        [
            StructField("query_id", query_type),
            StructField("top_k", IntegerType()),
            StructField("point_id", point_type),
            StructField("score", DoubleType()),
        ]
    )


def score_in_place(
    stored: DataFrame, small: pa.Table, query_type: DataType, decode: Decode = as_matrix
) -> DataFrame:
    """Score every partition of ``stored`` against all queries, without moving it.

    ``decode`` turns the stored column ``vector`` to a matrix of rows like the queries'.
    """
    schema = _candidate_schema(query_type, stored.schema["point_id"].dataType)
    if small.num_rows == 0:
        return stored.sparkSession.createDataFrame([], schema)
    parts = np.array(small.column("part").to_pylist(), dtype=object)
    groups = {str(part): np.flatnonzero(parts == part) for part in set(parts)}
    query_ids = small.column("query_id").combine_chunks()
    top_k = small.column("top_k").to_numpy()
    by_part = {
        part: as_matrix(small.column("vector").take(pa.array(rows))) for part, rows in groups.items()
    }

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Shortlist(top_k)
        id_type = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            id_type = batch.column("point_id").type
            keys = batch.column("part").dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            for code, part in enumerate(keys.dictionary.to_pylist()):
                if part not in groups:  # of another width
                    continue
                inside = batch.filter(pa.array(codes == code))
                best.add(
                    by_part[part],
                    groups[part],
                    as_values(inside.column("point_id")),
                    decode(inside.column("vector")),
                )
        found = best.rows()
        if found is not None:
            query, ids, value = found
            yield pa.RecordBatch.from_arrays(
                [
                    query_ids.take(pa.array(query)),
                    pa.array(top_k[query], pa.int32()),
                    pa.array(ids, id_type),
                    pa.array(value, pa.float64()),
                ],
                names=schema.fieldNames(),
            )

    return stored.mapInArrow(score, schema)


@dataclass(frozen=True)
class Visits:
    """Which stored rows of its part a request meets, where that is not all of them.

    ``choose`` gets the unit vectors of the requests, their table and the distinct values that
    the stored column ``key`` has in a group, and gives a mask of requests by values.
    """

    key: str
    choose: Callable[[np.ndarray, pa.Table, np.ndarray], np.ndarray]


def score_in_blocks(
    stored: DataFrame,
    requests: DataFrame,
    block_rows: int = BLOCK_ROWS,
    stored_cuts: DataFrame | None = None,
    decode: Decode = as_matrix,
    visits: Visits | None = None,
) -> DataFrame:
    """Top-k candidates of ``requests`` in ``stored`` rows of the same ``part``.

    Parts above ``block_rows`` rows or ``BLOCK_BYTES`` (less for requests) are cut in
    blocks, by a hash of id and vector, so that rows of one id part as well; of many blocks
    some are taken together (``BLOCK_GROUPS``). Each
    pair of blocks of a part is one group of bounded size and yields at most ``top_k`` rows
    per query. ``stored_cuts`` are the ``part, stored_blocks`` of the large
    parts of ``stored`` where they are known already. ``decode`` is that of
    :func:`score_in_place`. Requests may carry ``floor``, a score that their hits must reach.
    """
    schema = _candidate_schema(
        requests.schema["query_id"].dataType, stored.schema["point_id"].dataType
    )
    if stored_cuts is None:
        stored_cuts = grouped_blocks(stored, "stored_blocks", block_rows)
    request_cuts = grouped_blocks(
        requests, "request_blocks", max(1, block_rows // REQUEST_SHARE),
        BLOCK_ROWS // REQUEST_SHARE, BLOCK_BYTES // 4,
    )

    def cut(side: DataFrame, own: str, other: str, row_id: str) -> DataFrame:
        sized = side.join(stored_cuts, "part", "left").join(request_cuts, "part", "left")
        mine = F.coalesce(own, F.lit(1))
        theirs = F.coalesce(other, F.lit(1))
        return sized.select(
            *side.columns,
            F.pmod(F.xxhash64(row_id, "vector"), mine).cast("int").alias(own.removesuffix("s")),
            F.explode(F.sequence(F.lit(0), (theirs - 1).cast("int"))).alias(
                other.removesuffix("s")
            ),
        )

    group = ["part", "stored_block", "request_block"]
    left = cut(stored, "stored_blocks", "request_blocks", "point_id").groupBy(*group)
    right = cut(requests, "request_blocks", "stored_blocks", "query_id").groupBy(*group)

    def score(points: pa.Table, queries: pa.Table) -> pa.Table:
        names = schema.fieldNames()
        types = [
            queries.schema.field("query_id").type,
            pa.int32(),
            points.schema.field("point_id").type,
            pa.float64(),
        ]
        empty = pa.schema(list(zip(names, types))).empty_table()
        if points.num_rows == 0 or queries.num_rows == 0:
            return empty
        top_k = queries.column("top_k").to_numpy()
        floor = None
        if "floor" in queries.column_names:
            floor = queries.column("floor").to_numpy().astype(np.float64)
        best = Shortlist(top_k, floor)
        vectors = as_matrix(queries.column("vector"))

        def add(rows: pa.Table, members: np.ndarray) -> None:
            for batch in rows.to_batches(max_chunksize=_SLICE_ROWS):
                best.add(
                    vectors if len(members) == len(vectors) else vectors[members],
                    members,
                    as_values(batch.column("point_id")),
                    decode(batch.column("vector")),
                )

        if visits is None:
            add(points, np.arange(len(top_k)))
        else:
            at = points.column(visits.key).to_numpy()
            order = np.argsort(at, kind="stable")
            values, first = np.unique(at[order], return_index=True)
            chosen = visits.choose(vectors, queries, values)
            points = points.drop_columns([visits.key]).combine_chunks()
            for i, rows in enumerate(np.split(order, first[1:])):
                members = np.flatnonzero(chosen[:, i])
                if len(members):
                    add(points.take(pa.array(rows)), members)
        found = best.rows()
        if found is None:
            return empty
        query, ids, value = found
        return pa.Table.from_arrays(
            [
                queries.column("query_id").combine_chunks().take(pa.array(query)),
                pa.array(top_k[query], types[1]),
                pa.array(ids, types[2]),
                pa.array(value, types[3]),
            ],
            names=names,
        )

    return left.cogroup(right).applyInArrow(score, schema)


def grouped_blocks(
    side: DataFrame, name: str, block_rows: int, most_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """As :func:`large_parts`, of blocks that are taken together where there are more than
    ``BLOCK_GROUPS``: in groups of at most ``most_rows`` and ``block_bytes``, or ``block_rows``
    if that is more."""
    return large_parts(side, name, block_rows, block_bytes, max(most_rows, block_rows))


def large_parts(
    side: DataFrame, name: str, block_rows: int, block_bytes: int = BLOCK_BYTES,
    most_rows: int | None = None,
) -> DataFrame:
    """Parts above ``block_rows`` rows or ``block_bytes`` of vectors, and their number of blocks.

    With ``most_rows``, more than ``BLOCK_GROUPS`` blocks of ``block_rows`` are taken together in
    that many, or in as many as ``most_rows`` and ``block_bytes`` ask for.

    A task turns vectors to double, so a component counts 8 bytes. The counts are folded
    before the shuffle and read when the plan is built, so that a list of known length is
    broadcast and the vectors are not shuffled to learn their block; a longer list joins as
    the planner sees fit.
    """
    rows = F.ceil(F.count(F.lit(1)) / block_rows)
    if most_rows is not None:
        needed = F.ceil(F.count(F.lit(1)) / most_rows)
        rows = F.greatest(F.least(rows, F.lit(BLOCK_GROUPS)), needed)
    size = F.ceil(F.sum(F.size("vector").cast("long") * 8) / block_bytes)
    large = (
        side.groupBy("part")
        .agg(F.greatest(rows, size).cast("int").alias(name))
        .where(F.col(name) > 1)
    )
    listed = large.limit(MAX_LISTED_PARTS + 1).toArrow()
    if listed.num_rows > MAX_LISTED_PARTS:
        return large
    return F.broadcast(side.sparkSession.createDataFrame(listed.to_pylist(), large.schema))
