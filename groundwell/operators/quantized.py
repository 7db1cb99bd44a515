"""Approximate top-k over product-quantised codes, re-ranked by the vectors themselves.

A stored vector is the center of its cell and a residual; the residual is cut in subspaces, and
each part is replaced by the number of the nearest entry of that subspace's codebook. The codes
take a few bytes where the vector takes hundreds. A search scores codes: the query stays as it
is, stored rows are decoded from the codebooks inside the tasks. The best of them, a short list
of bounded length per query, are looked up in full and ranked by their exact scores, so that
whatever is found has its true score and place.

Centers and codebooks are fitted once, on a bounded part of the points, and stored beside the
codes. They guide a search and do not decide what it may find: every point has a code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from groundwell.operators.scoring import SCORE_DECIMALS, as_matrix
from groundwell.operators.search import (
    BLOCK_ROWS,
    SMALL_QUERY_ROWS,
    normal_requests,
    rank_hits,
    satisfying,
    score_in_blocks,
    score_in_place,
    small_table,
)
from groundwell.operators.sizes import broadcast_if_small
from groundwell.session import ship_package
from groundwell.settings import SEARCH_TOP_K_MAX, Settings, shared_folder

# Points that centers and codebooks are fitted on at most.
FIT_ROWS = 16_384
# Entries of a codebook; a code is one byte.
CODES = 256
# Places of the short list for each place of the result.
SHORTLIST = 16


def _lloyd(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most ``k`` means of a bounded number of rows."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= k:
        return distinct
    means = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(rows, means)
        sums = np.zeros_like(means)
        np.add.at(sums, near, rows)
        count = np.bincount(near, minlength=k)[:, None]
        means = np.where(count > 0, sums / np.maximum(count, 1), means)
    return means


def _nearest(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    return (((means**2).sum(axis=1) / 2)[None, :] - rows @ means.T).argmin(axis=1)


@dataclass(frozen=True)
class Quantizer:
    """Unit centers of the cells, and the codebooks of their residuals, one per subspace."""

    centers: np.ndarray
    books: tuple[np.ndarray, ...]

    @property
    def dimension(self) -> int:
        return self.centers.shape[1]

    @classmethod
    def fit(
        cls, points: DataFrame, n_cells: int = 16, n_subspaces: int = 16,
        vector: str = "vector", seed: int = 7, fit_rows: int = FIT_ROWS,
    ) -> Quantizer:
        """Fitted on ``fit_rows`` points at most, those of the smallest hash of their vector.

        Points without a vector, or of another width than most of these, take no part.
        """
        sample = (
            points.where(F.col(vector).isNotNull())
            .select(F.col(vector).cast("array<float>").alias("v"))
            .orderBy(F.xxhash64("v"), F.size("v"))
            .limit(fit_rows)
            .toArrow()
        ).column("v").combine_chunks()
        if not len(sample):
            raise ValueError("no vectors to fit on")
        widths = np.array(sample.value_lengths())
        width = int(np.bincount(widths).argmax())
        rows = as_matrix(sample.filter(pa.array(widths == width)))
        rows = rows[np.isfinite(rows).all(axis=1)]
        rng = np.random.default_rng(seed)
        centers = _lloyd(rows, n_cells, rng)
        residuals = rows - centers[_nearest(rows, centers)]
        cuts = np.linspace(0, width, min(n_subspaces, width) + 1).astype(int)
        books = tuple(
            _lloyd(residuals[:, a:b], CODES, rng) for a, b in zip(cuts, cuts[1:], strict=False)
        )
        return cls(centers, books)

    def save(self, spark: SparkSession, path: str) -> None:
        """Stored as rows ``book, entry, values``; book -1 holds the centers."""
        rows = [
            (book, entry, values.tolist())
            for book, matrix in enumerate((self.centers, *self.books), -1)
            for entry, values in enumerate(matrix)
        ]
        spark.createDataFrame(rows, "book int, entry int, values array<double>").coalesce(
            1
        ).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Quantizer:
        """At most ``CODES`` rows for each subspace, and one for each cell."""
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r["book"], r["entry"]))
        last = rows[-1]["book"]
        books = [np.array([r["values"] for r in rows if r["book"] == b]) for b in range(-1, last + 1)]
        return cls(books[0], tuple(books[1:]))

    def _cuts(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """Cell and codes of unit rows."""
        cell = _nearest(rows, self.centers)
        rest, cuts = rows - self.centers[cell], self._cuts()
        parts = [_nearest(rest[:, a:b], book) for a, b, book in zip(cuts, cuts[1:], self.books)]
        return np.stack([cell, *parts], axis=1).astype(np.int16)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The unit rows that cells and codes stand for."""
        parts = [book[codes[:, i + 1]] for i, book in enumerate(self.books)]
        rows = self.centers[codes[:, 0]] + np.concatenate(parts, axis=1)
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)

    def encode(self, points: DataFrame, vector: str = "vector") -> DataFrame:
        """``points`` with ``codes ARRAY<SMALLINT>`` in place of the vector: the cell and a code
        per subspace. Points without a vector of this width have none."""
        ship_package(points.sparkSession)
        dimension, codes = self.dimension, self.codes

        @F.pandas_udf("array<smallint>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == dimension]
                out: list[np.ndarray | None] = [None] * len(vectors)
                if fits:
                    # A component that is not a number is coded as zero; its score is exact later.
                    rows = np.nan_to_num(
                        np.stack([vectors.iloc[i] for i in fits]).astype(np.float64),
                        posinf=0.0, neginf=0.0,
                    )
                    length = np.linalg.norm(rows, axis=1, keepdims=True)
                    rows = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
                    for i, coded in zip(fits, codes(rows), strict=True):
                        out[i] = coded
                yield pd.Series(out, index=vectors.index, dtype=object)

        return points.withColumn("codes", encode(F.col(vector).cast("array<float>"))).drop(vector)


def search_quantized(
    quantizer: Quantizer,
    coded: DataFrame,
    points: DataFrame,
    queries: DataFrame,
    top_k: int | None = Settings.default_top_k,
    *,
    shortlist: int = SHORTLIST,
    point_id: str = "chunk_id",
    query_id: str = "query_id",
    vector: str = "vector",
    metadata: str = "metadata",
    max_top_k: int = SEARCH_TOP_K_MAX,
    small_query_rows: int = SMALL_QUERY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Hits (``query_id, rank, point_id, score``) and the short list they are taken from.

    ``coded`` are the encoded ``points`` (unique ids); queries are those of
    :func:`groundwell.operators.search.search`, filters and own ``top_k`` included. For each
    query the best ``shortlist * top_k`` codes are looked up in ``points``: only these vectors
    are read in full for a score. The short list is saved, and the searches of both are exact
    where it holds all candidates.
    """
    spark = points.sparkSession
    ship_package(spark)
    requests = normal_requests(queries, top_k, max_top_k, query_id, vector).where(
        F.size("vector") == quantizer.dimension
    )
    # Stored rows are as wide as their codes, and meet queries of that part.
    part = F.concat(
        F.lit(f"{len(quantizer.books) + 1}:"), F.expr("substring(part, instr(part, ':') + 1)")
    )
    asked = requests.withColumn("part", part).withColumn("top_k", F.col("top_k") * shortlist)
    small = small_table(asked, small_query_rows)
    stored = satisfying(
        coded.select(
            F.col(point_id).alias("point_id"), F.col("codes").alias("vector"),
            *([F.col(metadata).alias("metadata")] if "filters" in asked.columns else []),
        ),
        asked,
        small,
    )

    def decode(column: pa.Array) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return quantizer.decoded(flat.reshape(len(column), -1))

    asked = asked.drop("filters")
    if small is not None:
        near = score_in_place(stored, small, asked.schema["query_id"].dataType, decode)
    else:
        near = score_in_blocks(stored, asked, block_rows, decode=decode)
    shared_folder(spark)
    short = rank_hits(near, max_top_k * shortlist).select("query_id", "point_id").checkpoint()
    own = requests.select("query_id", F.col("vector").alias("asked"), "top_k")
    full = points.select(F.col(point_id).alias("point_id"), F.col(vector).alias("vector"))
    pairs = broadcast_if_small(short).join(full, "point_id").join(
        broadcast_if_small(own), "query_id"
    )
    exact = rank_hits(_scored(pairs), max_top_k, query_id=query_id, point_id=point_id)
    return exact, short


def _scored(pairs: DataFrame) -> DataFrame:
    """``query_id, top_k, point_id, score``: the exact cosine of each pair of vectors."""
    schema = StructType(
        [pairs.schema[c] for c in ("query_id", "top_k", "point_id")]
        + [StructField("score", DoubleType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [as_matrix(batch.column(c)) for c in ("asked", "vector")]
            value = np.round(np.einsum("ij,ij->i", *sides), SCORE_DECIMALS) + 0.0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("query_id", "top_k", "point_id")), pa.array(value)],
                schema.fieldNames(),
            )

    return pairs.select("query_id", "top_k", "point_id", "asked", "vector").mapInArrow(score, schema)
