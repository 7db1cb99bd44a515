"""Vector expressions and embedding functions.

An embedder is a function from a text column to an ``ARRAY<FLOAT>`` column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.binding import let
from groundwell.session import ship_package

Embedder = Callable[[Column], Column]


def dot(left: Column, right: Column) -> Column:
    """Inner product, summed in double."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def l2_normalize(vector: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    return let(
        norm(vector),
        lambda n: F.transform(
            vector,
            lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")),
        ),
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity in double; 0 when a vector has no length."""
    length = norm(left) * norm(right)
    return F.when(length > 0, dot(left, right) / length).otherwise(
        F.when(F.isnan(length), length).otherwise(F.lit(0.0))
    )


def hash_embedding(text: Column, dimension: int = 8) -> Column:
    """Deterministic vector of a text: SHA-256 bytes over 255, repeated to width, length one."""
    raw = let(
        F.sha2(F.coalesce(text, F.lit("")), 256),
        lambda digest: F.transform(
            F.sequence(F.lit(0), F.lit(dimension - 1)),
            lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
            / 255,
        ),
    )
    return let(raw, l2_normalize).cast("array<float>")


def hash_embedder(dimension: int = 8) -> Embedder:
    return partial(hash_embedding, dimension=dimension)


_MODELS: dict[str, object] = {}


def model_embedder(
    load: Callable[[], object], name: str, batch_size: int = 32, normalize: bool = True
) -> Embedder:
    """Embedder around ``load().encode(list_of_texts) -> matrix``.

    The model is loaded once per Python worker and fed Arrow batches in slices of
    ``batch_size`` texts.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        ship_package(session)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # The closure is unpickled anew in every task; the module lives as long as the worker.
        from groundwell.functions import vectors

        model = vectors._MODELS.get(name)
        if model is None:
            model = vectors._MODELS[name] = load()
        for texts in batches:
            values = texts.fillna("").tolist()
            rows: list[np.ndarray] = []
            for start in range(0, len(values), batch_size):
                matrix = np.asarray(model.encode(values[start:start + batch_size]), np.float32)
                if normalize:
                    length = np.linalg.norm(matrix, axis=1, keepdims=True)
                    matrix = np.divide(matrix, length, out=matrix.copy(), where=length > 0)
                rows.extend(matrix)
            yield pd.Series(rows, index=texts.index, dtype=object)

    return embed

