"""Quality by ordinal regression on graded ratings, with hashed text features.

A cumulative-link model has one weight per feature, shared by all grades, and ordered
thresholds: ``P(grade >= k) = logistic(w . x - threshold_k)``. From these tails come the
expected grade and the probability by which documents are selected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.llm.common import pieces, ready
from groundwell.operators.sizes import broadcast_if_small

#: Weights; features are hashed to them.
WEIGHTS = 1 << 18
#: Rated rows that the model is fitted on, at most.
FIT_ROWS = 8_000
STEPS = 120
PENALTY = 1e-5
#: Probability of the wanted grade from which a document is selected.
SELECT = 0.5
_SHAPES = (
    (re.compile(r"[a-zà-öø-ÿ]+"), "a"),
    (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"),
    (re.compile(r"[0-9]+"), "0"),
)


def grade(quality: Column, toxic: Column) -> Column:
    """Grades of the ratings: 0 low quality, 1 good but toxic, 2 good; null where unknown."""
    return (
        F.when(quality == 0, 0)
        .when((quality == 1) & (toxic == 1), 1)
        .when((quality == 1) & (toxic == 0), 2)
    )


def _place(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & (WEIGHTS - 1)


@lru_cache(maxsize=1 << 16)
def _word_places(word: str) -> tuple[int, int]:
    shape = word
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    return _place(f"w{word.lower()}"), _place(f"s{shape}")


def _bins(text: str, words: list[str], distinct: int) -> list[int]:
    """Features of the text as a whole, each cut in a few bins."""
    n, letters = max(len(words), 1), max(len(text), 1)
    capitals = sum(map(str.isupper, words)) / n
    repeats = 1 - distinct / n
    again = sum(map(str.__eq__, words, words[1:])) / n
    length = int(np.log2(n))
    signs = (letters - len(_ALNUM.sub("", text))) / letters
    return [
        _place(f"b{name}{int(value)}")
        for name, value in (
            ("length", length),
            ("capitals", 8 * capitals),
            ("repeats", 10 * repeats),
            ("again", 8 * again),
            ("signs", 20 * (1 - signs)),
            ("long", sum(map(len, words)) / n),
        )
    ]


_ALNUM = re.compile(r"[\W_]+")


def text_features(text: str | None) -> tuple[list[int], list[float]]:
    """Places and values: words and their shapes by frequency, and bins of the whole text."""
    words = (text or "").split()
    counts = Counter(words)
    places: list[int] = []
    values: list[float] = []
    if counts:
        amounts = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
        amounts /= np.sqrt((amounts**2).sum())
        for word, amount in zip(counts, amounts.tolist(), strict=True):
            places += _word_places(word) if len(word) <= 64 else (_place("long"),) * 2
            values += (amount, amount)
    bins = _bins(text or "", words, len(counts))
    return places + bins, values + [0.5] * len(bins)


@dataclass(frozen=True)
class Model:
    """One weight per hashed feature, and a threshold below each grade from the second on."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each text."""
        out = np.zeros((len(texts), len(self.thresholds)))
        for row, text in enumerate(texts):
            places, values = text_features(text)
            out[row] = self.weights[places] @ np.asarray(values) - self.thresholds
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(rows: list[tuple[list[int], list[float]]], grades: np.ndarray) -> Model:
    """Fit weights and thresholds by gradient steps of adapted size.

    Thresholds are kept in order by their distances, which are exponentials.
    """
    sizes = np.array([len(places) for places, _ in rows])
    places = np.concatenate([np.asarray(p, np.int64) for p, _ in rows])
    values = np.concatenate([np.asarray(v) for _, v in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    levels = max(int(grades.max()), 1)
    above = (grades[:, None] >= np.arange(1, levels + 1)).astype(float)
    weights = np.zeros(WEIGHTS)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    first = np.log(1 / share[:1] - 1)
    gaps = np.log(np.maximum(np.diff(np.log(1 / share - 1)), 1e-2))
    sums = [np.full(WEIGHTS, 1e-8), np.full(1, 1e-8), np.full(len(gaps), 1e-8)]
    for _ in range(STEPS):
        thresholds = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        margin = np.bincount(row, weights[places] * values, len(rows))
        tail = 1 / (1 + np.exp(-np.clip(margin[:, None] - thresholds, -30, 30)))
        # The probability of a grade is the difference of neighbouring tails.
        padded = np.column_stack([np.ones(len(rows)), tail, np.zeros(len(rows))])
        lower = padded[np.arange(len(rows)), grades]
        upper = padded[np.arange(len(rows)), grades + 1]
        chance = np.maximum(lower - upper, 1e-9)
        slope = np.zeros_like(tail)
        at = np.arange(len(rows))
        has_low, has_up = grades > 0, grades < levels
        d_low, d_up = lower * (1 - lower) / chance, upper * (1 - upper) / chance
        slope[at[has_low], grades[has_low] - 1] -= d_low[has_low]
        slope[at[has_up], grades[has_up]] += d_up[has_up]
        pull = slope.sum(1) / len(rows)
        steps = [
            np.bincount(places, pull[row] * values, WEIGHTS) + PENALTY * weights,
            np.array([-slope.mean(0).sum()]),
            np.array([-slope.mean(0)[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))]),
        ]
        for value, step, total in zip((weights, first, gaps), steps, sums, strict=True):
            total += step**2
            value -= 0.5 * step / np.sqrt(total)
    thresholds = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    return Model(weights, thresholds)


def fit(docs: DataFrame, ratings: DataFrame) -> Model:
    """Learn from ``docs`` (``doc_id, text``) and ``ratings`` (``doc_id, grade`` from 0).

    Fitted on a bounded sample of ``FIT_ROWS`` rated rows, drawn by a hash of the id. Null
    ids and grades are passed over, of contradicting grades the smallest counts. Without
    ratings, or with a single grade, all documents get the same grade.
    """
    spark = docs.sparkSession
    ready(spark)
    known = (
        ratings.where("doc_id is not null and grade >= 0")
        .groupBy("doc_id")
        .agg(F.min("grade").cast("int").alias("grade"))
    )
    share = min(1.0, 1.2 * FIT_ROWS / max(known.count(), 1))
    drawn = known.where(
        F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) <= int(share * (1 << 20))
    )
    met = docs.select("doc_id", "text").join(broadcast_if_small(drawn), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = [text_features(t) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("grade"),
                    pa.array([p for p, _ in found], pa.list_(pa.int32())),
                    pa.array([v for _, v in found], pa.list_(pa.float32())),
                ],
                ["grade", "places", "values"],
            )

    rows = (
        met.select("grade", "text")
        .mapInArrow(work, "grade int, places array<int>, values array<float>")
        .limit(FIT_ROWS)
        .toArrow()
    )
    grades = rows.column("grade").to_numpy()
    if len(set(grades.tolist())) < 2:
        only = int(grades[0]) if len(grades) else 0
        levels = max(only, 1)
        return Model(np.zeros(WEIGHTS), np.where(np.arange(1, levels + 1) <= only, -30.0, 30.0))
    features = zip(
        (x.values.to_numpy() for x in rows.column("places")),
        (x.values.to_numpy() for x in rows.column("values")),
        strict=True,
    )
    return train(list(features), grades)


def rate(docs: DataFrame, model: Model, wanted: int = 1) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tails`` (P(grade >= k)) and ``selected``.

    ``selected`` says that the grade is ``wanted`` or more with probability ``SELECT`` or
    more. A null text is rated as an empty one; repeated rows are rated alike; all other
    columns are kept, and columns called as the new ones replaced.
    """
    spark = docs.sparkSession
    ready(spark)
    new = ("expected_grade", "tails", "selected")
    names = [c for c in docs.columns if c not in new]
    # Numbered, so that no name of theirs is in the way, and every column travels once.
    numbered = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    text = f"c{names.index('text')}"
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            tails = shared.value.tails(piece.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(list(tails), pa.list_(pa.float64()))],
                [*piece.schema.names, "tails"],
            )

    fields = [*numbered.schema.fields, T.StructField("tails", T.ArrayType(T.DoubleType()))]
    tail = F.col("tails")[min(wanted, len(model.thresholds)) - 1]
    return numbered.mapInArrow(work, T.StructType(fields)).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        F.aggregate("tails", F.lit(0.0), lambda total, p: total + p).alias("expected_grade"),
        "tails",
        (tail >= SELECT).alias("selected"),
    )
