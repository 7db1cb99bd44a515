"""Toxicity scores from two Kneser-Ney models of characters, one per class.

Each class, toxic and ordinary, has its own counts of ``ORDER``-grams of characters. Both are
interpolated with one lower order whose continuation counts are gathered over both classes, so
that an expression too rare to tell the classes apart is as likely under either, and what is
left in the ratio of the two likelihoods is evidence. A document is scored by the difference of
its two log-likelihoods, per character of the whole text and per word of its most telling words;
a logistic curve, fitted on rows that were not counted, turns these into a probability.

Every counted gram is kept. Up to ``HELD_GRAMS`` of them go to the tasks as a whole; more stay a
table, which the distinct grams of each chunk of documents are joined with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.llm.common import pieces, ready, saved
from groundwell.operators.sizes import broadcast_if_small

#: Characters of a gram; its last one is predicted from the others.
ORDER = 5
_BITS = 12
#: Characters of the shared lower order; the last level is single characters.
LOWER = 3
#: The difference is averaged over so many most telling words of a text.
TELLING = (1, 4, 10)
#: Grams up to which tasks hold the whole model, of some 40 bytes a gram; more are joined.
HELD_GRAMS = 1 << 21
#: About as many bytes of text make a chunk whose grams are looked up together.
CHUNK_BYTES = 8 << 20
#: Rows that the logistic curve is fitted on, at most.
CURVE_ROWS = 20_000
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3
#: Grams that a task holds before it gives up their counts.
_HELD = 1 << 21
_LOW, _HIGH = np.uint64(0x6C8E9CF5), np.uint64(0x5851F42D)


def fold(doc_id: Column) -> Column:
    """The fold of a document, 0 to 3; 2 is held out. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)), F.lit(0))


def _characters(text: str | None) -> np.ndarray:
    """Folded code points of a text in lower case with single blanks, one at each end."""
    plain = f" {' '.join((text or '').lower().split())} "
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points ^ (points >> _BITS)) & ((1 << _BITS) - 1)).astype(np.uint64)


def _grams(characters: np.ndarray) -> np.ndarray:
    """Every gram as one number, the predicted character in the lowest bits."""
    n = len(characters) - ORDER + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for place in range(ORDER if n > 0 else 0):
        grams = (grams << np.uint64(_BITS)) | characters[place : place + n]
    return grams


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """``gram, toxic, ordinary``: how often each gram occurs in texts of either class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        size = 0

        def merged() -> pa.RecordBatch:
            found, counts, kinds = [], [], []
            for kind, parts in held.items():
                if parts:
                    grams, count = np.unique(np.concatenate(parts), return_counts=True)
                    found.append(grams)
                    counts.append(count)
                    kinds.append(np.full(len(grams), kind))
                    parts.clear()
            grams, count = np.concatenate(found), np.concatenate(counts)
            kind = np.concatenate(kinds)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(grams.view(np.int64)),
                    pa.array(np.where(kind == 1, count, 0)),
                    pa.array(np.where(kind == 1, 0, count)),
                ],
                ["gram", "toxic", "ordinary"],
            )

        for piece in pieces(batches):
            for text, kind in zip(piece.column("text"), piece.column("toxic"), strict=True):
                grams = _grams(_characters(text.as_py()))
                held[kind.as_py()].append(grams)
                size += len(grams)
                if size > _HELD:
                    yield merged()
                    size = 0
        if size:
            yield merged()

    parts = labelled.mapInArrow(work, "gram bigint, toxic bigint, ordinary bigint")
    return parts.groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    )


def _low(column: str, characters: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << (_BITS * characters)) - 1))


def _history(column: str) -> Column:
    return F.shiftright(column, _BITS)


def _discount(ones: int | None, twos: int | None) -> float:
    ones, twos = ones or 0, twos or 0
    return ones / (ones + 2 * twos) if ones else 0.5


def _shared_lower(grams: DataFrame) -> DataFrame:
    """``low, lower``: probability of the last of ``LOWER`` characters, for both classes.

    Kneser-Ney: what counts is in how many different surroundings a sequence occurs.
    """
    discount = 0.75
    low = grams.groupBy(_low("gram", LOWER).alias("low")).agg(F.count("*").alias("n"))
    # At most 4,096 single characters.
    single = low.groupBy(_low("low", 1).alias("last")).agg(F.count("*").alias("m"))
    total = low.count()
    before = low.groupBy(_history("low").alias("before")).agg(
        F.sum("n").alias("sum"), F.count("*").alias("kinds")
    )
    alone = F.col("m") / F.lit(max(total, 1)) * 0.99 + 0.01 / (1 << _BITS)
    return (
        low.withColumn("before", _history("low"))
        .withColumn("last", _low("low", 1))
        .join(before, "before")
        .join(F.broadcast(single), "last")
        .select(
            "low",
            (
                (F.col("n") - discount) / F.col("sum")
                + discount * F.col("kinds") / F.col("sum") * alone
            ).alias("lower"),
        )
    )


def _ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, weight, ratio``: log-likelihood ratios of grams, and of backing off per history."""
    ones = grams.agg(
        *(
            F.sum((F.col(c) == n).cast("long")).alias(f"{c}{n}")
            for c in ("toxic", "ordinary")
            for n in (1, 2)
        )
    ).first()
    history = grams.groupBy(_history("gram").alias("history")).agg(
        *(F.sum(c).alias(f"{c}_sum") for c in ("toxic", "ordinary")),
        *(F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("toxic", "ordinary")),
    )
    spare = {}
    for c in ("toxic", "ordinary"):
        d = _discount(ones[f"{c}1"], ones[f"{c}2"])
        some = F.col(f"{c}_sum") > 0
        history = history.withColumn(
            f"{c}_spare",
            F.when(some, d * F.col(f"{c}_kinds") / F.col(f"{c}_sum")).otherwise(F.lit(1.0)),
        )
        own = F.when(some, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"{c}_sum"))
        spare[c] = F.coalesce(own, F.lit(0.0)) + F.col(f"{c}_spare") * F.col("lower")
    met = (
        grams.withColumn("history", _history("gram"))
        .withColumn("low", _low("gram", LOWER))
        .join(_shared_lower(grams), "low")
        .join(history, "history")
    )
    seen = met.select(
        F.col("gram").alias("key"),
        (F.col("toxic") + F.col("ordinary")).alias("weight"),
        F.log(spare["toxic"] / spare["ordinary"]).alias("ratio"),
    )
    unseen = history.select(
        F.col("history").alias("key"),
        (F.col("toxic_sum") + F.col("ordinary_sum")).alias("weight"),
        F.log(F.col("toxic_spare") / F.col("ordinary_spare")).alias("ratio"),
    )
    return seen, unseen


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    low, high = keys & np.uint64((1 << 30) - 1), keys >> np.uint64(30)
    return (((low * _LOW + high * _HIGH) >> np.uint64(24)) & np.uint64(slots - 1)).astype(np.int64)


#: Keys and their ratios in order of slots, and where each slot begins and the last one ends.
Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def _in_slots(keys: np.ndarray, values: np.ndarray, slots: int) -> Table:
    """All keys and ratios in order of their slots; a slot holds any number of keys."""
    slot = _slot(keys, slots)
    order = np.argsort(slot, kind="stable")
    starts = np.zeros(slots + 1, np.int64)
    np.cumsum(np.bincount(slot, minlength=slots), out=starts[1:])
    return keys[order], values[order].astype(np.float32), starts


def _slots(ratios: DataFrame, slots: int) -> Table:
    """All rows of ``ratios`` (``key, ratio``) as a table of so many slots, on the driver."""
    rows = ratios.select("key", "ratio").toArrow()
    keys = rows.column("key").to_numpy().astype(np.int64).view(np.uint64)
    return _in_slots(keys, rows.column("ratio").to_numpy(), slots)


def _slots_for(keys: int) -> int:
    return 1 << max(keys - 1, 1).bit_length()


def _places(wanted: np.ndarray, table: Table) -> np.ndarray:
    """Where each wanted key stands in the table; -1 if it does not."""
    keys, _, starts = table
    slot = _slot(wanted, len(starts) - 1)
    at, end = starts[slot], starts[slot + 1]
    places = np.full(len(wanted), -1, np.int64)
    rest = np.flatnonzero(at < end)
    while len(rest):
        hit = keys[at[rest]] == wanted[rest]
        places[rest[hit]] = at[rest[hit]]
        rest = rest[~hit]
        at[rest] += 1
        rest = rest[at[rest] < end[rest]]
    return places


def _ratio_of(grams: np.ndarray, tables: tuple[Table, Table]) -> np.ndarray:
    """The log-likelihood ratio of each predicted character."""
    seen, spare = tables
    out = np.zeros(len(grams), np.float32)
    places = _places(grams, seen)
    met = places >= 0
    out[met] = seen[1][places[met]]
    unseen = np.flatnonzero(~met)
    places = _places(grams[unseen] >> np.uint64(_BITS), spare)
    met = places >= 0
    out[unseen[met]] = spare[1][places[met]]
    return out.astype(np.float64)


def text_features(text: str | None, tables: tuple) -> list[float]:
    """Differences of log-likelihood: per character, and per word of the most telling words."""
    characters = _characters(text)
    grams = _grams(characters)
    if not len(grams):
        return [0.0] * (1 + len(TELLING))
    ratios = _ratio_of(grams, tables)
    ends = characters[ORDER - 1 : -1] == ord(" ")
    words = np.bincount(np.concatenate([[0], np.cumsum(ends)]), ratios)
    top = np.sort(words)[::-1]
    return [float(ratios.mean()), *(float(top[:most].mean()) for most in TELLING)]


@dataclass(frozen=True)
class Model:
    """What scores a text: the ratios of grams and of histories, and the logistic curve.

    The ratios are held by the tasks, or two tables ``key, ratio`` where they are too many.
    """

    ratios: Broadcast | tuple[DataFrame, DataFrame]
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def _curve_scores(features: np.ndarray, curve: tuple[np.ndarray, ...]) -> np.ndarray:
    weights, center, scale = curve
    plain = (features - center) / scale
    return 1 / (1 + np.exp(-np.clip(plain @ weights[1:] + weights[0], -30, 30)))


def _with_features(
    docs: DataFrame,
    text: str,
    ratios: Broadcast | tuple[DataFrame, DataFrame],
    made: Callable[[np.ndarray], pa.Array],
    field: T.StructField,
) -> DataFrame:
    """``docs`` with one more column, ``made`` from the features of the texts of a piece."""
    schema = T.StructType([*docs.schema.fields, field])

    def worked(batches: Iterator[pa.RecordBatch], tables: tuple) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            found = [text_features(t.as_py(), tables) for t in piece.column(text)]
            more = made(np.array(found).reshape(len(found), -1))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, more], [*piece.schema.names, field.name]
            )

    if isinstance(ratios, Broadcast):
        return docs.mapInArrow(lambda batches: worked(batches, ratios.value), schema)

    # The chunk follows from the row itself, so that a task that is run again finds the same.
    told = [f.name for f in docs.schema if isinstance(f.dataType, (T.StringType, T.NumericType))]
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64(*told), F.lit(-(-total // CHUNK_BYTES) or 1))
    dealt = docs.withColumn("chunk", chunk)

    def distinct(key: tuple, group: pa.Table) -> pa.Table:
        parts = [np.zeros(0, np.uint64)]
        for piece in pieces(iter(group.to_batches()), text):
            own = [_grams(_characters(t.as_py())) for t in piece.column(text)]
            parts.append(np.unique(np.concatenate(own)))
        grams = np.unique(np.concatenate(parts)).view(np.int64)
        chunks = pa.array(np.full(len(grams), key[0].as_py(), np.int64))
        return pa.table({"chunk": chunks, "gram": pa.array(grams)})

    seen, spare = ratios
    looked = (
        dealt.groupBy("chunk")
        .applyInArrow(distinct, "chunk bigint, gram bigint")
        .withColumn("history", _history("gram"))
        .join(seen.select(F.col("key").alias("gram"), F.col("ratio").alias("own")), "gram", "left")
        .join(
            spare.select(F.col("key").alias("history"), F.col("ratio").alias("backed")),
            "history",
            "left",
        )
        .select("chunk", "gram", F.coalesce("own", "backed").alias("ratio"))
        .where("ratio is not null")
    )

    def scored(group: pa.Table, found: pa.Table) -> pa.Table:
        grams = found.column("gram").to_numpy().astype(np.int64).view(np.uint64)
        values = found.column("ratio").to_numpy().astype(np.float64)
        none = np.zeros(0)
        tables = (
            _in_slots(grams, values, _slots_for(len(grams))),
            _in_slots(none.astype(np.uint64), none, 1),
        )
        rows = group.drop_columns(["chunk"]).to_batches()
        return pa.Table.from_batches(worked(iter(rows), tables))

    return dealt.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(scored, schema)


def _curve(features: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method, slightly drawn to zero."""
    center, scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - center) / scale])
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - toxic) + 0.5 * np.r_[0.0, weights[1:]]
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights, center, scale


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs`` (``doc_id, text``) that ``labels`` (``doc_id, toxic``) names.

    Folds 0 and 1 are counted, all of their rows; fold 3 gives the curve, from a bounded
    sample of ``CURVE_ROWS``; fold 2 is not looked at. Labels that are null, or contradict
    each other for a document, are passed over. Without rows of both classes in both parts
    every score is the share of toxic labels, or a half without any.
    """
    spark = docs.sparkSession
    ready(spark)
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most"))
        .where("toxic = most")
        .select("doc_id", "toxic", fold(F.col("doc_id")).alias("fold"))
        .where("fold != 2")
    )
    labelled = docs.select("doc_id", "text").join(broadcast_if_small(known), "doc_id")
    grams = saved(_gram_counts(labelled.where("fold in (0, 1)").select("text", "toxic")))
    seen, unseen = _ratios(grams)
    count = grams.count()
    if count <= HELD_GRAMS:
        slots = _slots_for(count)
        ratios = spark.sparkContext.broadcast((_slots(seen, slots), _slots(unseen, slots)))
    else:
        ratios = saved(seen.select("key", "ratio")), saved(unseen.select("key", "ratio"))
    rest = labelled.where("fold = 3").withColumn("draw", F.xxhash64("doc_id"))
    total = known.where("fold = 3").count()
    share = min(1.0, CURVE_ROWS / max(total, 1))
    drawn = rest.where(F.pmod("draw", F.lit(1 << 20)) <= int(share * (1 << 20)))
    listed = T.StructField("features", T.ArrayType(T.DoubleType()))
    rows = (
        _with_features(
            drawn.select("toxic", "draw", "text"), "text", ratios,
            lambda found: pa.array(list(found), pa.list_(pa.float64())), listed,
        )
        .select("toxic", "features")
        .limit(2 * CURVE_ROWS)
        .toArrow()
    )
    toxic = rows.column("toxic").to_numpy().astype(np.float64)
    n = 1 + len(TELLING)
    if len(set(toxic.tolist())) < 2:
        share = min(max(float(toxic.mean()) if len(toxic) else 0.5, 1e-6), 1 - 1e-6)
        weights = np.r_[np.log(share / (1 - share)), np.zeros(n)]
        return Model(ratios, weights, np.zeros(n), np.ones(n))
    features = np.array(rows.column("features").to_pylist(), np.float64)
    return Model(ratios, *_curve(features, toxic))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on).

    A null or empty text is scored as one without evidence. All columns are kept, repeated
    rows too; columns called as the new ones are replaced.
    """
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    # Numbered, so that no name of theirs is in the way, and every column travels once.
    numbered = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    curve = model.weights, model.center, model.scale
    return _with_features(
        numbered, f"c{names.index('text')}", model.ratios,
        lambda found: pa.array(_curve_scores(found, curve)),
        T.StructField("score", T.DoubleType()),
    ).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, learnt from ``labels``."""
    own = docs.select("doc_id", "text")
    return score(own, fit(own, labels)).select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    # Columns called as the new ones are put aside meanwhile.
    aside = [f"aside {i}" if c in ("score", "predicted") else c for i, c in enumerate(docs.columns)]
    kept = score(docs.toDF(*aside), fit(docs, labels)).where("predicted = 0")
    return kept.select(*(F.col(f"`{a}`").alias(c) for a, c in zip(aside, docs.columns, strict=True)))
