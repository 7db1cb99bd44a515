"""Removal of repeated word sequences by compacting a graph of word k-mers.

An edge of the graph is a window of ``window`` consecutive words. Writing out every edge of
every document would multiply the corpus, so edges are handled in compacted form:

* Each window has an anchor, the k-mer of ``ANCHOR`` words in it whose hash is smallest
  (leftmost on a tie). Equal windows have equal anchors at equal places. The windows of a
  document that share one anchor occurrence are consecutive: they are a segment of the path.
* Segments with equal anchor and equal words are counted. An anchor with a single kind of
  segment is nonbranching: if that segment occurs twice, all its windows are repeated, and
  the whole path piece is settled without looking at single edges.
* At a branching anchor, where segments differ, one source coordinate per kind of segment is
  looked up again, its windows are hashed one by one and verified against each other.

Every step is a join or an aggregation of Spark; sequences are equal if two hashes of
64 bits are, that of the anchor and that of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.llm.common import Scratch, pieces, ready, saved, utf8_list, words_of

#: Words of a window that counts as a repeated span.
WINDOW = 35
#: Words of an anchor.
ANCHOR = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        words = words_of(text)
        counts[row] = len(words)
        hashes.extend(map(xxhash.xxh64_intdigest, words))
    return np.array(hashes, np.uint64), counts


class _Spans:
    """Hashes of any stretch of words, from running sums."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]), dtype=np.uint64)
        sums = np.cumsum(words * self.up[:n], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least of ``values[i:i + width]``, the first on a tie."""
    place = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        first, second = place[: len(place) - step], place[step:]
        place = np.where(values[second] < values[first], second, first)
        done += step
    return place


def segments(
    words: np.ndarray, counts: np.ndarray, window: int = WINDOW
) -> tuple[np.ndarray, ...]:
    """Segments of each text: row, first word (in the text), windows, anchor hash, words hash."""
    empty = np.zeros(0, np.int64)
    anchor = min(ANCHOR, window)
    if len(words) < window:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    spans = _Spans(words)
    at = np.arange(len(words) - anchor + 1)
    grams = spans.of(at, at + anchor)
    place = _leftmost_least(grams, window - anchor + 1)
    start = np.arange(len(place))
    start = start[start + window <= ends[row[start]]]
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[start[1:]] != row[start[:-1]])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(start)))
    first = start[heads]
    kind = spans.of(first, first + sizes + window - 1) ^ _mixed(sizes.astype(np.uint64))
    own = row[first]
    return own, first - (ends - counts)[own], sizes, grams[place[heads]], kind


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _segments_of(docs: DataFrame, window: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for piece in pieces(batches):
                words, counts = _word_hashes(utf8_list(piece.column("text")))
                own, first, sizes, anchors, kinds = segments(words, counts, window)
                texts = piece.column("t").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(anchors),
                        _signed(kinds),
                        pa.array(texts[own]),
                        pa.array(first),
                        pa.array(sizes),
                    ],
                    ["anchor", "kind", "t", "first", "n"],
                )

    return docs.select("t", "text").mapInArrow(
        work, "anchor bigint, kind bigint, t bigint, first bigint, n bigint"
    )


def _windows_of(located: DataFrame, window: int) -> DataFrame:
    """Each window of the segments ``at`` of a text: its hash and its place in the segment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for piece in pieces(batches):
                words, counts = _word_hashes(utf8_list(piece.column("text")))
                spans = _Spans(words)
                at = piece.column("at")
                base = np.repeat(np.cumsum(counts) - counts, pc.list_value_length(at))
                flat = at.flatten()
                first, n, anchor, kind, weight = (
                    flat.field(i).to_numpy(zero_copy_only=False) for i in range(5)
                )
                seg = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
                start = (base + first)[seg] + place
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[seg]),
                        pa.array(kind[seg]),
                        _signed(spans.of(start, start + window)),
                        pa.array(place),
                        pa.array(weight[seg]),
                    ],
                    ["anchor", "kind", "w", "place", "weight"],
                )

    return located.select("text", "at").mapInArrow(
        work, "anchor bigint, kind bigint, w bigint, place bigint, weight bigint"
    )


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """``t, spans``: for each distinct text its repeated stretches, as (first word, windows).

    ``docs`` has ``id, t, text``, where ``t`` is the hash of the text.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(_segments_of(docs, window))
    # Both values of ``first`` come from one row, whichever it is.
    kinds = found.groupBy("anchor", "kind").agg(
        F.count("*").alias("copies"),
        F.first("t").alias("t"),
        F.first("first").alias("first"),
        F.first("n").alias("n"),
    )
    branches = kinds.groupBy("anchor").agg(
        F.count("*").alias("branches"), F.sum("copies").alias("all")
    )
    repeated = scratch.save(kinds.join(branches.where("all > 1").drop("all"), "anchor"))
    run = lambda skip, n: F.struct(skip.alias("skip"), n.alias("n"))
    # A segment that occurs twice is repeated as a whole, whether its anchor branches or not.
    whole = repeated.where("copies > 1").select(
        "anchor", "kind", F.array(run(F.lit(0).cast("long"), F.col("n"))).alias("runs")
    )
    weight = F.least("copies", F.lit(2)).cast("long").alias("weight")
    looked_up = (
        repeated.where("branches > 1")
        .groupBy("t")
        .agg(F.collect_list(F.struct("first", "n", "anchor", "kind", weight)).alias("at"))
        # One copy of a text is enough.
        .join(docs.groupBy("t").agg(F.min("id").alias("id")), "t")
    )
    # A repeated row is looked up twice; all its segments count as repeated anyway.
    windows = scratch.save(_windows_of(docs.join(looked_up, ["t", "id"]), window))
    shared = windows.groupBy("anchor", "w").agg(F.sum("weight").alias("all")).where("all > 1")
    single = (
        windows.where("weight = 1")
        .join(shared.drop("all"), ["anchor", "w"])
        .groupBy("anchor", "kind")
        .agg(F.collect_set("place").alias("places"))
        .select(
            "anchor",
            "kind",
            F.transform("places", lambda p: run(p, F.lit(1).cast("long"))).alias("runs"),
        )
    )
    spans = saved(
        found.select("anchor", "kind", "t", "first")
        .join(whole.unionByName(single), ["anchor", "kind"])
        .groupBy("t")
        .agg(F.collect_set(F.struct("first", "runs")).alias("spans"))
    )
    scratch.drop()
    return spans


def _kept(text: bytes, spans: list[dict] | None, window: int) -> tuple[bytes, int, int]:
    words = words_of(text)
    if not spans:
        return b" ".join(words), len(words), 0
    edge = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        for run in span["runs"]:
            first = span["first"] + run["skip"]
            edge[first] += 1
            edge[first + run["n"] + window - 1] -= 1
    gone = (np.cumsum(edge)[:-1] > 0).tolist()
    kept = [w for w, out in zip(words, gone, strict=True) if not out]
    return b" ".join(kept), len(words), len(words) - len(kept)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, respaced: bool = True
) -> DataFrame:
    """``docs`` with the columns ``kept_text, n_words, n_removed`` in place of ``text``.

    Removed is every word covered by a window of ``window`` consecutive words of one document
    whose words also start anywhere else, in the same document too. All copies go. Windows
    are judged on the input. Words are joined by one space in what is kept; without
    ``respaced`` a text that loses no word stays as it is.

    A null text has no words; a text shorter than a window loses none; a repeated row counts
    as another document with the same text, so that both lose all windows. ``doc_id`` may be
    null or repeated. An empty table gives an empty one. Other columns are passed on; columns
    of ``docs`` that are called as the new ones are replaced.
    """
    ready(docs.sparkSession)
    new = ["kept_text", "n_words", "n_removed"]
    rest = [c for c in docs.columns if c not in (*new, "text")]
    keyed = docs.select(
        F.xxhash64("doc_id").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"),
        "text",
        F.struct(*rest).alias("rest") if rest else F.lit(None).cast("string").alias("rest"),
    )
    spans = repeated_spans(keyed.select("id", "t", "text"), window)
    met = keyed.join(spans, "t", "left").select("rest", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            done = [
                _kept(text, found, window)
                for text, found in zip(
                    utf8_list(piece.column("text")), piece.column("spans").to_pylist(), strict=True
                )
            ]
            if not respaced:
                texts = utf8_list(piece.column("text"))
                done = [d if d[2] else (t, *d[1:]) for d, t in zip(done, texts, strict=True)]
            columns = list(zip(*done, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("rest"),
                    pa.array(columns[0], pa.binary()).cast(pa.string()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                ],
                ["rest", *new],
            )

    fields = [met.schema["rest"], T.StructField("kept_text", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in new[1:]]
    out = met.mapInArrow(work, T.StructType(fields))
    return out.select(*([F.col("rest")[c].alias(c) for c in rest]), *new)
