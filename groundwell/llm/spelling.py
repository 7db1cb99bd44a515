"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

A query walks down the sorted list of words as if it were a tree: words next to each other share
their longest common prefix, and for that prefix one row of the edit matrix is enough. Of each
row only the band of three cells within one edit of the diagonal is kept; a range of words whose
shared prefix already needs two edits is skipped as a whole. All queries of a list take each step
together, so that a step is a few array operations.

Lists are dealt out by halves. One edit leaves either the first half of the shorter word untouched,
or the rest of it, so near words meet in the list of a common beginning or, spelt backwards, of a
common end. A list holds the words of two lengths only. Longer lists than ``BLOCK`` are cut in
blocks, and each pair of blocks is a list of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.llm.common import pieces, ready, saved, utf8_list
from groundwell.operators.sizes import broadcast_if_small

#: Words shorter, or with fewer occurrences, take no part.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One run in so many loses a code point; a form occurs so many times as often.
DROPPED_EVERY = 31
FORM_FACTOR = 10
#: Words of one list; longer lists are cut in blocks of that size.
BLOCK = 8192
#: Words that a task takes up at once, whole lists of them.
STEP_WORDS = 1 << 14
#: Different words that a task counts before it hands them on.
HELD_WORDS = 1 << 17
#: Fixed value: letters are A to Z in either case and U+00C0 to U+00FF.
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def _words_of(doc_id: object, text: bytes) -> Iterator[tuple[str, int]]:
    """The words of a text with their occurrences. Equal runs of a text lose equal places."""
    runs = Counter(_RUN.findall(text.lower().decode("utf-8", "replace")))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), start)
        if h % DROPPED_EVERY == 0:
            place = h % len(word)
            word = word[:place] + word[place + 1 :]
        if len(word) >= LEAST_LENGTH:
            yield word, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts that occur ``LEAST_COUNT`` times or more."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                ["word", "n"],
            )

        counts: Counter[str] = Counter()
        for piece in pieces(batches):
            ids = piece.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, utf8_list(piece.column("text")), strict=True):
                for word, n in _words_of(doc_id, text):
                    counts[word] += n
            if len(counts) >= HELD_WORDS:
                yield rows()
                counts = Counter()
        yield rows()

    return (
        docs.select("doc_id", "text")
        .mapInArrow(work, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def _dealt(words: DataFrame) -> DataFrame:
    """``backward, size, key`` of each list that a word is in, and ``spelt``, the word in the
    direction of the list. ``size`` is the length of the shorter words of the list."""
    length = F.length("word")
    half = lambda size: F.floor(size / 2).cast("int")
    lists = F.array(
        *(
            F.struct(
                F.lit(backward).alias("backward"),
                size.cast("int").alias("size"),
                (size - half(size) if backward else half(size)).cast("int").alias("shared"),
            )
            for size in (length, length - 1)
            for backward in (False, True)
        )
    )
    spelt = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    return (
        words.select("word", "n", F.inline(lists))
        .where(F.col("size") >= LEAST_LENGTH)
        .select("backward", "size", "shared", spelt.alias("spelt"), "n")
        .withColumn("key", F.substring("spelt", F.lit(1), F.col("shared")))
    )


class SortedWords:
    """Words as Latin-1 bytes, one after the other, sorted inside each list.

    ``head`` is the first place of each list, ``shared`` the letters that all words of the list
    have in common at least.
    """

    def __init__(self, words: list[bytes], head: np.ndarray, shared: np.ndarray) -> None:
        self.letters = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        self.length = np.array([len(w) for w in words], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.head, self.shared = head, shared
        self.tail = np.append(head[1:], len(words))
        self.common = self._common()

    def at(self, word: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Letters of words; 0 beyond their ends."""
        inside = (place >= 0) & (place < self.length[word])
        return np.where(inside, self.letters[np.where(inside, self.offset[word] + place, -1)], 0)

    def _common(self) -> np.ndarray:
        """The length of the prefix that each word shares with the one before it in its list."""
        common = np.zeros(len(self.length), np.int64)
        open_ = np.arange(1, len(common))
        open_ = open_[~np.isin(open_, self.head)]
        depth = 0
        while len(open_):
            letter = self.at(open_, depth)
            open_ = open_[(letter == self.at(open_ - 1, depth)) & (letter > 0)]
            depth += 1
            common[open_] = depth
        return common

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """All ``(query, word)`` of a list that are exactly one edit apart, past what the list
        shares; each pair in both orders."""
        n = len(self.length)
        found_q, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lists = np.repeat(np.arange(len(self.head)), self.tail - self.head)
        # A row of the band: the edits of a prefix of d letters against d-1, d and d+1 letters
        # of the query. At the shared depth all prefixes are the query's own.
        waiting = {}
        for depth in np.unique(self.shared).tolist():
            query = np.flatnonzero(self.shared[lists] == depth)
            waiting[depth] = (
                query, self.head[lists[query]], self.tail[lists[query]],
                np.tile(np.array([1, 0, 1], np.int8), (len(query), 1)),
            )
        depth = min(waiting, default=0)
        query = low = high = np.zeros(0, np.int64)
        band = np.zeros((0, 3), np.int8)
        while len(query) or waiting:
            if depth in waiting:
                more = waiting.pop(depth)
                query, low, high = (
                    np.concatenate(x) for x in zip((query, low, high), more[:3], strict=True)
                )
                band = np.concatenate([band, more[3]])
            # The first of the words of a range ends here if any does.
            ends = self.length[low] == depth
            gap = self.length[query] - depth
            within = ends & (np.abs(gap) <= 1)
            rows = np.flatnonzero(within)
            rows = rows[band[rows, gap[rows] + 1] == 1]
            found_q.append(query[rows])
            found_w.append(low[rows])
            low = low + ends
            alive = low < high
            query, low, high, band = query[alive], low[alive], high[alive], band[alive]
            # Ranges fall apart where a word shares no more than this depth with the one before.
            starts = np.flatnonzero(self.common <= depth)
            first = np.searchsorted(starts, low, "right")
            last = np.searchsorted(starts, high, "left")
            many = last - first + 1
            parent = np.repeat(np.arange(len(query)), many)
            turn = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
            bound = np.append(starts, n)
            cut = first[parent] + turn
            new_low = np.where(turn == 0, low[parent], bound[cut - 1])
            new_high = np.where(turn == many[parent] - 1, high[parent], bound[np.minimum(cut, len(starts))])
            query, low, high, old = query[parent], new_low, new_high, band[parent]
            letter = self.at(low, depth)
            differ = [
                (letter != self.at(query, depth + shift)).astype(np.int8) for shift in (-1, 0, 1)
            ]
            left = np.minimum(old[:, 1] + 1, old[:, 0] + differ[0])
            middle = np.minimum(np.minimum(old[:, 2] + 1, old[:, 1] + differ[1]), left + 1)
            right = np.minimum(old[:, 2] + differ[2], middle + 1)
            band = np.minimum(np.stack([left, middle, right], axis=1), 2).astype(np.int8)
            stay = band.min(axis=1) <= 1
            query, low, high, band = query[stay], low[stay], high[stay], band[stay]
            depth += 1
            if not len(query) and waiting:
                depth = min(waiting)
        return np.concatenate(found_q), np.concatenate(found_w)


def _pairs(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """What each word of some whole lists finds: number of near words, and the best of them."""
    words = [w.encode("latin-1") for w in columns["spelt"]]
    keys = ("backward", "size", "key", "lo", "hi")
    new = np.ones(len(words), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= columns[key][1:] != columns[key][:-1]
    head = np.flatnonzero(new)
    made = SortedWords(words, head, columns["shared"][head].astype(np.int64))
    query, word = made.near()
    size, side = columns["size"], columns["side"]
    # Pairs of a list's shorter length, of unlike blocks, and, backwards, of unlike beginnings
    # only: each pair is then found in one list alone.
    length = made.length
    ok = np.minimum(length[query], length[word]) == size[query]
    ok &= (side[query] == 2) | (side[query] != side[word])
    query, word = query[ok], word[ok]
    back = np.flatnonzero(columns["backward"][query])
    if len(back):
        half = size[query[back]] // 2
        apart = [
            words[q][::-1][:h] != words[w][::-1][:h]
            for q, w, h in zip(query[back].tolist(), word[back].tolist(), half.tolist(), strict=True)
        ]
        keep = np.ones(len(query), bool)
        keep[back] = apart
        query, word = query[keep], word[keep]
    n = columns["n"]
    plain = np.array(
        [w[::-1] if b else w for w, b in zip(words, columns["backward"].tolist(), strict=True)] or [b""],
        object,
    )
    if len(query):
        _, rank = np.unique(plain, return_inverse=True)
        order = np.lexsort((rank[word], -n[word], query))
        query, word = query[order], word[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else query
    many = np.diff(np.append(first, len(query)))
    said = lambda rows: pa.array([plain[i].decode("latin-1") for i in rows], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            said(query[first]), pa.array(many, pa.int64()), said(word[first]),
            pa.array(n[word[first]], pa.int64()),
        ],
        ["word", "n_near", "form", "form_n"],
    )


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n`` of each of ``words`` (``word, n``, unique) that has a near
    word: their number and the one of them with the largest ``n``, of those the smallest.

    Words are of letters up to U+00FF and of ``LEAST_LENGTH`` or more.
    """
    ready(words.sparkSession)
    lists = ["backward", "size", "key"]
    dealt = _dealt(words)
    large = dealt.groupBy(*lists).count().where(F.col("count") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(BLOCK)), F.lit(1)).cast("int")
    other: Column = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = (
        dealt.join(broadcast_if_small(large), lists, "left")
        .withColumn("blocks", blocks)
        .withColumn("home", F.pmod(F.xxhash64("spelt"), "blocks").cast("int"))
        .withColumn("other", other)
        .select(
            *lists, "shared",
            F.least("home", "other").alias("lo"),
            F.greatest("home", "other").alias("hi"),
            F.when(F.col("home") == F.col("other"), 2)
            .otherwise((F.col("home") > F.col("other")).cast("int"))
            .alias("side"),
            "spelt", "n",
        )
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                values = column.to_numpy(zero_copy_only=False)
                held[name] = np.concatenate([held[name], values]) if name in held else values
            if len(held["n"]) < STEP_WORDS:
                continue
            new = np.zeros(len(held["n"]), bool)
            for key in (*lists, "lo", "hi"):
                new[1:] |= held[key][1:] != held[key][:-1]
            cut_at = np.flatnonzero(new)
            if len(cut_at):
                yield _pairs({k: v[: cut_at[-1]] for k, v in held.items()})
                held = {k: v[cut_at[-1] :] for k, v in held.items()}
        if held and len(held["n"]):
            yield _pairs(held)

    found = (
        cut.repartition(*lists, "lo", "hi")
        .sortWithinPartitions(*lists, "lo", "hi", "spelt")
        .mapInArrow(work, "word string, n_near bigint, form string, form_n bigint")
    )
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms`` (``word, form``), followed to the last by doubling steps.

    A form occurs ``FORM_FACTOR`` times as often as its word, so that chains are as short as the
    logarithm of the largest count.
    """
    steps = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = saved(
            steps.join(broadcast_if_small(onward), "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")
            )
        )
        steps = longer.drop("more")
        if longer.where("more").isEmpty():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``docs`` (``doc_id, text``).

    Words are maximal runs of the letters A to Z and U+00C0 to U+00FF with A to Z in lower case,
    of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences or more. Where the CRC-32 of
    ``<doc_id>:<run>`` is a multiple of ``DROPPED_EVERY``, the run first loses the code point at
    that number modulo its length. Words are near if one inserted, deleted or replaced code point
    tells them apart. ``form`` is the near word of largest ``n``, of those the first in code point
    order, if that is ``FORM_FACTOR`` times the word's own or more; ``root`` the last in the row
    of forms, the word itself without one.

    A null text has no runs, a null id is written as nothing; a repeated row counts again; an
    empty table gives an empty one. Other columns are left out.
    """
    words = saved(vocabulary(docs))
    near = near_words(words)
    enough = F.col("form_n") >= F.lit(FORM_FACTOR) * F.col("n")
    known = saved(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("form")).alias("form"),
            F.when(enough, F.col("form_n")).alias("form_n"),
        )
    )
    roots = _roots(known.where("form is not null").select("word", "form"))
    return known.join(broadcast_if_small(roots), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
