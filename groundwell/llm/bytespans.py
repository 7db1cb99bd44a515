"""Removal of byte strings that also start in an earlier document, by sharded suffix arrays.

A suffix array over all texts would be one object. Here every window of ``window`` bytes goes to
a shard that is told by its content: the least hash of its ``ANCHOR``-byte substrings (leftmost
on a tie). Equal windows have equal anchors and meet in one shard; the windows that one anchor
occurrence covers are consecutive and travel as one segment. Each shard sorts the suffixes of its
distinct segments by induction (``suffixes``), takes the permuted common prefixes, and the windows
of one run of suffixes that share ``window`` bytes or more are equal: byte by byte, not by hash.
Segments without a window whose hash another place of the shard has too are equal to nothing and
are left out of the sort.

Before texts travel, anchors that occur in one document only drop out: tasks send lists of
anchor hashes, and are told which of them another document has too. Anchors with very many
segments are cut into single windows, so that no anchor is too large for its shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.llm.common import Scratch, pieces, ready, utf8_list
from groundwell.llm.suffixes import permuted_common_prefixes, suffix_array

#: Fixed value: bytes of a string that counts as repeated.
WINDOW = 50
#: Bytes of an anchor.
ANCHOR = 20
#: Bytes of text of a piece, which one task holds at once; one longer text is a piece alone.
PIECE_BYTES = 1 << 22
#: Bytes of text that send their anchors to one list, and their segments to one shard, if all
#: of them were repeated.
PART_BYTES = 1 << 26
SHARD_BYTES = 1 << 22
#: Segments of an anchor beyond which it is cut into single windows.
HOT_SEGMENTS = 20_000
#: Window starts that are hashed at a time; positions among them take 20 bits.
_SLICE = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15
_NEVER = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _grams(letters: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` bytes, put together from those of powers of two."""
    power = letters.astype(np.uint64) + np.uint64(1)
    size, done, out = 1, 0, None
    while width > done:
        if width & size:
            if out is None:
                out = power
            else:
                n = len(power) - done
                out = out[:n] * np.uint64(pow(_FACTOR, size, 1 << 64)) + power[done:]
            done += size
        n = len(power) - size
        if done < width:
            power = power[:n] * np.uint64(pow(_FACTOR, size, 1 << 64)) + power[size:]
            size *= 2
    return _mixed(out)


class Segments:
    """Segments of a row of texts: ``row``, ``first`` byte in the text, number of windows ``n``,
    the hash of the ``anchor``, and ``at``, the first byte in ``letters``."""

    def __init__(self, texts: list[bytes], window: int = WINDOW) -> None:
        anchor = min(ANCHOR, window)
        self.window = window
        self.letters = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        parts: list[tuple[np.ndarray, ...]] = []
        total = len(self.letters) - window + 1
        with np.errstate(over="ignore"):
            for low in range(0, max(total, 0), _SLICE):
                high = min(low + _SLICE, total)
                grams = _grams(self.letters[low : high + window - 1], anchor)
                places = np.arange(len(grams), dtype=np.uint64)
                least = (grams & np.uint64(~0xFFFFF & 0xFFFFFFFFFFFFFFFF)) | places
                done, wide = 1, window - anchor + 1
                while done < wide:
                    step = min(done, wide - done)
                    least = np.minimum(least[: len(least) - step], least[step:])
                    done += step
                place = (least & np.uint64(0xFFFFF)).astype(np.int64)
                start = np.arange(low, high)
                row = np.searchsorted(self.end, start, "right")
                inside = start + window <= self.end[row]
                start, row, place = start[inside], row[inside], place[inside]
                new = np.ones(len(start), bool)
                new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(start)))
                parts.append((row[head], start[head], n, grams[place[head]]))
        empty = np.zeros(0, np.int64)
        columns = zip(*parts, strict=True) if parts else (empty, empty, empty, empty.astype(np.uint64))
        self.row, self.at, self.n, self.anchor = (
            np.concatenate(c) if parts else c for c in columns
        )
        self.first = self.at - self.begin[self.row]

    def content(self) -> np.ndarray:
        """A hash of the bytes of each segment."""
        with np.errstate(over="ignore"):
            out = np.zeros(len(self.at), np.uint64)
            total = len(self.letters) - self.window + 1
            for low in range(0, max(total, 0), _SLICE):
                grams = _grams(self.letters[low : low + _SLICE + self.window - 1], self.window)
                for edge in (self.at, self.at + self.n - 1):
                    here = np.flatnonzero((edge >= low) & (edge < low + _SLICE))
                    out[here] = _mixed(out[here] + grams[edge[here] - low])
            return _mixed(out + self.n.astype(np.uint64))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The single windows of some segments: row, first byte there, hash."""
        n = self.n[which]
        own = np.repeat(which, n)
        at = self.at[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        keys = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            total = len(self.letters) - self.window + 1
            for low in range(0, max(total, 0) if len(at) else 0, _SLICE):
                here = np.flatnonzero((at >= low) & (at < low + _SLICE))
                if len(here):
                    grams = _grams(self.letters[low : low + _SLICE + self.window - 1], self.window)
                    keys[here] = grams[at[here] - low]
        return self.row[own], at, keys


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _lists(values: list[np.ndarray], cuts: np.ndarray, kinds: list[pa.DataType]) -> list[pa.Array]:
    offsets = pa.array(cuts, pa.int32())
    return [
        pa.ListArray.from_arrays(offsets, pa.array(v, k))
        for v, k in zip(values, kinds, strict=True)
    ]


def _in_pieces(docs: DataFrame) -> DataFrame:
    """``docs`` dealt to pieces of bounded size, in the order they come: ``piece``, ``place``."""
    kept = [f for f in docs.schema.fields]
    schema = T.StructType(
        [T.StructField("piece", T.LongType()), T.StructField("place", T.IntegerType()), *kept]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, held, place = TaskContext.get().partitionId() << 32, 0, 0
        for batch in pieces(batches, limit=PIECE_BYTES // 4):
            size = batch.column("text").nbytes
            if held and held + size > PIECE_BYTES:
                piece, held, place = piece + 1, 0, 0
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, piece)),
                    pa.array(np.arange(place, place + n), pa.int32()),
                    *batch.columns,
                ],
                schema.fieldNames(),
            )
            held, place = held + size, place + n

    return docs.mapInArrow(work, schema)


def _anchor_lists(dealt: DataFrame, window: int, parts: int) -> DataFrame:
    """``part, piece, keys, docs, segments``: the anchors of a piece, 40 bits of each, with the
    number of documents (2 for more) and of unlike segments that have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE_BYTES):
            number = batch.column("piece").to_numpy()
            for piece in np.unique(number).tolist():
                rows = batch.filter(pa.array(number == piece))
                made = Segments(utf8_list(rows.column("text")), window)
                if not len(made.row):
                    continue
                # Of each anchor one segment per content, and whether documents differ.
                content = made.content()
                order = np.lexsort((content, made.anchor))
                anchor, content, row = made.anchor[order], content[order], made.row[order]
                new = np.append(True, anchor[1:] != anchor[:-1])
                head = np.flatnonzero(new)
                fresh = new | np.append(True, content[1:] != content[:-1])
                many = np.add.reduceat(fresh, head, dtype=np.int32)
                apart = np.minimum.reduceat(row, head) != np.maximum.reduceat(row, head)
                anchor = anchor[head]
                part = _part(anchor, parts)
                by_part = np.argsort(part, kind="stable")
                part = part[by_part]
                heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                cuts = np.append(heads, len(part))
                keys = _keys(anchor[by_part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[heads], pa.int32()),
                        pa.array(np.full(len(heads), piece)),
                        pa.array([keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        *_lists(
                            [apart[by_part] + 1, many[by_part]], cuts, [pa.int8(), pa.int32()]
                        ),
                    ],
                    ["part", "piece", "keys", "docs", "segments"],
                )

    return dealt.select("piece", "text").mapInArrow(
        work, "part int, piece bigint, keys binary, docs array<tinyint>, segments array<int>"
    )


def _part(anchor: np.ndarray, parts: int) -> np.ndarray:
    return (((anchor & np.uint64(0xFFFFFF)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def _keys(anchor: np.ndarray) -> np.ndarray:
    """40 bits of each anchor, as five bytes."""
    return (anchor >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _numbers(keys: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :5] = flat
    return wide.view("<u8")[:, 0].astype(np.int64)


def _repeated_anchors(lists: DataFrame) -> DataFrame:
    """``home, part, keys, hot``: of the anchors of a piece those that two documents have."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        keys = rows.column("keys").to_pylist()
        sizes = np.array([len(k) // 5 for k in keys])
        numbers = _numbers(keys)
        flat = [rows.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "segments")]
        distinct, own = np.unique(numbers, return_inverse=True)
        docs, many = (np.bincount(own, f, len(distinct)) for f in flat)
        code = (docs > 1).astype(np.uint8) * (1 + (many > HOT_SEGMENTS).astype(np.uint8))
        code, ends = code[own], np.cumsum(sizes)
        out: list[tuple] = []
        for i, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
            there = np.flatnonzero(code[end - size : end])
            if len(there):
                held = np.frombuffer(keys[i], np.uint8).reshape(-1, 5)[there]
                out.append((i, held.tobytes(), (code[end - size : end][there] - 1).tobytes()))
        kept, said, hot = zip(*out, strict=True) if out else ((), (), ())
        taken = rows.take(pa.array(kept, pa.int64()))
        return pa.Table.from_arrays(
            [
                taken.column("piece"), taken.column("part"),
                pa.array(said, pa.binary()), pa.array(hot, pa.binary()),
            ],
            names=["home", "part", "keys", "hot"],
        )

    return lists.groupBy("part").applyInArrow(
        work, "home bigint, part int, keys binary, hot binary"
    )


def _segments_sent(
    dealt: DataFrame, repeated: DataFrame, window: int, parts: int, shards: int
) -> DataFrame:
    """``shard, piece, text, size, segment, place, first, doc``: the segments of a piece whose
    anchors are repeated, each distinct one once, and where they occur."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def work(rows: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["shard", "piece", "text", "size", "segment", "place", "first", "doc"]
        types = [pa.int32(), pa.int64(), pa.binary(), *(pa.list_(k) for k in (pa.int32(), *kinds))]
        if not rows.num_rows or not marks.num_rows:
            return pa.schema(list(zip(names, types, strict=True))).empty_table()
        rows = rows.combine_chunks()
        made = Segments(utf8_list(rows.column("text").combine_chunks()), window)
        part = _part(made.anchor, parts)
        keys = (made.anchor >> np.uint64(24)).astype(np.int64)
        code = np.zeros(len(keys), np.int8)
        by_part = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by_part], np.arange(parts + 1)) if parts < len(part) else None
        for where, said, hot in zip(
            *(marks.column(c).to_pylist() for c in ("part", "keys", "hot")), strict=True
        ):
            mine = by_part[cuts[where] : cuts[where + 1]] if cuts is not None else (
                np.flatnonzero(part == where)
            )
            numbers = _numbers([said])
            order = np.argsort(numbers)
            at = order[np.minimum(np.searchsorted(numbers[order], keys[mine]), len(order) - 1)]
            met = numbers[at] == keys[mine]
            code[mine[met]] = 1 + np.frombuffer(hot, np.uint8)[at[met]]
        plain = np.flatnonzero(code == 1)
        w_row, w_at, w_key = made.windows(np.flatnonzero(code == 2))
        row = np.concatenate([made.row[plain], w_row])
        at = np.concatenate([made.at[plain], w_at])
        size = np.concatenate([made.n[plain] + window - 1, np.full(len(w_at), window)])
        key = np.concatenate([made.anchor[plain], w_key])
        with np.errstate(over="ignore"):
            shard = (_mixed(key + np.uint64(7)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        row, at, size, shard = row[order], at[order], size[order], shard[order]
        heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else shard
        ends = np.append(heads[1:], len(shard))
        places = rows.column("place").to_numpy()
        docs = rows.column("doc").to_numpy()
        letters, pack = made.letters.tobytes(), zstandard.ZstdCompressor(level=1)
        texts, sizes, size_cuts, own = [], [], [0], np.zeros(len(row), np.int64)
        for low, high in zip(heads.tolist(), ends.tolist(), strict=True):
            seen: dict[bytes, int] = {}
            for i, (a, n) in enumerate(zip(at[low:high].tolist(), size[low:high].tolist(), strict=True)):
                own[low + i] = seen.setdefault(letters[a : a + n], len(seen))
            texts.append(pack.compress(b"".join(seen)))
            sizes += map(len, seen)
            size_cuts.append(len(sizes))
        first = at - made.begin[row]
        return pa.Table.from_arrays(
            [
                pa.array(shard[heads], types[0]),
                pa.array(np.full(len(heads), rows.column("piece")[0].as_py()), types[1]),
                pa.array(texts, types[2]),
                *_lists([np.array(sizes, np.int64)], np.array(size_cuts), [pa.int32()]),
                *_lists([own, places[row], first, docs[row]], np.append(heads, len(row)), kinds),
            ],
            names=names,
        )

    return (
        dealt.select("piece", "place", "doc", "text").groupBy("piece")
        .cogroup(repeated.groupBy("home"))
        .applyInArrow(
            work,
            "shard int, piece bigint, text binary, size array<int>, segment array<int>, "
            "place array<int>, first array<int>, doc array<bigint>",
        )
    )


def _sharing(texts: list[bytes], window: int) -> np.ndarray:
    """The texts with a window whose hash occurs at another place of theirs."""
    letters = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    # Windows that start in the last bytes of a text are none.
    whole = np.ones(max(len(letters) - window + 1, 0), bool)
    at = np.maximum(end - window + 1, end - size)
    edge = np.zeros(len(letters) + 1, np.int8)
    np.add.at(edge, at, 1)
    np.add.at(edge, end, -1)
    whole &= (np.cumsum(edge, dtype=np.int8) == 0)[: len(whole)]
    with np.errstate(over="ignore"):
        hashes = [
            _grams(letters[low : low + _SLICE + window - 1], window)[whole[low : low + _SLICE]]
            for low in range(0, len(whole), _SLICE)
        ]
    if not hashes:
        return np.zeros(0, np.int64)
    keys = np.concatenate(hashes)
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    place = np.flatnonzero(whole)[order[np.union1d(same, same + 1)]]
    return np.unique(np.searchsorted(end, place, "right"))


def earliest(texts: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the joined texts (a separator after each) the least of ``docs`` among the
    texts that hold the window starting there; and where each text starts."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    n = np.maximum(size - window + 1, 0)
    least = np.full(int((size + 1).sum()), _NEVER)
    least[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(docs, n)
    some = _sharing(texts, window)
    if len(some):
        found, _ = _sorted_earliest([texts[i] for i in some.tolist()], docs[some], window)
        many = size[some] + 1
        least[np.repeat(begin[some] - np.cumsum(many) + many, many) + np.arange(len(found))] = found
    return least, begin


def _sorted_earliest(
    texts: list[bytes], docs: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """As ``earliest``, by sorting all suffixes."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    # Letters from 1, so that the separator is like none of them.
    letters = np.zeros(int((size + 1).sum()), np.uint16)
    inside = np.ones(len(letters), bool)
    inside[begin + size] = False
    letters[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    order = suffix_array(letters, 257).astype(np.int64)
    shared = permuted_common_prefixes(letters, order)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    left = (begin + size)[owner] - np.arange(len(letters))
    order = order[left[order] >= window]
    # What lies between two whole windows in order has the same bytes before any separator.
    head = np.flatnonzero(np.append(True, shared[order[1:]] < window)) if len(order) else order
    least = np.full(len(letters), _NEVER)
    if len(order):
        low = np.minimum.reduceat(docs[owner[order]], head)
        least[order] = np.repeat(low, np.diff(np.append(head, len(order))))
    return least, begin


def _spans(sent: DataFrame, window: int) -> DataFrame:
    """``home, place, first, n``: stretches of bytes of a piece's texts to remove."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = {c: rows.column(c).combine_chunks() for c in ("size", "segment", "place", "first", "doc")}
        sizes, ends = lists["size"].to_pylist(), np.cumsum(lists["segment"].value_lengths().to_numpy(zero_copy_only=False))
        segment, place, first, doc = (
            lists[c].flatten().to_numpy() for c in ("segment", "place", "first", "doc")
        )
        # One text of all pieces' equal ones.
        unpack = zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        whole = np.zeros(len(segment), np.int64)
        for i, (packed, lengths) in enumerate(zip(rows.column("text").to_pylist(), sizes, strict=True)):
            text, at = unpack.decompress(packed), 0
            numbers = np.zeros(len(lengths), np.int64)
            for j, n in enumerate(lengths):
                numbers[j] = known.setdefault(text[at : at + n], len(known))
                at += n
            low = ends[i - 1] if i else 0
            whole[low : ends[i]] = numbers[segment[low : ends[i]]]
        texts = list(known)
        docs = np.full(len(texts), _NEVER)
        np.minimum.at(docs, whole, doc)
        least, begin = earliest(texts, docs, window)
        n = np.array([len(t) for t in texts])[whole] - window + 1
        piece = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
        found: list[list[np.ndarray]] = []
        step = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + 1, 1 << 20))
        for low, high in zip(step.tolist(), [*step[1:].tolist(), len(n)], strict=True):
            if low == high:
                continue
            own = np.repeat(np.arange(low, high), n[low:high])
            skip = np.arange(len(own)) - np.repeat(np.cumsum(n[low:high]) - n[low:high], n[low:high])
            gone = least[begin[whole[own]] + skip] < doc[own]
            own, skip = own[gone], skip[gone]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (skip[1:] != skip[:-1] + 1)
            head = np.flatnonzero(new)
            run = np.diff(np.append(head, len(own)))
            found.append([piece[own[head]], place[own[head]], first[own[head]] + skip[head], run + window - 1])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        heads = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1])) if len(columns[0]) else columns[0]
        return pa.Table.from_arrays(
            [
                rows.column("piece").take(pa.array(columns[0][heads])),
                *_lists(columns[1:], np.append(heads, len(columns[0])), [pa.int32()] * 3),
            ],
            names=["home", "place", "first", "n"],
        )

    return sent.groupBy("shard").applyInArrow(
        work, "home bigint, place array<int>, first array<int>, n array<int>"
    )


def _without(text: bytes, first: np.ndarray, n: np.ndarray) -> tuple[bytes, int, int]:
    """A text without some stretches: what is left, bytes removed, runs of removed bytes."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n, -1)
    gone = np.cumsum(edge)[:-1] > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    runs = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
    return kept, int(gone.sum()), int(runs)


def remove_earlier(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept, n_bytes, n_removed, n_spans`` in place of ``text``.

    Removed is every byte covered by ``window`` bytes of the text that also start in a document
    with a smaller ``doc_id``, judged on the input. ``kept`` are the other bytes, joined; they
    need not be whole characters. ``n_spans`` counts the maximal removed runs.

    A null text is empty; a shorter text than a window stays whole. A null id is larger than all
    others, and rows of equal ids, repeated ones too, remove nothing from each other. An empty
    table gives an empty one. Other columns are passed on; columns of ``docs`` that are called as
    the new ones are replaced.
    """
    spark = docs.sparkSession
    ready(spark)
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    rest = [c for c in docs.columns if c not in (*new, "text")]
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NEVER)).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(*rest).alias("rest"),
    )
    # The result is read from ``scratch``, which stays; ``lists`` goes.
    scratch, lists = Scratch(spark), Scratch(spark)
    try:
        dealt = scratch.save(_in_pieces(keyed), compression="zstd")
        total = dealt.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = int(total // PART_BYTES) + 1
        # A segment repeats the bytes that it shares with the next, some four times over.
        shards = int(4 * total // SHARD_BYTES) + 1
        repeated = lists.save(_repeated_anchors(_anchor_lists(dealt, window, parts)))
        sent = _segments_sent(dealt, repeated, window, parts, shards)
        spans = scratch.save(_spans(sent, window))
        rows = dealt.select("piece", "place", "rest", "text")

        def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
            rows, found = rows.combine_chunks(), found.combine_chunks()
            place, first, n = (
                np.concatenate([
                    np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in found.column(name).chunks)
                ]).astype(np.int64)
                for name in ("place", "first", "n")
            )
            order = np.argsort(place, kind="stable")
            place, first, n = place[order], first[order], n[order]
            own = rows.column("place").to_numpy()
            low, high = np.searchsorted(place, own), np.searchsorted(place, own, "right")
            texts = utf8_list(rows.column("text").combine_chunks())
            done = [
                _without(t, first[a:b], n[a:b]) if b > a else (t, 0, 0)
                for t, a, b in zip(texts, low.tolist(), high.tolist(), strict=True)
            ]
            kept, removed, runs = zip(*done, strict=True) if done else ((), (), ())
            return pa.Table.from_arrays(
                [
                    rows.column("rest"), pa.array(kept, pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                ],
                names=["rest", *new],
            )

        fields = [rows.schema["rest"], T.StructField("kept", T.BinaryType())]
        fields += [T.StructField(c, T.LongType()) for c in new[1:]]
        out = rows.groupBy("piece").cogroup(spans.groupBy("home")).applyInArrow(
            cut, T.StructType(fields)
        )
        return out.select(*(F.col("rest")[c].alias(c) for c in rest), *new)
    except BaseException:
        scratch.drop()
        raise
    finally:
        lists.drop()
