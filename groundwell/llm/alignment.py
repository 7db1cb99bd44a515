"""Alignment of two tokenizers over the same texts by coalescing byte intervals.

Every token covers a range of the bytes of a space and the text. The ranges of both tokenizers
are sorted by start with one ``lexsort``, their ends are accumulated by maximum, and a group
breaks where a start reaches the largest end so far. The overlaps inside the groups are the
links between token occurrences.

Neither tokenizer joins a space to a character before it other than white space. So texts are cut
there, and a worker tokenizes each distinct segment once while it remembers it; a vocabulary of
which this is not known gets whole texts. The id pairs that a chunk of documents holds are numbered inside
the chunk; Spark counts the pairs of all chunks, joins the counts back to (chunk, number), and
each chunk's documents meet their own counts in one group of bounded size. Nothing that grows
with the corpus is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.llm.common import Scratch, pieces, ready, saved

#: Where the vocabulary files of the two tokenizers are; every executor reads them there.
VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are tokenized at once, and that make up a chunk.
TOKENIZED_BYTES = 1 << 20
CHUNK_BYTES = 1 << 22
#: Bytes of distinct segments whose tokens a worker keeps, and of those encoded as one string.
KNOWN_BYTES = 1 << 22
_STRING_BYTES = 1 << 13

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1
    characters for themselves, the other bytes, in order, for the code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Codec:
    """A tokenizer of texts after a space, and the bytes of each of its ids.

    ``parted`` tells that no token has a space after a character other than white space, and
    that texts may be cut there.
    """

    def __init__(self, encode, entries: list[bytes], parted: bool = False) -> None:
        self.encode = encode
        self.entries = entries
        self.parted = parted
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._held = 0
        self._ids = self._many = np.zeros(0, np.int64)
        self._spelt = np.zeros(0, bool)

    def _keep(self, segments: list[bytes], ids: np.ndarray, many: np.ndarray, spelt: bool) -> None:
        self._known.update(zip(segments, range(len(self._known), len(self._known) + len(segments))))
        self._held += sum(map(len, segments))
        self._ids = np.concatenate([self._ids, ids])
        self._many = np.concatenate([self._many, many])
        self._spelt = np.append(self._spelt, np.full(len(segments), spelt))

    def _learn(self, strings: list[list[bytes]]) -> list[list[bytes]]:
        """Encode strings of segments; returned are those that their tokens do not spell."""
        whole = [b"".join(string) for string in strings]
        found = self.encode([text.decode() for text in whole])
        right = [
            b"".join(map(self.entries.__getitem__, ids)) == text
            for ids, text in zip(found, whole, strict=True)
        ]
        ids = np.array(list(chain.from_iterable(compress(found, right))), np.int64)
        segments = list(chain.from_iterable(compress(strings, right)))
        ends = np.cumsum([len(s) for s in segments], dtype=np.int64)
        tokens = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right")
        self._keep(segments, ids, np.diff(tokens, prepend=0), True)
        return [string for string, ok in zip(strings, right, strict=True) if not ok]

    def tokens(
        self, segments: list[bytes], parted: bool
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``ids``, and of each of some distinct segments the place and number of its own there,
        and whether they spell it."""
        fresh = [s for s in segments if s not in self._known]
        if self._held and self._held + sum(map(len, fresh)) > KNOWN_BYTES:
            self._forget()
            fresh = segments
        if fresh:
            wrong = self._learn(_strings(fresh) if parted else [[s] for s in fresh])
            wrong = self._learn([[s] for string in wrong for s in string])
            none = np.zeros(len(wrong), np.int64)
            self._keep([s for (s,) in wrong], none[:0], none, False)
        own = np.fromiter(map(self._known.__getitem__, segments), np.int64, len(segments))
        places = (np.cumsum(self._many) - self._many)[own]
        return self._ids, places, self._many[own], self._spelt[own]


@lru_cache(maxsize=4)
def byte_level(path: str) -> _Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are plain text
    alphabet = _byte_alphabet()
    entries = [b""] * tokenizer.get_vocab_size()
    for token, number in tokenizer.get_vocab().items():
        if all(c in alphabet for c in token):
            entries[number] = bytes(alphabet[c] for c in token)

    def encode(spaced: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]

    return _Codec(encode, entries, _splits_by_words(json.loads(tokenizer.to_str())))


def _splits_by_words(told: dict) -> bool:
    """Whether a byte-level tokenizer splits texts by the common pattern, in which white space
    comes first in a word, and does nothing else to them."""
    split = told["pre_tokenizer"] or {}
    return (
        told["normalizer"] is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split["add_prefix_space"]
        and all(t["special"] for t in told["added_tokens"])
    )


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> _Codec:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [
        b"" if model.IsControl(i) or model.IsUnknown(i)
        else bytes([int(model.IdToPiece(i)[3:5], 16)]) if model.IsByte(i)
        else model.IdToPiece(i).replace("▁", " ").encode()
        for i in range(model.GetPieceSize())
    ]
    # The model puts the first space there itself.
    return _Codec(
        lambda spaced: model.encode([text[1:] for text in spaced], num_threads=1),
        entries,
        _keeps_words(model.serialized_model_proto()),
    )


def _keeps_words(serialized: bytes) -> bool:
    """Whether a model merges pairs, takes texts as they are and has no piece in which a space
    follows anything but spaces."""
    from sentencepiece import sentencepiece_model_pb2

    told = sentencepiece_model_pb2.ModelProto.FromString(serialized)
    rules = told.normalizer_spec
    return (
        told.trainer_spec.model_type == told.trainer_spec.BPE
        and not told.trainer_spec.treat_whitespace_as_suffix
        and not rules.precompiled_charsmap
        and rules.add_dummy_prefix
        and rules.escape_whitespaces
        and not rules.remove_extra_whitespaces
        and not any("▁" in p.piece.lstrip("▁") for p in told.pieces)
    )


@dataclass
class Aligned:
    """The tokens of some texts, their groups and links.

    ``a`` and ``b`` are ids, ``a_text`` and ``b_text`` the place of their text, ``a_group`` and
    ``b_group`` the group of each token, counted over all texts, ``group_text`` the text of each
    group, ``group_end`` its last byte offset over all texts, ``link_a`` and ``link_b`` the token
    places of each link, A tokens in order.
    """

    texts: int
    a: np.ndarray
    b: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_text: np.ndarray
    group_end: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def per_text(self) -> list[np.ndarray]:
        """Tokens of A and of B, groups and links of each text."""
        owners = (self.a_text, self.b_text, self.group_text, self.a_text[self.link_a])
        return [np.bincount(owner, minlength=self.texts) for owner in owners]


def _closes(last: np.ndarray, further: np.ndarray) -> np.ndarray:
    """Whether a character is other than white space, by its last byte and the one before.

    Some characters beyond ASCII that share bytes with white space count as such.
    """
    ascii_ = (last > 0x20) & (last < 0x7F)
    return ascii_ | ((last > 0x7F) & ~np.isin(further, (0xC2, 0x80, 0x81, 0x9A, 0xA0)))


def _segments(spaced: list[bytes], parted: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct segments of some texts, which of them each text has in order, and where in
    that row each text begins.

    A cut is before a space that follows another character than white space in its text and does
    not end it.
    """
    letters = np.frombuffer(b"".join(spaced), np.uint8)
    ends = np.cumsum([len(t) for t in spaced], dtype=np.int64)
    cut = np.zeros(len(letters) + 1, bool)
    if parted:
        cut[2:-1] = (letters[2:] == 0x20) & _closes(letters[1:-1], letters[:-2])
        cut[ends - 1] = False
    cut[ends] = True
    cut[0] = True
    at = np.flatnonzero(cut)
    offsets, data = pa.array(at, pa.int64()), pa.py_buffer(letters)
    every = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at) - 1, [None, offsets.buffers()[1], data]
    ).dictionary_encode()
    starts = np.searchsorted(at, np.append(0, ends[:-1]))
    return every.dictionary.to_pylist(), every.indices.to_numpy(), starts


def _strings(segments: list[bytes]) -> list[list[bytes]]:
    """Segments put together to strings that may be cut between them."""
    size = np.array([len(s) for s in segments])
    last, further = (np.array([s[i] for s in segments], np.uint8) for i in (-1, -2))
    stop = ~_closes(last, further)
    number = np.cumsum(size) // _STRING_BYTES
    new = np.flatnonzero((number[1:] != number[:-1]) | stop[:-1]) + 1
    cuts = [0, *new.tolist(), len(segments)]
    return [segments[low:high] for low, high in zip(cuts, cuts[1:])]


def _taken(ids: np.ndarray, places: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Stretches of ``ids``, one after the other."""
    ends = np.cumsum(many)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(places - ends + many, many)]


def coalesce(
    a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Group of each interval of A and of B, and where each group ends."""
    starts, ends = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    kind = np.repeat(np.array([0, 1], np.int8), [len(a_start), len(b_start)])
    order = np.lexsort((kind, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    last = np.append(np.flatnonzero(breaks)[1:], len(order)) - 1 if len(order) else order
    return group[: len(a_start)], group[len(a_start) :], reach[last]


def align_texts(texts: list[str | None], first: _Codec, second: _Codec) -> Aligned:
    """The alignment of each text. Texts that one of the two does not spell have no tokens."""
    asked = np.array([i for i, text in enumerate(texts) if text], np.int64)
    a = b = a_text = b_text = np.zeros(0, np.int64)
    if len(asked):
        parted = first.parted and second.parted
        segments, own, starts = _segments([b" " + texts[i].encode() for i in asked.tolist()], parted)
        sides = [codec.tokens(segments, parted) for codec in (first, second)]
        rows = np.repeat(np.arange(len(asked)), np.diff(np.append(starts, len(own))))
        spelt = (sides[0][3] & sides[1][3])[own]
        kept = np.logical_and.reduceat(spelt, starts)[rows]
        own, rows = own[kept], asked[rows[kept]]
        (a, a_text), (b, b_text) = (
            (_taken(ids, places[own], many[own]), np.repeat(rows, many[own]))
            for ids, places, many, _ in sides
        )
    a_end, b_end = np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])
    a_start, b_start = a_end - first.sizes[a], b_end - second.sizes[b]
    a_group, b_group, group_end = coalesce(a_start, a_end, b_start, b_end)
    group_text = np.zeros(len(group_end), np.int64)
    group_text[a_group] = a_text
    # The B tokens that overlap an A token are consecutive, and of its group.
    low = np.searchsorted(b_end, a_start, "right")
    many = np.searchsorted(b_start, a_end, "left") - low
    link_a = np.repeat(np.arange(len(a)), many)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many - low, many)
    return Aligned(
        len(texts), a, b, a_text, b_text, a_group, b_group, group_text, group_end, link_a, link_b
    )


@lru_cache(maxsize=4)
def _decimals_below(top: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each number below ``top`` and a comma, after zero bytes, and how
    many bytes that are."""
    written = [b"%d," % i for i in range(top)]
    size = max(map(len, written))
    cells = np.frombuffer(b"".join(w.rjust(size, b"\0") for w in written), np.uint8)
    return cells.reshape(-1, size), np.array([len(w) for w in written])


def _decimals(largest: int) -> tuple[np.ndarray, np.ndarray]:
    return _decimals_below(1 << max(16, largest.bit_length()))


def group_digests(found: Aligned) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text, "" for one without tokens."""
    ids = np.concatenate([found.a, found.b])
    key = np.concatenate([2 * found.a_group, 2 * found.b_group + 1])
    order = np.argsort(key, kind="stable")
    ids, key = ids[order], key[order]
    text = np.concatenate([found.a_text, found.b_text])[order]
    digits, width = _decimals(int(ids.max()) if len(ids) else 0)
    cells = digits[ids]
    last = np.ones(len(ids), bool)
    last[:-1] = key[1:] != key[:-1]
    cells[last, -1] = np.where(key[last] % 2 == 0, ord("|"), ord(";"))
    sizes = np.bincount(text, width[ids], found.texts).astype(np.int64)
    written = cells[cells != 0].tobytes()
    ends = np.cumsum(sizes)
    return [
        hashlib.sha256(written[end - size : end - 1]).hexdigest() if size else ""
        for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)
    ]


def _texts(column: pa.Array) -> list[str | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [
        None if x is None else x.decode("utf-8", "replace") for x in column.cast(kind).to_pylist()
    ]


def alignments(
    docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B
) -> DataFrame:
    """``doc_id, groups``: the groups of each text in order, as ``(end, a, b)``.

    ``end`` is the byte offset in space and text at which tokens of both end, ``a`` and ``b``
    the ids inside. A text that is null, empty or not spelt by its tokens has no groups.
    """
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_level(path_a), sentence_pieces(path_b)
        for piece in pieces(batches, limit=TOKENIZED_BYTES):
            found = align_texts(_texts(piece.column("text")), first, second)
            n = np.bincount(found.group_text, minlength=found.texts)
            before = np.append(0, found.group_end)[np.cumsum(n) - n]
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(np.bincount(g, minlength=n.sum()))), pa.int32()),
                    pa.array(ids, pa.int32()),
                )
                for ids, g in ((found.a, found.a_group), (found.b, found.b_group))
            ]
            end = pa.array(found.group_end - before[found.group_text], pa.int64())
            groups = pa.StructArray.from_arrays([end, *lists], ["end", "a", "b"])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), groups),
                ],
                ["doc_id", "groups"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, groups array<struct<end bigint, a array<int>, b array<int>>>"
    )


def _chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents, and one row per chunk with the id pairs that its documents hold.

    ``slots`` are the numbers in the chunk of a document's distinct pairs, ``times`` how many of
    its links each has.
    """
    fields = [
        T.StructField("chunk", T.LongType()),
        docs.schema["doc_id"],
        *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("slots", T.ArrayType(T.IntegerType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
        *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("pair_a", "pair_b", "pair_n")),
    ]
    schema = T.StructType(fields)

    def chunk_rows(held: list[tuple[pa.Array, Aligned]], number: int) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(
            [(x.a[x.link_a] << 32) | x.b[x.link_b] for _, x in held]
        )
        pairs, slot = np.unique(keys, return_inverse=True)
        sizes = np.cumsum([0, *(x.texts for _, x in held)])
        row = np.concatenate(
            [x.a_text[x.link_a] + at for (_, x), at in zip(held, sizes[:-1], strict=True)]
        )
        own, times = np.unique(row * max(len(pairs), 1) + slot, return_counts=True)
        owner = own // max(len(pairs), 1)
        cuts = pa.array(np.searchsorted(owner, np.arange(sizes[-1] + 1)), pa.int32())
        lists = [
            pa.ListArray.from_arrays(cuts, pa.array(v, pa.int32()))
            for v in (own % max(len(pairs), 1), times)
        ]
        n = int(sizes[-1])
        figures = zip(*(x.per_text() for _, x in held), strict=True)
        ids = pa.concat_arrays([i for i, _ in held])
        none = pa.nulls(n, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, number)),
                ids,
                *(pa.array(np.concatenate(f), pa.int64()) for f in figures),
                pa.array([d for _, x in held for d in group_digests(x)], pa.string()),
                *lists,
                none, none, none,
            ],
            schema.fieldNames(),
        )
        if len(pairs):
            counts = np.bincount(slot, minlength=len(pairs))
            values = (pairs >> 32, pairs & 0xFFFFFFFF, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.nulls(1, ids.type),
                    *(pa.nulls(1, pa.int64()) for _ in _COUNTS),
                    pa.nulls(1, pa.string()),
                    pa.nulls(1, pa.list_(pa.int32())),
                    pa.nulls(1, pa.list_(pa.int32())),
                    *(pa.array([v.astype(np.int32)], pa.list_(pa.int32())) for v in values),
                ],
                schema.fieldNames(),
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, second = byte_level(path_a), sentence_pieces(path_b)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, Aligned]] = []
        size = 0
        for piece in pieces(batches, limit=TOKENIZED_BYTES):
            texts = _texts(piece.column("text"))
            held.append((piece.column("doc_id"), align_texts(texts, first, second)))
            size += sum(len(t) for t in texts if t)
            if size >= CHUNK_BYTES:
                yield from chunk_rows(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield from chunk_rows(held, number)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def link_scores(
    docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of
    ``docs`` (``doc_id, text``).

    The count of an id pair is how many links of all rows hold it. ``n_best`` are the links whose
    count is the highest of their B id, ties included, ``count_sum`` the sum of counts over the
    links. A text that is null, empty or not spelt by the tokens of either has zeros and the
    digest "". Repeated rows are rows of their own and count as such; ``doc_id`` may be null; an
    empty table gives an empty one. Other columns are left out.
    """
    ready(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    try:
        found = scratch.save(_chunks(docs, path_a, path_b), compression="zstd")
        pairs = found.where("pair_n is not null").select(
            F.col("chunk").alias("home"),
            F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("slot", "p"),
        ).select("home", "slot", "p.*")
        counts = saved(
            pairs.groupBy("pair_a", "pair_b").agg(F.sum(F.col("pair_n").cast("long")).alias("n"))
        )
        # At most one row for each id of the second vocabulary.
        best = F.broadcast(counts.groupBy("pair_b").agg(F.max("n").alias("most")))
        known = counts.join(best, "pair_b").select(
            "pair_a", "pair_b", "n", (F.col("n") == F.col("most")).alias("best")
        )
        scored = pairs.select("home", "slot", "pair_a", "pair_b").join(known, ["pair_a", "pair_b"])
        left = found.where("pair_n is null").drop("pair_a", "pair_b", "pair_n")
        names = [c for c in left.columns if c not in ("chunk", "slots", "times")]
        fields = [left.schema[c] for c in names]
        fields += [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]

        def weigh(rows: pa.Table, right: pa.Table) -> pa.Table:
            slots, times = (rows.column(c).combine_chunks() for c in ("slots", "times"))
            at = right.column("slot").to_numpy()
            n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
            own, each = slots.flatten().to_numpy(), times.flatten().to_numpy()
            ends = np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.append(0, ends[:-1])
            sums = []
            for value in (best, n):
                run = np.append(0, np.cumsum(value[own] * each))
                sums.append(pa.array(run[ends] - run[starts], pa.int64()))
            return pa.Table.from_arrays([*(rows.column(c) for c in names), *sums],
                                        names=[*names, "n_best", "count_sum"])

        out = left.groupBy("chunk").cogroup(
            scored.select("home", "slot", "n", "best").groupBy("home")
        ).applyInArrow(weigh, T.StructType(fields))
        return saved(
            out.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
        )
    finally:
        scratch.drop()
