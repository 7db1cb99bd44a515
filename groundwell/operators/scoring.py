"""Block scoring inside tasks: many queries against many vectors as one matrix product.

These helpers see one bounded block at a time; Spark decides which blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores are compared at this many decimals, so that equal vectors tie in every block shape
# and ties are then broken by id. Stored vectors are 32-bit and carry about 7 digits.
SCORE_DECIMALS = 9

# Bounds the score matrix of one step to about 32 MB.
_STEP_CELLS = 4_000_000

# Rows that the first best of a query are taken from; the others have to reach the last of these.
_FIRST_ROWS = 1024


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an ``ARRAY<FLOAT>`` column as a matrix of unit rows (zero rows stay zero)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = set(pc.unique(pc.list_value_length(column)).to_pylist())
    if column.null_count or len(widths) > 1:
        raise ValueError("vectors of one search must be non-null and of one width")
    width = widths.pop() if widths else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), width)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length != 0)


def as_values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as a sortable array: numbers stay numbers, text becomes objects."""
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else (
        column.to_numpy()
    )


def place_in_group(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values of a sorted array."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else groups
    sizes = np.diff(np.r_[starts, len(groups)])
    return np.arange(len(groups)) - np.repeat(starts, sizes)


def keep_best(
    query: np.ndarray, ids: np.ndarray, score: np.ndarray, top_k: np.ndarray
) -> np.ndarray:
    """Positions of the ``top_k[query]`` best rows of each query, by score and then id."""
    id_rank = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((id_rank, -score, query))
    ranked = query[order]
    return order[place_in_group(ranked) < top_k[ranked]]


def block_candidates(
    queries: np.ndarray, top_k: np.ndarray, vectors: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best rows of a block for each query: ``(query position, row position, score)``.

    ``vectors`` must be in id order: of rows with equal scores the first ones are kept, and
    copies of one vector, however many, are passed over without sorting them. A score that is
    not a number ranks last.
    """
    n = len(vectors)
    step = max(1, _STEP_CELLS // max(1, n))
    for start in range(0, len(queries), step):
        score = np.round(queries[start:start + step] @ vectors.T, SCORE_DECIMALS)
        score += 0.0  # no negative zero
        score[np.isnan(score)] = -np.inf
        wanted = top_k[start:start + step]
        k = min(int(wanted.max()), n)
        floor = np.partition(score, n - k, axis=1)[:, n - k, None]
        query, row = np.nonzero(score > floor)
        open_places = k - np.bincount(query, minlength=len(score))
        tied_query, tied_row = np.nonzero(score == floor)
        first = place_in_group(tied_query) < open_places[tied_query]
        query = np.r_[query, tied_query[first]]
        row = np.r_[row, tied_row[first]]
        value = score[query, row]
        best = keep_best(query, row, value, wanted)
        yield query[best] + start, row[best], value[best]


def _few_true(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the true values of a mask that holds few; eight are looked at at once."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)
    some = np.r_[some.ravel(), np.arange(whole, len(flat))]
    return some[flat[some]]


class Shortlist:
    """Running top-k of a fixed set of queries over any number of blocks.

    Once a query has ``top_k`` rows, the last of them is its floor: what follows is scored in
    single precision, and only rows that can reach the floor are scored again, exactly. ``floor``
    are scores known beforehand that rows must reach. Memory is that of the ``top_k`` places.
    """

    def __init__(self, top_k: np.ndarray, floor: np.ndarray | None = None) -> None:
        self._top_k = np.asarray(top_k)
        self._first = np.cumsum(np.r_[0, self._top_k])[:-1]
        self._held = np.zeros(len(self._top_k), dtype=np.int64)
        self._least = np.full(len(self._top_k), -np.inf)
        if floor is not None:
            self._least = np.where(np.isnan(floor), -np.inf, floor)
        self._score = np.full(int(self._top_k.sum()), -np.inf)
        self._ids: np.ndarray | None = None

    def add(
        self, queries: np.ndarray, positions: np.ndarray, ids: np.ndarray, vectors: np.ndarray
    ) -> None:
        """Score one block for the queries whose numbers are ``positions``."""
        if not len(positions) or not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        start, size = 0, max(_FIRST_ROWS, int(self._top_k[positions].max()))
        while start < len(ids):
            opened = np.isneginf(self._least[positions])
            if not opened.any():
                size = len(ids)
            piece = slice(start, start + size)
            self._all(queries, positions, np.flatnonzero(opened), ids[piece], vectors[piece])
            self._reaching(queries, positions, np.flatnonzero(~opened), ids[piece], vectors[piece])
            start, size = start + size, 4 * size

    def _all(
        self, queries: np.ndarray, positions: np.ndarray, members: np.ndarray, ids: np.ndarray,
        vectors: np.ndarray,
    ) -> None:
        if not len(members):
            return
        at = positions[members]
        for query, row, score in block_candidates(queries[members], self._top_k[at], vectors):
            self._merge(at[query], ids[row], score)

    def _reaching(
        self, queries: np.ndarray, positions: np.ndarray, members: np.ndarray, ids: np.ndarray,
        vectors: np.ndarray,
    ) -> None:
        n, width = vectors.shape
        # A bound of the rounding of a product of two unit rows in single precision, and of scores.
        slack = (width + 8) * 2.0**-23 + 10.0**-SCORE_DECIMALS
        single = vectors.astype(np.float32)
        step = max(1, _STEP_CELLS // max(1, n))
        for start in range(0, len(members), step):
            some = members[start:start + step]
            floor = self._least[positions[some]]
            near = queries[some].astype(np.float32) @ single.T
            reach = near >= np.nextafter((floor - slack).astype(np.float32), -np.inf)[:, None]
            query, row = np.divmod(_few_true(reach), n)
            # Of a query that many rows reach, as copies of one vector do, all are ranked at once.
            many = np.bincount(query, minlength=len(some)) > 64 + 16 * self._top_k[positions[some]]
            if many.any():
                self._all(queries, positions, some[many], ids, vectors)
                query, row = query[~many[query]], row[~many[query]]
            pairs = max(1, _STEP_CELLS // (2 * max(1, width)))
            for begin in range(0, len(query), pairs):
                q, r = query[begin:begin + pairs], row[begin:begin + pairs]
                score = np.einsum("ij,ij->i", queries[some[q]], vectors[r])
                score = np.round(score, SCORE_DECIMALS) + 0.0
                good = score >= floor[q]
                self._merge(positions[some[q[good]]], ids[r[good]], score[good])

    def _merge(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take candidates into the places of their queries."""
        if not len(query):
            return
        if self._ids is None:
            self._ids = np.zeros(len(self._score), dtype=ids.dtype)
        elif self._ids.dtype != ids.dtype:
            self._ids = self._ids.astype(np.promote_types(self._ids.dtype, ids.dtype))
        touched = np.unique(query)
        mine = np.repeat(touched, self._held[touched])
        slot = self._first[mine] + place_in_group(mine)
        query = np.r_[mine, query]
        ids, score = np.r_[self._ids[slot], ids], np.r_[self._score[slot], score]
        best = keep_best(query, ids, score, self._top_k)
        query = query[best]
        slot = self._first[query] + place_in_group(query)
        self._ids[slot], self._score[slot] = ids[best], score[best]
        self._held[touched] = np.bincount(query, minlength=len(self._held))[touched]
        full = touched[self._held[touched] == self._top_k[touched]]
        last = self._score[self._first[full] + self._top_k[full] - 1]
        self._least[full] = np.maximum(self._least[full], last)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if self._ids is None:
            return None
        query = np.repeat(np.arange(len(self._held)), self._held)
        slot = self._first[query] + place_in_group(query)
        score = self._score[slot]
        return query, self._ids[slot], np.where(np.isneginf(score), np.nan, score)
