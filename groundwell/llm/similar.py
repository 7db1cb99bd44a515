"""Near duplicates by word shingles: SimHash fingerprints at a wide radius, verified exactly.

Two texts are linked if the sets of their shingles of ``WIDTH`` words have a Jaccard similarity
of ``SIMILARITY`` or more. At that similarity fingerprints differ in ten bits or so of 64, which
no choice of untouched segments can propose. Candidates are texts with equal least shingle
hashes instead; their pairs drop out by the difference of their pivot distances, by their
distance, and by their sizes, and what is left is compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwell.llm.common import free_name, pieces, ready, saved, utf8_list, words_of
from groundwell.llm.graph import connected_components
from groundwell.llm.simhash import PIVOTS, _root, _shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
#: Texts meet where the least shingle hashes of both permutations of one band are equal. A pair
#: of similarity 0.8 agrees in no band once in 200,000 times.
BANDS = 12
MINIMA = 2
#: At similarity 0.8 fingerprints differ in 10 bits on average, in 12 for the shortest texts,
#: with a deviation of 3; more than this many are some four and a half deviations off.
RADIUS = 26
#: Texts of one candidate group that meet in one task, and their shingles; larger groups are cut.
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000

_SEEDS = np.random.default_rng(22).integers(0, 1 << 63, (2, BANDS * MINIMA), dtype=np.uint64)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a UTF-8 text, A-Z in lower case.

    Fewer words than ``width`` are one shingle; no words are one as well, equal to itself.
    """
    words = words_of(text.lower())
    return np.unique(np.array(_shingle_hashes(words, width) or [0], np.uint64))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each set, and a 32-bit digest per set and band."""
    counts = np.array([len(s) for s in sets])
    starts = np.cumsum(counts) - counts
    hashes = np.concatenate(sets)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    prints = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for i, (flip, factor) in enumerate(zip(*_SEEDS, strict=True)):
            mixed = (hashes ^ flip) * (factor * np.uint64(2) + np.uint64(1))
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            least = np.minimum.reduceat(mixed, starts)
            band = bands[:, i // MINIMA]
            bands[:, i // MINIMA] = (band ^ (band >> np.uint64(31)) ^ least) * np.uint64(
                0xD6E8FEB86659FD93
            )
    return prints[:, 0], (bands >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """``id, fp, n, bands`` for each row of ``docs`` (``id, text``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sets = [shingle_set(t, width) for t in utf8_list(piece.column("text"))]
            prints, bands = sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    pa.array(prints.view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(list(bands), pa.list_(pa.int32())),
                ],
                ["id", "fp", "n", "bands"],
            )

    return docs.mapInArrow(work, "id string, fp bigint, n bigint, bands array<int>")


class _Group:
    """Rows of one group: which pairs may be similar, as far as sketches can tell."""

    def __init__(self, rows: dict[str, np.ndarray], similarity: float) -> None:
        self.prints = rows["fp"].view(np.uint64)
        self.table = np.bitwise_count(self.prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)
        self.sizes, self.side = rows["n"], rows["side"]
        self.bands = np.stack(list(rows["bands"]))
        self.band, self.similarity = int(rows["band"][0]), similarity

    def meets(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions of the pairs that are left: of unlike sides, and not met in an earlier band."""
        at = np.flatnonzero((self.side[i] == 2) | (self.side[i] != self.side[j]))
        for pivot in range(self.table.shape[1]):
            apart = np.abs(self.table[i[at], pivot] - self.table[j[at], pivot])
            at = at[apart <= RADIUS]
        at = at[np.bitwise_count(self.prints[i[at]] ^ self.prints[j[at]]) <= RADIUS]
        small = np.minimum(self.sizes[i[at]], self.sizes[j[at]])
        large = np.maximum(self.sizes[i[at]], self.sizes[j[at]])
        at = at[small >= self.similarity * large]
        earlier = self.bands[i[at], : self.band] == self.bands[j[at], : self.band]
        return at[~earlier.any(axis=1)]


def _by_group(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The rows of each group, as slices; groups are runs of equal ``band, digest, lo, hi``."""
    name, held = None, []
    for batch in batches:
        keys = np.stack(
            [
                batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("band", "digest", "lo", "hi")
            ]
        )
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if end == start:
                continue
            own = tuple(keys[:, start].tolist())
            if held and own != name:
                yield name, held
                held = []
            name = own
            held.append(batch.slice(start, end - start))
    if held:
        yield name, held


def _columns(slices: list[pa.RecordBatch], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    whole = pa.Table.from_batches(slices)
    return {c: whole.column(c).to_numpy() for c in names}


_SKETCH = ("fp", "n", "bands", "side", "band")
_PLACE = "band int, digest int, lo int, hi int, side int, id string"


def _dealt(rows: DataFrame) -> DataFrame:
    """A row per text, band and pair of blocks of the band's group."""
    entries = rows.select("id", "fp", "n", "bands", F.posexplode("bands").alias("band", "digest"))
    group = entries.groupBy("band", "digest").agg(
        F.count("*").alias("texts"), F.sum("n").alias("shingles")
    )
    blocks = F.greatest(
        F.ceil(F.col("texts") / F.lit(BLOCK)), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES))
    ).cast("int")
    shared = group.where("texts > 1").select("band", "digest", blocks.alias("n_blocks"))
    cut = F.col("n_blocks")
    return (
        entries.join(shared, ["band", "digest"])
        .withColumn("home", F.pmod(F.xxhash64("id"), cut).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
        .select(
            "band", "digest",
            F.least("home", "other").alias("lo"),
            F.greatest("home", "other").alias("hi"),
            F.when(F.col("home") == F.col("other"), 2)
            .otherwise((F.col("home") > F.col("other")).cast("int"))
            .alias("side"),
            "id", "fp", "n", "bands",
        )
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "digest", "lo", "hi").sortWithinPartitions(
        "band", "digest", "lo", "hi", "id"
    )


def _promising(rows: DataFrame, similarity: float) -> DataFrame:
    """The places of texts that a text of the same group may be similar to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in _by_group(batches):
            total = sum(s.num_rows for s in slices)
            if total < 2:
                continue
            group = _Group(_columns(slices, _SKETCH), similarity)
            marked, every = np.zeros(total, bool), np.arange(total)
            for step in range(1, total):
                i = every[: total - step]
                i = i[~(marked[i] & marked[i + step])]
                i = i[group.meets(i, i + step)]
                marked[i] = marked[i + step] = True
                if marked.all():
                    break
            if marked.any():
                kept = pa.Table.from_batches(slices).filter(pa.array(marked))
                yield from kept.select(["band", "digest", "lo", "hi", "side", "id"]).combine_chunks().to_batches()

    return _grouped(_dealt(rows)).mapInArrow(work, _PLACE)


def _verified(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """``a, b``: similar texts of each group, as a spanning forest of the group's links."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in _by_group(batches):
            total = sum(s.num_rows for s in slices)
            group = _Group(_columns(slices, _SKETCH), similarity)
            sets = [
                set(shingle_set(t, width).tolist())
                for s in slices
                for t in utf8_list(s.column("text"))
            ]
            ids = pa.Table.from_batches(slices).column("id").to_pylist()
            parent, every, left, right = np.arange(total), np.arange(total), [], []
            for step in range(1, total):
                i = every[: total - step]
                i = i[parent[i] != parent[i + step]]
                for a in i[group.meets(i, i + step)].tolist():
                    x, y = _root(parent, a), _root(parent, a + step)
                    if x == y:
                        continue
                    both = len(sets[a] & sets[a + step])
                    if both >= similarity * (len(sets[a]) + len(sets[a + step]) - both):
                        parent[max(x, y)] = min(x, y)
                        left.append(ids[a])
                        right.append(ids[a + step])
                while not np.array_equal(parent, up := parent[parent]):
                    parent = up
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    return _grouped(rows).mapInArrow(work, "a string, b string")


def _text_id(text: Column | str) -> Column:
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def similar_texts(
    docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY
) -> DataFrame:
    """``id, least, root`` for each distinct text of ``docs`` (``doc_id, text``).

    ``id`` is the MD5 of the text (null: empty), ``least`` the struct ``(no_id, doc_id)`` of its
    smallest document id, null last, ``root`` the smallest id of a text that can be reached over
    links. Exact copies are folded before anything is compared, texts without words are all
    equal, repeated rows count once, and an empty table gives an empty one.

    A text meets others of one band in blocks, and a pair is compared in its first common band
    only. A task gives up no more links than it has texts. Texts without a promising partner
    do not travel.
    """
    spark = docs.sparkSession
    ready(spark)
    own = docs.select(
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id").alias("doc"),
        _text_id("text").alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    least = own.groupBy("id").agg(F.min("doc").alias("least"))
    rows = saved(_sketched(own.select("id", "text"), width).dropDuplicates(["id"]))
    places = saved(_promising(rows, similarity))
    needed = places.select("id").distinct().join(least, "id")
    texts = (
        own.join(needed, (own["id"] == needed["id"]) & own["doc"].eqNullSafe(needed["least"]), "left_semi")
        .select("id", "text")
        .dropDuplicates(["id"])
    )
    met = places.join(rows, "id").join(texts, "id")
    links = _verified(met, width, similarity).distinct()
    roots = connected_components(links).withColumnRenamed("node", "id")
    return least.join(roots, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))


def drop_similar(
    docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY
) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of ``similar_texts`` does.

    It is the one with the smallest id (null last), then the smallest MD5 of the text; of
    repeated rows one stays. All columns are kept, whatever their names.
    """
    found = saved(similar_texts(docs.select("doc_id", "text"), width, similarity))
    mark, kept, text, copy = (
        free_name(docs, n) for n in ("__mark", "__kept", "__kept_text", "__copy")
    )
    stay = (
        found.groupBy("root")
        .agg(F.min(F.struct("least", "id")).alias("first"))
        .select(F.col("first.least.doc_id").alias(kept), F.col("first.id").alias(text))
    )
    own = docs.withColumn(mark, _text_id("text"))
    met = own.join(stay, own["doc_id"].eqNullSafe(stay[kept]) & (own[mark] == stay[text]), "left_semi")
    same = Window.partitionBy("doc_id", mark).orderBy(F.col("text").isNull())
    return (
        met.withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1).select(*docs.columns)
    )
