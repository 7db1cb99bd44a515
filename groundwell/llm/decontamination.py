"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are lower-cased runs of letters and digits. A mask looks at some of ``SPAN`` consecutive
words and ignores the others; the hashes of the words it looks at are joined between benchmark
and documents. Around each hit the aligned words are compared: a stretch of ``STRETCH`` words
with ``MATCHES`` or more equal ones is an overlap, whatever words were substituted in between.

The documents are not shuffled: places whose first two looked-at words occur so in no item drop out
at once, and seeds have a fixed width and carry the item's words around them as hashes, so that
hits are verified where they are found. A benchmark of up to ``BROADCAST_SEEDS`` seeds is sent to
the tasks whole. The keys of a larger one are cut by their hash in parts of about ``PART_KEYS``,
and the documents are scanned once for each part; what hits a key goes on with the words around it,
a row of fixed width, and meets the seeds of that key in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import free_name, saved

#: Words of a seed, and the places in it that each mask looks at, the first two of them first.
#: A covering set: whichever two words of a span are substituted, one mask at least is left
#: untouched, and whichever three of a stretch, one mask at one of its places in the stretch.
SPAN = 11
MASKS = (
    (1, 2, 0, 3, 7, 9),
    (1, 2, 0, 6, 8, 9),
    (1, 2, 3, 4, 5, 8),
    (1, 2, 4, 6, 7, 10),
    (4, 9, 0, 3, 5, 6),
    (4, 9, 0, 7, 8, 10),
    (7, 8, 3, 5, 6, 10),
)
STRETCH = 15
MATCHES = 12
#: The words of an item around a seed that can share a stretch with it.
_SIDE = STRETCH - SPAN
#: So many words of a short item may be missing at the edge of a document.
_EDGE = 2
_PAIRS = tuple(sorted({mask[:2] for mask in MASKS}))
_AROUND = SPAN + 2 * _SIDE
#: A seed row has a fixed width of about 200 bytes, so that this many fit a broadcast.
BROADCAST_SEEDS = 200_000
#: Keys, of 8 bytes, that are sent to the tasks for one scan of the documents.
PART_KEYS = 1_000_000


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(cut, lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(normal_words(text), lambda w: F.xxhash64(w))


def _padded(hashes: Column, by: int = _SIDE) -> Column:
    """The hashes with nulls at both ends, as far as a stretch can reach beyond a seed."""
    nulls = F.array_repeat(F.lit(None).cast("long"), by)
    return F.concat(nulls, hashes, nulls)


def _positions(padded: Column) -> Column:
    """Every start of a seed, from 0; none in a text shorter than one."""
    last = F.size(padded) - 2 * _SIDE - SPAN
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _pair_keys(padded: Column, at: Column) -> Column:
    """Hashes of the first two words that a mask looks at, one for each such pair of places."""
    word = lambda place: F.get(padded, at + (_SIDE + place))
    return F.array(*(F.xxhash64(F.lit(b), word(a), word(b)) for a, b in _PAIRS))


def _mask_keys(around: Column, pair: Column) -> Column:
    """For each mask that starts with pair number ``pair`` the hash of the words it looks at."""
    looked = F.array(
        *(
            F.struct(
                F.lit(number).alias("mask"),
                F.lit(_PAIRS.index(mask[:2])).alias("pair"),
                F.array(*(F.lit(_SIDE + place) for place in mask)).alias("places"),
            )
            for number, mask in enumerate(MASKS)
        )
    )
    return F.transform(
        F.filter(looked, lambda m: m["pair"] == pair),
        lambda m: F.xxhash64(m["mask"], F.transform(m["places"], lambda i: F.get(around, i))),
    )


def _spots(texts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``*, size, pair, around`` for every place and pair of a table with ``words`` (hashes).

    With ``pairs`` only places are kept whose pair is among them; what runs for every place
    of the corpus is then two hashes and one look-up.
    """
    rest = [c for c in texts.columns if c != "words"]
    spots = (
        texts.select(*rest, _padded(F.col("words")).alias("words"))
        .select(*rest, "words", F.explode(_positions(F.col("words"))).alias("at"))
        .select(
            *rest, "words", "at",
            F.posexplode(_pair_keys(F.col("words"), F.col("at"))).alias("pair", "pair_key"),
        )
    )
    if pairs is not None:
        spots = spots.join(pairs, "pair_key", "left_semi")
    around = F.slice("words", F.col("at") + 1, F.lit(_AROUND))
    # The generator keeps the words themselves out of what follows.
    return spots.select(
        *rest,
        (F.size("words") - 2 * _SIDE).alias("n_words"),
        "pair",
        "pair_key",
        F.explode(F.array(around)).alias("around"),
    )


def seeds(benchmark: DataFrame) -> DataFrame:
    """``key, pair_key, item_id, size, item``: a row per mask and place of each distinct item.

    ``item`` holds the hashes of the item's words from ``STRETCH - SPAN`` before the seed to
    as many after it, null beyond its ends. Items of equal words count as the one with the
    smallest id; items of less than ``SPAN`` words, or null, have no seeds.
    """
    items = (
        benchmark.select("item_id", _hashes(F.col("text")).alias("words"))
        .groupBy("words")
        .agg(F.min("item_id").alias("item_id"))
    )
    return (
        _spots(items)
        .select(
            F.explode(_mask_keys(F.col("around"), F.col("pair"))).alias("key"),
            "pair_key",
            "item_id",
            F.col("n_words").alias("size"),
            F.col("around").alias("item"),
        )
        .distinct()
    )


def _most(item: Column, around: Column, size: Column) -> Column:
    """The most agreements in a stretch that holds the seed and lies in the item."""
    equal = F.zip_with(
        item, around, lambda i, d: F.when(i.isNotNull(), i.eqNullSafe(d).cast("int"))
    )
    plus = lambda total, x: total + x  # noqa: E731  null where the stretch leaves the item
    stretches = [
        F.aggregate(F.slice(equal, start + 1, STRETCH), F.lit(0), plus)
        for start in range(_SIDE + 1)
    ]
    short = F.aggregate(equal, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))
    return F.when(size < STRETCH, short).otherwise(F.greatest(*stretches))


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, item_id, matched``: documents that overlap an item, by ``keys`` of ``docs``.

    ``matched`` is the largest number of agreeing words in a stretch of ``STRETCH`` words, or
    in the whole item where that is shorter (at least four fifths of it then). Null and short
    texts overlap nothing; repeated rows and repeated items give one row; null keys are keys.
    Empty tables give an empty result.
    """
    found = saved(seeds(benchmark))
    n_seeds = found.count()
    texts = docs.select(
        *(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)),
        _padded(_hashes(F.col("text")), _EDGE).alias("words"),
    )
    if n_seeds <= BROADCAST_SEEDS:
        met = _keyed_spots(texts, found).join(F.broadcast(found.drop("pair_key")), "key")
    else:
        hits = [saved(part) for part in hits_by_part(texts, found, n_seeds)]
        every = hits[0]
        for part in hits[1:]:
            every = every.unionByName(part)
        met = every.join(found.drop("pair_key").hint("merge"), "key")
    least = F.ceil(F.least("size", F.lit(STRETCH)) * F.lit(MATCHES) / F.lit(STRETCH))
    return (
        met.withColumn("matched", _most(F.col("item"), F.col("around"), F.col("size")))
        .where(F.col("matched") >= least)
        .groupBy(*(f"key_{i}" for i in range(len(keys))), "item_id")
        .agg(F.max("matched").alias("matched"))
        .select(*(F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)), "item_id", "matched")
    )


def _keyed_spots(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Places whose pair of words is one of ``seeds``, with the ``key`` of each of their masks."""
    pairs = F.broadcast(seeds.select("pair_key").distinct())
    return _spots(texts, pairs).withColumn(
        "key", F.explode(_mask_keys(F.col("around"), F.col("pair")))
    )


def hits_by_part(texts: DataFrame, seeds: DataFrame, n_seeds: int) -> list[DataFrame]:
    """For each part of the keys of ``seeds`` a scan of ``texts``: places that hit one of them,
    with the words around. A part holds some ``PART_KEYS`` of ``n_seeds`` keys, and no more pairs
    than keys, whatever the number of items and their lengths."""
    parts = -(-n_seeds // PART_KEYS)
    hits = []
    for part in range(parts):
        own = seeds.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        keys = F.broadcast(own.select("key").distinct())
        hits.append(
            _keyed_spots(texts, own)
            .join(keys, "key", "left_semi")
            .select(*(c for c in texts.columns if c != "words"), "key", "around")
        )
    return hits


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, matched`` for each document and each item that it overlaps."""
    return overlaps(docs, benchmark, ["doc_id"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item, with all their columns.

    Rows are told apart by id and text, so that a clean row stays where its id, null included,
    also stands on a contaminated text.
    """
    text = F.xxhash64("text")
    mark, bad_id, bad_text = (free_name(docs, n) for n in ("__text", "__bad", "__bad_text"))
    marked = docs.select("doc_id", "text", text.alias(mark))
    bad = overlaps(marked, benchmark, ["doc_id", mark]).select(
        F.col("doc_id").alias(bad_id), F.col(mark).alias(bad_text)
    )
    own = docs.withColumn(mark, text)
    return own.join(
        bad.distinct(),
        (own[mark] == bad[bad_text]) & own["doc_id"].eqNullSafe(bad[bad_id]),
        "left_anti",
    ).drop(mark)
