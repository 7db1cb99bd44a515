"""SimHash components, substring removal and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from groundwell.llm import decontamination, graph, simhash, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "Of", "and,", "été", "x"] * 30
    passage = rng.choices(vocabulary, k=50)
    texts = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 40, 120, 300]))
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[: rng.choice([34, 35, 36, 50])]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(words))
    texts += [texts[4], texts[5] + " more", "", None, " \n", " a　b c", "ab " * 90]
    texts.append(" ".join(rng.choices(vocabulary, k=6000)))
    return list(enumerate(texts))


def docs_of(spark, rows, extra=True):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        return frame.selectExpr("*", "'a' as root", "'b' as t", "'c' as kept_text", "1 as rest")
    return frame


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    many = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    shingles = many if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rows = corpus()
    prints = {i: fingerprint(t) for i, t in rows}
    expected = components(prints)
    found = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints
    assert all(len(r.fingerprint) == 16 for r in found)
    assert {r.doc_id: r.component_id for r in found} == expected


@pytest.mark.parametrize("block", [4, 4096])
def test_simhash_links_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for value in base * 12:
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            value ^= 1 << rng.randrange(64)
        prints.add(value)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fingerprint bigint"))
    found = {r.node: r.root for r in graph.connected_components(links).collect()}
    groups = components({p: p for p in prints})
    mine = {}
    for p in prints:
        node = int(np.uint64(p).astype(np.int64))
        mine.setdefault(found.get(node, node), set()).add(p)
    theirs = {}
    for p, root in groups.items():
        theirs.setdefault(root, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"),
            (7, "q r s t u v"), (7, "z y x w v"), (None, None)]
    kept = simhash.drop_near_duplicates(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "root", "t", "kept_text", "rest"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, "a b c d e"), (7, "q r s t u v"), (7, "z y x w v"), (None, None)]
    )


def test_simhash_of_nothing(spark):
    empty = docs_of(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.root for r in found.collect()} == {
        **{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}
    }


def without_repeats(rows, window):
    words = [WORDS.findall(t or "") for _, t in rows]
    starts = Counter(
        tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1)
    )
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, kept, len(w), sum(gone)))
    return Counter(out)


@pytest.mark.parametrize("window", [5, 35])
def test_repeats_match_brute_force(spark, window):
    rows = corpus(seed=window)
    rows += [(None, rows[9][1]), (2, rows[2][1]), (2, rows[2][1]), (2, rows[60][1])]
    found = substrings.remove_repeats(docs_of(spark, rows), window)
    assert found.columns == ["doc_id", "root", "t", "rest", "kept_text", "n_words", "n_removed"]
    mine = Counter((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in found.collect())
    assert mine == without_repeats(rows, window)


def test_repeats_leave_untouched_texts(spark):
    rows = [(1, "a  b\nc"), (2, None)]
    found = substrings.remove_repeats(docs_of(spark, rows), respaced=False).collect()
    assert {(r.doc_id, r.kept_text) for r in found} == {(1, "a  b\nc"), (2, "")}
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def overlaps(doc, item):
    best = 0
    for i in range(len(item) - 10):
        for p in range(len(doc) - 10):
            if not any(
                all(doc[p + m] == item[i + m] for m in mask) for mask in decontamination.MASKS
            ):
                continue
            same = lambda j: p + j >= 0 and p + j < len(doc) and doc[p + j] == item[i + j]  # noqa: B023, E731
            if len(item) < 15:
                best = max(best, sum(same(j) for j in range(-i, len(item) - i)))
            else:
                for o in range(-4, 1):
                    if i + o >= 0 and i + o + 15 <= len(item):
                        best = max(best, sum(same(o + j) for j in range(15)))
    return best


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
    items = [(i, rng.choices(vocabulary, k=k)) for i, k in enumerate([60, 30, 15, 14, 12, 11, 10, 3, 0])]
    rows = []
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.choice([5, 40, 150]))
        _, item = items[i % len(items)]
        cut = item[rng.choice([0, 0, 3]) :][: rng.choice([12, 15, 18, 60])]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            if cut:
                cut[rng.randrange(len(cut))] = "other"
        at = rng.randrange(len(words))
        words[at:at] = cut
        rows.append((i, rng.choice([" ", ", "]).join(words).upper() if i % 5 == 0 else " ".join(words)))
    rows += [(500, None), (501, ""), (0, rows[0][1])]
    bench = [(i, " ".join(w)) for i, w in items] + [(90, " ".join(items[1][1])), (91, None)]
    expected = {}
    for doc, text in rows:
        for i, item in items:
            best = overlaps(tokens(text), item)
            if item and best >= -(-min(len(item), 15) * 12 // 15):
                expected[doc, i] = best
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    docs = docs_of(spark, rows)
    found = decontamination.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in found} == expected
    assert len(found) == len(expected) > 20
    bad = {d for d, _ in expected}
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in bad)
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), benchmark).count() == 0


def most_agreeing(doc, item):
    """The most agreements of a stretch at any alignment, without masks."""
    length = min(len(item), 15)
    return max(
        sum(0 <= i + shift + j < len(doc) and doc[i + shift + j] == item[i + j] for j in range(length))
        for shift in range(1 - len(item), len(doc))
        for i in range(len(item) - length + 1)
    )


def test_decontamination_finds_every_pattern_of_substitutions(spark):
    items, rows, expected = [], [], {}
    for number, size in enumerate([11, 12, 13, 14, 15, 19]):
        item = [f"i{number}w{j}" for j in range(size)]
        items.append((number, " ".join(item)))
        stretch = min(size, 15)
        changes = stretch - -(-stretch * 12 // 15)
        texts = []
        for places in combinations(range(stretch), changes):
            texts.append(["before"] + [f"x{j}" if j in places else w for j, w in enumerate(item[:stretch])])
        texts += [[*w, "after"] for w in texts]
        texts += [item[k:] + ["after"] * 9 for k in range(5)] + [["x"] * 9 + item[: size - k] for k in range(5)]
        texts += [["x", *item[:3], "x", "x", "x", "x", *item[7:]]]
        for words in texts:
            best = most_agreeing(words, item)
            if best >= stretch - changes:
                expected[len(rows), number] = best
            rows.append((len(rows), " ".join(words)))
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = decontamination.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in found} == expected
    assert len(rows) > len(expected) > 1500


def large_benchmark(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)] + ["the", "of"] * 40
    items = [rng.choices(vocabulary, k=rng.choice([11, 14, 40])) for _ in range(120)]
    texts = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([5, 60, 200]))
        at = rng.randrange(len(words))
        cut = list(items[i][: rng.choice([11, 15, 30])])
        if i % 3 == 0:
            cut[rng.randrange(len(cut))] = "other"
        words[at:at] = cut
        texts.append(" ".join(words))
    docs = docs_of(spark, list(enumerate(texts)))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    return docs, spark.createDataFrame(bench, "item_id bigint, text string")


def test_decontamination_by_a_benchmark_in_parts(spark, monkeypatch):
    docs, benchmark = large_benchmark(spark)
    whole = Counter(map(tuple, decontamination.contaminated(docs, benchmark).collect()))
    assert len(whole) >= 40
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontamination, "PART_KEYS", 4000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontamination.contaminated(docs, benchmark)
        assert Counter(map(tuple, found.collect())) == whole
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 0
        seeds = decontamination.seeds(benchmark)
        texts = docs.select(F.col("doc_id").alias("key_0"), decontamination._hashes(F.col("text")).alias("words"))
        parts = decontamination.hits_by_part(texts, seeds, seeds.count())
        assert len(parts) > 2
        for part in parts:
            plan = part._jdf.queryExecution().executedPlan().toString()
            # Only keys of the benchmark are sent; no document leaves its task.
            assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_clashing_columns_stay(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "'x' as __text", "'y' as __I", "1 as __t", "2 as __copy", "3 as __bad", "4 as __bad_text"
    )
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r["__text"], r["__copy"]) for r in kept.collect()} == {(1, "x", 2), (3, "x", 2)}
    benchmark = spark.createDataFrame([(1, "a b c d e " * 4)], "item_id bigint, text string")
    clean = decontamination.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert {(r.doc_id, r["__text"], r["__bad"]) for r in clean.collect()} == {(i, "x", 3) for i in (1, 2, 3)}


def test_decontamination_is_native(spark):
    docs = docs_of(spark, [(1, "a b")])
    benchmark = spark.createDataFrame([(1, "x " * 20)], "item_id bigint, text string")
    plan = decontamination.contaminated(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_kept_text_digest_is_of_the_kept_words(spark):
    rows = [(1, "a b c d e f g"), (2, "x a b c d e f y")]
    found = substrings.remove_repeats(docs_of(spark, rows), 5).collect()
    texts = {r.doc_id: r.kept_text for r in found}
    assert texts == {1: "g", 2: "x y"}
    assert hashlib.sha256(texts[2].encode()).hexdigest()
