"""Suffix arrays and the removal of earlier byte strings against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from groundwell.llm import bytespans, suffixes


def strings(seed=1):
    rng = random.Random(seed)
    for turn in range(400):
        n, kinds = rng.choice([0, 1, 2, 3, 5, 10, 40, 200]), rng.choice([1, 2, 3, 10])
        s = [rng.randrange(kinds) for _ in range(n)]
        yield (s[:7] * 60)[:n] if turn % 5 == 0 else s, kinds
    yield [0] * 900, 1
    yield [1, 0] * 400, 2


@pytest.mark.parametrize("short", [1, 20, 1 << 17])
def test_suffix_arrays(monkeypatch, short):
    monkeypatch.setattr(suffixes, "SHORT", short)
    for s, kinds in strings(short):
        text = np.array(s, np.int32)
        order = suffixes.suffix_array(text, kinds)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = suffixes.permuted_common_prefixes(text, order.astype(np.int64))
        for a, b in zip(order.tolist(), order[1:].tolist(), strict=False):
            same = 0
            while max(a, b) + same < len(s) and s[a + same] == s[b + same]:
                same += 1
            assert shared[b] == same


def expected(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    ids = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for doc, text in zip(ids, texts, strict=True):
        for i in range(len(text) - window + 1):
            w = text[i : i + window]
            least[w] = min(least.get(w, doc), doc)
    out = []
    for (doc, _), own, text in zip(rows, ids, texts, strict=True):
        gone = [False] * len(text)
        for i in range(len(text) - window + 1):
            if least[text[i : i + window]] < own:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, kept, len(text), sum(gone), spans))
    return Counter(out)


def corpus(seed, window):
    rng = random.Random(seed)
    words = ["the", "of", "é", "über", "x", "ab", "aab", "\n", "中"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 30, 120]))) for _ in range(50)]
    passage = " ".join(rng.choices(words, k=60))
    for i in range(0, 50, 2):
        at = rng.randrange(len(texts[i]) + 1)
        cut = rng.randrange(5)
        length = rng.choice([window - 1, window, window + 1, 3 * window])
        texts[i] = texts[i][:at] + passage[cut : cut + length] + texts[i][at:]
    texts += [texts[3], texts[4] + "!", "?" + texts[5], None, "", "a" * 200, "a" * 90 + "b" + "a" * 90]
    texts += ["ab" * 80, "b" + "ab" * 70, " ".join(rng.choices(words, k=2500)), "é" * window]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return [*rows, (None, passage), (None, passage), (rows[2][0], rows[2][1]), (rows[0][0], passage), (-5, passage[3:])]


@pytest.mark.parametrize(
    ("window", "piece", "hot", "shard"),
    [(50, 1 << 22, 20_000, 1 << 22), (50, 400, 2, 2000), (12, 600, 3, 500), (50, 400, 0, 1000)],
)
def test_earlier_strings_match_brute_force(spark, monkeypatch, window, piece, hot, shard):
    monkeypatch.setattr(bytespans, "PIECE_BYTES", piece)
    monkeypatch.setattr(bytespans, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(bytespans, "SHARD_BYTES", shard)
    monkeypatch.setattr(bytespans, "PART_BYTES", 4 * piece)
    monkeypatch.setattr(suffixes, "SHORT", 64)
    monkeypatch.setattr(bytespans, "_SLICE", 700)
    rows = corpus(window + hot, window)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "'p' as piece", "'q' as place", "1 as kept", "2 as doc", "3 as home"
    )
    found = bytespans.remove_earlier(docs, window)
    assert found.columns == ["doc_id", "piece", "place", "doc", "home", "kept", "n_bytes", "n_removed", "n_spans"]
    mine = Counter(
        (r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in found.collect()
    )
    want = expected(rows, window)
    assert mine == want
    assert sum(r[3] > 0 for r in want) > 20


def test_earlier_strings_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bytespans.remove_earlier(empty).count() == 0
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [bytes(r.kept) for r in bytespans.remove_earlier(rows).collect()] == [b"", b""]


def test_earliest_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        window, kinds = rng.choice([1, 3, 5, 50]), rng.choice([b"ab\x00\xff", bytes(range(97, 123))])
        sizes = [0, 1, window - 1, window, window + 1, 20, 80]
        made = [bytes(rng.choices(kinds, k=rng.choice(sizes))) for _ in range(rng.randrange(1, 12))]
        texts = list(dict.fromkeys([*made, made[0][:60] + b"zz" + made[0][10:]]))
        docs = [rng.randrange(9) for _ in texts]
        least: dict[bytes, int] = {}
        for text, doc in zip(texts, docs, strict=True):
            for i in range(len(text) - window + 1):
                own = text[i : i + window]
                least[own] = min(least.get(own, doc), doc)
        expected = [
            least.get(text[i : i + window], bytespans._NEVER)
            if i + window <= len(text) else bytespans._NEVER
            for text in texts for i in range(len(text) + 1)
        ]
        assert bytespans.earliest(texts, np.array(docs), window)[0].tolist() == expected


def test_segments_equal_to_nothing_are_not_sorted(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choices(range(256), k=200)) for _ in range(50)]
    texts.append(texts[7][20:90] + b"end")
    sorted_, sort = [], bytespans.suffix_array
    monkeypatch.setattr(
        bytespans, "suffix_array", lambda s, k: sorted_.append(len(s)) or sort(s, k)
    )
    least, begin = bytespans.earliest(texts, np.arange(51)[::-1].copy(), 50)
    assert sorted_ == [len(texts[7]) + len(texts[50]) + 2]
    at = begin[7] + 20
    assert least[at : at + 21].tolist() == [0] * 21 and least[at - 1] == least[at + 21] == 43
