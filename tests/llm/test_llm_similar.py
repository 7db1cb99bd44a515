"""Near duplicates by five-word shingles, against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import re
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from groundwell.llm import similar

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def shingles(text, width=5):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) <= width:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def kept_ids(rows, similarity=0.8, width=5):
    """The smallest id of each component of rows (id, text), ids being distinct."""
    sets = {doc: shingles(text, width) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for doc, own in sets.items():
        for s in own:
            by_shingle.setdefault(s, []).append(doc)
    pairs = {pair for docs in by_shingle.values() for pair in combinations(docs, 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= similarity * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted({find(doc) for doc in sets})


def edited(words, rng, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_edited_copies_at_all_similarities(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for family in range(40):
        base = rng.choices(vocabulary, k=rng.choice([4, 6, 12, 40, 150, 400]))
        if family % 3 == 0:
            base += passage
        for copy in range(6):
            words = base if copy < 2 else edited(base, rng, rng.choice([0.005, 0.02, 0.04, 0.06]))
            text = " ".join(words)
            rows.append((len(rows), text.upper() if copy == 1 else text))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(r.doc_id for r in similar.drop_similar(docs).collect())
    assert got == kept_ids(rows)


def test_chains_hot_groups_and_ties(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 50)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(100):  # a chain: each text is near the one before, the ends share nothing
        rows.append((i, " ".join(words)))
        words = words[1:] + [f"x{i}"]
    hot = [f"h{i}" for i in range(200)]
    rows += [(1000 + i, " ".join(edited(hot, rng, 0.005))) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sorted(r.doc_id for r in similar.drop_similar(docs).collect())
    assert got == kept_ids(rows) == [0, 1000]


def test_odd_rows(spark):
    schema = "doc_id long, text string, __mark int, __KEPT string, id string, n int, root int"
    text = "a b c d e f g h"
    rows = [
        (None, text, 1, "x", "i", 1, 2),
        (7, text, 2, None, None, None, None),
        (7, text, 2, None, None, None, None),
        (7, "quite another text with more words", 3, "y", "j", 3, 4),
        (None, None, 4, "z", "k", 5, 6),
        (9, "long " + "word " * 200_000, 5, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    out = similar.drop_similar(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = sorted((r.doc_id is None, r.doc_id or 0, r["__mark"]) for r in out.collect())
    assert kept == [(False, 7, 2), (False, 7, 3), (False, 9, 5), (True, 0, 4)]
    assert similar.drop_similar(docs.where("false")).count() == 0
    assert similar.similar_texts(docs.select("doc_id", "text")).count() == 4


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = sorted(r.doc_id for r in similar.drop_similar(docs).select("doc_id").collect())
    assert got == kept_ids([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert docs.select(F.countDistinct("doc_id")).first()[0] > len(got)
