"""The stages of the pipeline, each on what the one before kept, against brute force."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import pytest
from test_llm_dedup import overlaps, tokens, without_repeats
from test_llm_formats import check_packing
from test_llm_similar import kept_ids

import corpus_pipeline
from groundwell.llm import decontamination, packing, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if name == "toxicity":
            clean = toxicity.toxicity(before, labels).where("predicted = 0")
            assert ids(docs) == ids(clean)
        if name == "simhash":
            assert ids(docs) == kept_ids([(r.doc_id, r.text) for r in before.collect()])
        if name == "substrings":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            expected = {doc: (text, gone) for doc, text, _, gone in without_repeats(rows, 35)}
            texts = dict(rows)
            for r in docs.collect():
                text, gone = expected[r.doc_id]
                assert r.text == (text if gone else texts[r.doc_id]) and r.n_chars == len(r.text)
        if name == "decontamination":
            assert ids(docs) == sorted(set(ids(before)) - contaminated(before, benchmark))
    left = {r.doc_id: len((r.text or "").split()) for r in kept["decontamination"].collect()}
    placed, count = [r for r in docs.collect() if r["size"]], defaultdict(int)
    for r in placed:
        count[r.doc_id] += r["size"]
    assert {d: n for d, n in left.items() if n} == count and set(ids(docs)) == set(left)
    check_packing(
        [r["size"] for r in placed], [r.bin_id for r in placed], [r.offset for r in placed],
        [r.capacity for r in placed], packing.LENGTHS,
    )


def contaminated(docs, benchmark):
    """Documents with a stretch of an item; items are found by their seeds, pair by pair."""
    items = {r.item_id: tokens(r.text) for r in benchmark.collect()}
    seeds = defaultdict(set)
    for item, words in items.items():
        for i in range(len(words) - decontamination.SPAN + 1):
            for mask in decontamination.MASKS:
                seeds[mask, tuple(words[i + m] for m in mask)].add(item)
    bad = set()
    for r in docs.collect():
        words = tokens(r.text)
        met = {
            item
            for p in range(len(words) - decontamination.SPAN + 1)
            for mask in decontamination.MASKS
            for item in seeds.get((mask, tuple(words[p + m] for m in mask)), ())
        }
        for item in met:
            best = overlaps(words, items[item])
            if best >= -(-min(len(items[item]), 15) * 12 // 15):
                bad.add(r.doc_id)
    return bad


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
