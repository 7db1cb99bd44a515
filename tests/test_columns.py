from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.functions import ids, payload, prompts, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text_map(**entries):
    parts = [F.lit(x) for pair in entries.items() for x in pair]
    return F.create_map(*parts).cast("map<string,string>")


@pytest.mark.parametrize("name", ["doc:0", "", "ü:12", "a" * 500])
def test_uuid5_equals_the_standard_library(spark, name):
    assert value(spark, ids.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_chunk_ids_in_one_row_equal_single_ids(spark):
    rows = spark.range(6).select(
        ids.chunk_ids(F.lit("doc"), F.col("id").cast("int")).alias("many")
    ).collect()
    single = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"doc:{i}")) for i in range(6)]
    assert [r.many for r in rows] == [single[:n] for n in range(6)]


def test_path_document_id(spark):
    path = "/data/a b.txt"
    assert value(spark, ids.path_document_id(F.lit(path))) == (
        hashlib.sha1(path.encode()).hexdigest()[:16]
    )


def test_document_id_default_is_stable_and_fills_null_and_empty(spark):
    frame = spark.createDataFrame(
        [(1, "given", "t"), (2, None, "t"), (3, "", "t"), (4, None, "t")],
        "key INT, document_id STRING, text STRING",
    )

    def run(*seed):
        made = ids.document_id_or_default(F.col("document_id"), *seed)
        return [r.x for r in frame.orderBy("key").select(made.alias("x")).collect()]

    keyed = run(F.col("key"), F.col("text"))
    assert keyed == run(F.col("key"), F.col("text"))
    assert keyed[0] == "given" and len(set(keyed)) == 4 and all(len(k) == 32 for k in keyed[1:])
    by_text = run(F.col("text"))
    assert by_text[1] == by_text[2] == by_text[3]


def test_request_metadata_wins_over_base_keys(spark):
    merged = payload.request_payload(
        F.lit("d"), F.lit(3), F.lit("text"), text_map(document_id="other", lang="en")
    )
    assert value(spark, merged) == {
        "chunk_text": "text", "chunk_index": "3", "document_id": "other", "lang": "en",
    }


def test_file_payload(spark):
    got = value(spark, payload.file_payload(F.lit("d"), F.lit(0), F.lit("t"), F.lit("/p")))
    assert got == {"chunk_text": "t", "document_id": "d", "chunk_index": "0", "source": "/p"}


def test_payload_split_and_rebuild(spark):
    whole = text_map(chunk_text="t", a="1")
    assert value(spark, payload.payload_metadata(whole)) == {"a": "1"}
    assert value(spark, payload.payload_text(text_map(a="1"))) == ""
    assert value(
        spark, payload.rebuild_payload(payload.payload_metadata(whole), F.lit("t"))
    ) == {"chunk_text": "t", "a": "1"}


def hashed(text: str, width: int) -> np.ndarray:
    digest = hashlib.sha256(text.encode()).digest()
    raw = np.resize(np.frombuffer(digest, np.uint8).astype(np.float32) / 255, width)
    return raw / np.linalg.norm(raw)


@pytest.mark.parametrize("width", [1, 8, 32, 40, 64])
def test_hash_embedding(spark, width):
    for text in ["a red kite over the bay", "", "é"]:
        got = value(spark, vectors.hash_embedding(F.lit(text), width))
        assert len(got) == width
        assert np.allclose(got, hashed(text, width), atol=1e-6)


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_l2_normalize_keeps_a_zero_vector(spark):
    assert value(spark, vectors.l2_normalize(array(3, 4))) == [0.6, 0.8]
    assert value(spark, vectors.l2_normalize(array(0, 0))) == [0.0, 0.0]


def test_cosine(spark):
    assert value(spark, vectors.cosine(array(1, 0), array(2, 0))) == 1.0
    assert value(spark, vectors.cosine(array(1, 0), array(-2, 0))) == -1.0
    assert value(spark, vectors.cosine(array(0, 0), array(1, 1))) == 0.0
    assert np.isnan(value(spark, vectors.cosine(array(float("nan"), 0), array(1, 1))))


def test_model_embedder_feeds_slices_and_normalizes(spark):
    class Lengths:
        def encode(self, texts):
            assert len(texts) <= 2
            return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    embed = vectors.model_embedder(Lengths, "lengths", batch_size=2)
    frame = spark.createDataFrame([(t,) for t in ["a", "bb", "ccc", "", None]], "text STRING")
    rows = frame.coalesce(1).select("text", embed(F.col("text")).alias("v")).collect()
    for r in rows:
        assert np.allclose(r.v, [0.6, 0.8] if r.text else [0.0, 0.0])
    empty = frame.where("text = 'nope'").select(embed(F.col("text")).alias("v"))
    assert empty.collect() == [] and empty.dtypes == [("v", "array<float>")]


def test_grounded_prompt_text(spark):
    got = value(
        spark, prompts.grounded_prompt(F.lit("why?"), F.array(F.lit("one"), F.lit("two")))
    )
    assert got == (
        "Context (from the knowledge base):\n---\none\n---\ntwo\n---\n\nQuestion: why?\n\nAnswer:"
    )


def test_generation_request_body(spark):
    body = json.loads(value(spark, prompts.generation_request(F.lit('say "é"\n'))))
    assert body == {
        "model": "llama3.2:3b",
        "prompt": 'say "é"\n',
        "system": prompts.SYSTEM_TEXT,
        "stream": False,
        "options": {"temperature": 0.2, "num_predict": 512},
    }
