from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from groundwell.functions.text import chunk_count, chunk_text, count_tokens, tokens
from groundwell.operators.chunking import (
    chunk_documents,
    chunk_documents_by_token,
    chunk_token_rows,
    chunk_pages,
    coverage_audit,
    overlap_audit,
)
from groundwell.operators.running import running_sum
from groundwell.sources.files import assemble_pages


def windows(text: str | None, size: int, overlap: int) -> list[str]:
    """Plain restatement: chunk i holds tokens [i * step, i * step + size)."""
    words = re.findall(r"\S+", text or "")
    if not words:
        return []
    step = size - overlap
    n = 1 + max(0, -(-(len(words) - size) // step))
    return [" ".join(words[i * step:i * step + size]) for i in range(n)]


def words(n: int) -> str:
    return " ".join(f"token{i}" for i in range(n))


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text STRING").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "n"), [("one two three", 3), ("", 0), ("   ", 0), (None, 0), (" a\n\nb ", 2)]
)
def test_count_tokens(spark, text, n):
    assert one(spark, text, count_tokens(F.col("text"))) == n


def test_tokens_split_at_every_unicode_white_space_only(spark):
    text = "".join(f"x{chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    assert one(spark, text, tokens(F.col("text"))) == re.findall(r"\S+", text)


def test_byte_order_mark_and_zero_width_space_are_no_white_space(spark):
    text = chr(0xFEFF) + "first" + chr(0x200B) + "still" + chr(0xA0) + "second"
    assert one(spark, text, count_tokens(F.col("text"))) == 2


def test_short_text_is_one_chunk(spark):
    assert one(spark, "alpha beta gamma", chunk_text(F.col("text"), 10, 2)) == ["alpha beta gamma"]


def test_chunks_respect_size(spark):
    chunks = one(spark, words(100), chunk_text(F.col("text"), 32, 8))
    assert len(chunks) > 1
    assert all(len(c.split()) <= 32 for c in chunks)


def test_neighbours_share_the_overlap(spark):
    chunks = one(spark, words(50), chunk_text(F.col("text"), 20, 5))
    assert len(chunks) >= 2
    for left, right in zip(chunks, chunks[1:]):
        assert left.split()[-5:] == right.split()[:5]


def test_every_token_is_covered(spark):
    chunks = one(spark, words(40), chunk_text(F.col("text"), 15, 3))
    assert set(words(40).split()) == set(" ".join(chunks).split())


@pytest.mark.parametrize("text", ["", " \n\t ", None])
def test_blank_text_has_no_chunks(spark, text):
    assert one(spark, text, chunk_text(F.col("text"))) == []


@pytest.mark.parametrize(("size", "overlap"), [(0, 64), (10, 10), (10, -1), (-1, 0)])
def test_bad_windows_are_refused_when_the_plan_is_built(spark, size, overlap):
    with pytest.raises(ValueError):
        chunk_text(F.lit("hello world"), size, overlap)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    gaps = [" ", "\n", "  ", "\t", chr(0x3000), chr(0x0B)]
    texts = [None, "", "  ", "one"]
    for n in [1, 2, 5, 6, 7, 8, 9, 12, 13, 20, 31, 32, 33, 64, 100]:
        texts.append("".join(f"w{rng.randrange(9)}{rng.choice(gaps)}" for _ in range(n)))
    rows = [(f"d{i}", t, {"k": "v"}) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(
        rows, "document_id STRING, text STRING, metadata MAP<STRING,STRING>"
    )
    return rows, frame


@pytest.mark.parametrize(("size", "overlap"), [(512, 64), (32, 8), (5, 4), (1, 0), (7, 6), (8, 0)])
def test_all_chunkers_agree(spark, corpus, size, overlap):
    rows, frame = corpus
    expected = {(d, i): c for d, t, _ in rows for i, c in enumerate(windows(t, size, overlap))}

    def found(chunks):
        return {(r.document_id, r.chunk_index): r.chunk_text for r in chunks.collect()}

    assert found(chunk_documents(frame, size, overlap)) == expected
    assert found(chunk_documents_by_token(frame, size, overlap)) == expected
    audit = coverage_audit(frame, size, overlap).agg(F.sum("n_uncovered")).first()[0]
    assert audit == 0


def test_chunk_rows_have_the_declared_schema(corpus):
    _, frame = corpus
    assert dict(chunk_documents(frame).dtypes) == {
        "document_id": "string",
        "chunk_index": "int",
        "chunk_text": "string",
        "metadata": "map<string,string>",
    }


def test_null_metadata_becomes_an_empty_map(spark):
    frame = spark.createDataFrame(
        [("a", "x", None), ("b", "y", {"k": None})],
        "document_id STRING, text STRING, metadata MAP<STRING,STRING>",
    )
    rows = {r.document_id: r.metadata for r in chunk_documents(frame).collect()}
    assert rows == {"a": {}, "b": {"k": "None"}}


def test_chunk_count_closed_form(spark):
    for size, overlap in [(5, 2), (1, 0), (7, 6)]:
        rows = spark.range(60).select(
            F.col("id").cast("int").alias("n"),
            chunk_count(F.col("id").cast("int"), size, overlap).alias("c"),
        ).collect()
        assert [r.c for r in rows] == [len(windows(words(r.n), size, overlap)) for r in rows]


def test_overlap_audit_sees_a_broken_neighbour(spark):
    frame = spark.createDataFrame(
        [("d", 0, "a b c"), ("d", 1, "b c d"), ("d", 2, "x y z")],
        "document_id STRING, chunk_index INT, chunk_text STRING",
    )
    rows = {r.chunk_index: r.overlap_ok for r in overlap_audit(frame, 2).collect()}
    assert rows == {0: True, 1: False}


def test_chunking_pages_equals_chunking_the_assembled_text(spark):
    rng = random.Random(3)
    rows = []
    for d, n_pages in [("a", 1), ("b", 40), ("hot", 400), ("blank", 3)]:
        for p in range(n_pages):
            text = None if d == "blank" or rng.random() < 0.1 else words(rng.randrange(9))
            rows.append((d, p, text))
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "document_id STRING, page_no INT, page_text STRING")
    whole = {r.document_id: r.text for r in assemble_pages(pages).collect()}
    for size, overlap in [(32, 8), (3, 2), (1, 0)]:
        expected = {
            (d, i): c for d, t in whole.items() for i, c in enumerate(windows(t, size, overlap))
        }
        got = chunk_pages(pages, size, overlap).collect()
        assert {(r.document_id, r.chunk_index): r.chunk_text for r in got} == expected
        assert len(got) == len(expected)


def test_assembled_pages_keep_order_and_empty_pages(spark):
    pages = spark.createDataFrame(
        [("d", 2, "c"), ("d", 0, "a"), ("d", 1, None)],
        "document_id STRING, page_no INT, page_text STRING",
    )
    assert assemble_pages(pages).first()["text"] == "a\n\n\n\nc"


def test_running_sum_in_blocks_equals_a_plain_one(spark):
    rows = [("hot", i, (i * 7) % 5) for i in range(100)] + [("b", 0, 3), ("b", 1, 4)]
    frame = spark.createDataFrame(rows, "k STRING, p INT, v INT")
    got = running_sum(frame, ["k"], "p", "v", "s", total="t", block=8).collect()
    for r in got:
        mine = [v for k, p, v in rows if k == r.k]
        assert r.s == sum(v for k, p, v in rows if k == r.k and p <= r.p)
        assert r.t == sum(mine)
    assert len(got) == len(rows)


def test_a_page_without_a_number_is_kept(spark):
    pages = spark.createDataFrame(
        [("d", 0, "a b"), ("d", None, "c d"), (None, 1, "e f")],
        "document_id STRING, page_no INT, page_text STRING",
    )
    rows = {(r.document_id, r.chunk_index): r.chunk_text for r in chunk_pages(pages, 2, 0).collect()}
    assert rows == {("d", 0): "c d", ("d", 1): "a b", (None, 0): "e f"}


def _shuffled_bytes(frame) -> int:
    """Bytes of the rows that the exchanges of a frame passed on when it was collected."""
    seen, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if kind == "ShuffleExchangeExec":
                seen += plan.metrics().apply("dataSize").value()
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
    return seen


def test_token_rows_travel_as_runs(spark):
    # A struct for each token took about nine times the text.
    rows = [(f"d{i}", " ".join(f"w{i * j % 97}" for j in range(1000))) for i in range(40)]
    frame = spark.createDataFrame(rows, "document_id STRING, text STRING")
    chunks = chunk_documents_by_token(frame, 32, 8)
    found = {(r.document_id, r.chunk_index): r.chunk_text for r in chunks.collect()}
    assert found == {(d, i): c for d, t in rows for i, c in enumerate(windows(t, 32, 8))}
    assert 0 < _shuffled_bytes(chunks) < 4 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_token_rows_in_any_order_and_twice(spark, parts):
    rows = [
        (None if i == 2 else f"d{i}", p, 50, None if (i, p) == (1, 7) else f"{'a b' if p == 9 else 'w'}{p}")
        for i in range(4)
        for p in range(50)
    ]
    rows += [("d3", p, 40, f"u{p}" if p % 3 else "") for p in range(40)]
    rows += [("d0", None, 50, "x")]
    frame = spark.createDataFrame(rows, "document_id STRING, position INT, n_tokens INT, token STRING")
    if parts > 1:
        frame = frame.repartition(parts, "position")
    expected = {}
    for d, p, n, t in rows:
        last = max(0, -(-(n - 8) // 6))
        first, stop = (0, last) if p is None else (max(0, -(-(p - 7) // 6)), min(p // 6, last))
        for i in range(first, stop + 1):
            expected.setdefault((d, i), []).append((p is not None, p or 0, t is not None, t or ""))
    expected = {
        key: " ".join(t for _, _, known, t in sorted(own) if known) for key, own in expected.items()
    }
    found = {
        (r.document_id, r.chunk_index): r.chunk_text
        for r in chunk_token_rows(frame, 8, 2).collect()
    }
    assert found == expected
