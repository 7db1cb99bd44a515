"""Cross-tokenizer alignment against a plain computation."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from groundwell.llm import alignment

pytestmark = pytest.mark.skipif(
    not Path(alignment.VOCABULARY_A).exists(), reason="no vocabulary files"
)

TEXTS = [
    "The quick brown fox, jumps over\n\n  the lazy dog.", "Été à la plage ça va œuvre 中文字符 🙂 end",
    None, "", " ", "x", "<|endoftext|> is </s> plain <0x41> text", "a ▁ b", "tab\tand\r\nmore   spaces",
    "The quick brown fox again " * 40, "naïve coöperation " * 7, "0123456789" * 30, " nbsp　wide",
]


def spans(ids, entries):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(entries[i]), i))
        at += len(entries[i])
    return out


def brute_force(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(alignment.VOCABULARY_A)
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    a_bytes = alignment.byte_level(alignment.VOCABULARY_A).entries
    b_bytes = alignment.sentence_pieces(alignment.VOCABULARY_B).entries
    docs, count = [], Counter()
    for doc, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        want = b" " + text.encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a, b = [], []
        a, b = spans(a, a_bytes), spans(b, b_bytes)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append([[i for s, e, i in side if start <= s and e <= cut] for side in (a, b)])
            start = cut
        links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
        count.update(links)
        docs.append((doc, a, b, groups, links))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for doc, a, b, groups, links in docs:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            doc, len(a), len(b), len(groups), len(links),
            sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(said.encode()).hexdigest() if a else "",
        ))
    return Counter(out)


@pytest.mark.parametrize("chunk", [1, 200, 1 << 22])
def test_alignment_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "TOKENIZED_BYTES", min(chunk, 1 << 18))
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (3, TEXTS[0]), (3, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "1 as chunk", "2 as slots", "3 as n_a", "4 as groups_sha256"
    )
    found = alignment.link_scores(docs).collect()
    assert Counter(tuple(r) for r in found) == brute_force(rows)
    assert sum(r.n_links > 0 for r in found) >= 12


def test_groups_spell_the_text(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = alignment.byte_level(alignment.VOCABULARY_A).entries
    b = alignment.sentence_pieces(alignment.VOCABULARY_B).entries
    for row in alignment.alignments(docs).collect():
        said, text = b"", (" " + (TEXTS[row.doc_id] or "")).encode()
        for group in row.groups:
            mine = b"".join(a[i] for i in group.a)
            assert mine == b"".join(b[i] for i in group.b) != b""
            said += mine
            assert len(said) == group.end
        assert said == (text if row.groups else b"")


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.link_scores(empty).count() == 0
    assert alignment.alignments(empty).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [r.n_links for r in alignment.link_scores(nulls).collect()] == [0, 0]


def test_parted_texts_have_the_tokens_of_whole_ones(monkeypatch):
    rng = random.Random(5)
    marks = [" ", " ", " ", "  ", "\n", "\t", "\r\n", " ", "　", "᠎", " ", "\x1c", "\x00",
             "\u0085", "▁", "'s", "'ll", "7", "42", "é", "à", "中", "🙂", "-", "...", "<s>", "the", "Ab"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(1, 60))) for _ in range(3000)]
    codecs = [
        alignment.byte_level(alignment.VOCABULARY_A),
        alignment.sentence_pieces(alignment.VOCABULARY_B),
    ]
    assert all(c.parted for c in codecs)
    whole = [alignment._Codec(c.encode, c.entries) for c in codecs]
    monkeypatch.setattr(alignment, "KNOWN_BYTES", 2000)  # forgotten again and again
    for low in range(0, len(texts), 500):
        some = texts[low : low + 500]
        found, expected = (alignment.align_texts(some, *pair) for pair in (codecs, whole))
        for name in ("a", "b", "a_text", "b_text", "group_text", "link_a", "link_b"):
            assert getattr(found, name).tolist() == getattr(expected, name).tolist()
        assert alignment.group_digests(found) == alignment.group_digests(expected)


def test_distinct_words_are_tokenized_once(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(40)]
    codecs = [
        alignment.byte_level.__wrapped__(alignment.VOCABULARY_A),
        alignment.sentence_pieces.__wrapped__(alignment.VOCABULARY_B),
    ]
    seen: list[list[str]] = [[], []]
    for codec, own in zip(codecs, seen, strict=True):
        encode = codec.encode
        monkeypatch.setattr(codec, "encode", lambda s, own=own, e=encode: own.extend(s) or e(s))
    for low in (0, 20):
        alignment.align_texts(texts[low : low + 20], *codecs)
    for own in seen:
        assert 0 < sum(map(len, own)) < sum(map(len, texts)) / 10
