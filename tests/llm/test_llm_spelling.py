"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from groundwell.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def apart(u, v):
    """Whether one edit tells two words apart."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(rows):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if v != w and apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abé", k=rng.choice([6, 7, 8, 9]))) for _ in range(40)]
    stems += ["information", "Éducation", "éducation", "relative", "lelative", "aaaaaaaa", "aaaaaaaaa"]
    words = []
    for stem in stems:
        words += [stem] * rng.choice([1, 2, 30, 400])
        for _ in range(6):
            i = rng.randrange(len(stem) + 1)
            kind = rng.randrange(3)
            other = stem[:i] + rng.choice("abz") + stem[i:] if kind == 0 else (
                stem[:i] + stem[i + 1 :] if kind == 1 else stem[:i] + "q" + stem[i + 1 :]
            )
            words += [other] * rng.choice([1, 2, 3, 30])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 37 : (i + 1) * 37])) for i in range(len(words) // 37 + 1)]
    rows += [(900, None), (901, ""), (None, "Information INFORMATION"), (3, rows[3][1]), (3, rows[3][1])]
    return [*rows, (902, "x" * 5000 + " " + "x" * 5001), (903, "x" * 5000 + "1" + "x" * 5001)]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs.selectExpr("*", "'a' as word", "1 as n", "2 as form", "3 as key", "4 as root")


@pytest.mark.parametrize(("block", "step"), [(8192, 1 << 16), (8192, 5), (3, 20)])
def test_variants_match_brute_force(spark, monkeypatch, block, step):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "STEP_WORDS", step)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rows = corpus(block + step)
    found = [tuple(r) for r in spelling.variants(frame(spark, rows)).collect()]
    want = expected(rows)
    assert len(found) == len(want) > 150
    assert set(found) == want
    assert sum(f is not None for _, f, *_ in want) > 10


def test_roots_follow_chains(spark):
    said = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "ccccccc": 5}
    rows = [(100 + i, " ".join(w for w, n in said.items() for _ in range(n // 2))) for i in (1, 2)]
    want = expected(rows)
    assert {tuple(r) for r in spelling.variants(frame(spark, rows)).collect()} == want
    assert max(len({w, f, r}) for w, f, r, *_ in want) == 3


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "short words")])).count() == 0
