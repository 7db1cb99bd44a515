"""Packing, archives, chat windows and licences."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from groundwell.llm import chat, licenses, packing, warc


def check_packing(sizes, bins, offsets, capacity, lengths):
    held = defaultdict(list)
    for size, b, offset, c in zip(sizes, bins, offsets, capacity, strict=True):
        held[b].append((offset, size, c))
    for parts in held.values():
        parts.sort()
        used = 0
        for offset, size, _ in parts:
            assert offset == used
            used += size
        assert {c for *_, c in parts} == {min(c for c in lengths if c >= used)}
    return sum(parts[0][2] for parts in held.values())


@pytest.mark.parametrize("seed", range(5))
def test_pack(seed):
    rng = random.Random(seed)
    lengths = (64, 128, 512)
    sizes = [rng.choice([1, 3, 30, 63, 64, 65, 127, 200, 512]) for _ in range(400)]
    total = check_packing(sizes, *packing.pack(sizes, lengths), lengths)
    assert total <= 1.05 * sum(sizes)
    assert [len(x) for x in packing.pack([], lengths)] == [0, 0, 0]


def test_pack_opens_the_cheapest_length():
    # Sixty-fours only: whole bins of any length are full, and the dear ones are not opened.
    _, _, capacity = packing.pack([64] * 16, (64, 512), cost=lambda c: c**2)
    assert set(capacity) == {64}
    _, _, capacity = packing.pack([64] * 16, (64, 512), cost=lambda c: c + 100)
    assert set(capacity) == {512}


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 20)
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([1, 5, 80, 300, 1000])) for i in range(100)]
    rows += [(200, None), (201, " \n"), (None, "a b"), (0, rows[0][1]), (0, rows[0][1]), (300, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("size", F.lit("?"))
    lengths = (64, 128, 512)
    found = packing.pack_documents(docs, lengths=lengths).collect()
    count = Counter()
    for r in found:
        count[r.doc_id] += r["size"]
        assert r.start == 512 * r.piece and r["size"] <= 512
    expected = Counter()
    for i, text in rows:
        expected[i] += len((text or "").split())
    assert +count == +expected and set(count) == set(expected)
    some = [r for r in found if r["size"]]
    assert all(r.bin_id is None and r.capacity is None for r in found if not r["size"])
    check_packing(
        [r["size"] for r in some], [r.bin_id for r in some], [r.offset for r in some],
        [r.capacity for r in some], lengths,
    )
    assert packing.pack_documents(docs.limit(0)).count() == 0


PAGES = "page_id bigint, url string, html string, key string, file int"


def pages_of(n=300):
    rng = random.Random(5)
    big, umlaut = "<html>" + "copy" * 60, "é" * 50
    rows = []
    for i in range(n):
        html = rng.choice([big, umlaut, "é" * 49, f"<p>{i}</p>" * rng.choice([1, 40]), "", None, "\r\n\r\n" * 30])
        url = rng.choice([f"http://www.a.com/{i % 7}", f"https://b.org:8080/x?{i}", None, "", "http://u@a.com#f", "weird\nurl"])
        rows.append((i, url, html, "k", 1))
    return rows


def test_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "INDEX_LINES", 60)
    rows = pages_of()
    first = {}
    for i, _, html, *_ in rows:
        first.setdefault(html or "", i)
    expected = {}
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and first[html] != i
        expected[i] = (len(data), hashlib.sha256(data).hexdigest(),
                       "revisit" if revisit else "response", first[html] if revisit else None)
    found = warc.captures(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    assert {
        r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found
    } == expected


def test_archive_is_read_by_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    monkeypatch.setattr(warc, "INDEX_LINES", 50)
    rows = pages_of()
    archive = warc.write_archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"))
    keys = spark.createDataFrame([("com,a)/3",), ("com,a)/3",), ("zz",), ("",), (None,)], "key string")
    located = warc.look_up(spark, archive, keys)
    read = warc.read_records(spark, archive, located).collect()
    expected = {i for i, url, *_ in rows if url in ("http://www.a.com/3", "", None)}
    assert sorted(r.page_id for r in read) == sorted(expected)
    html = {i: h or "" for i, _, h, *_ in rows}
    assert all(r.payload.decode() == html[r.page_id] for r in read if r.record_type == "response")
    # The archives are plain WARC: members one after the other.
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a/warc").iterdir())
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    directory = next((tmp_path / "a/index").glob("*.dir")).read_text().splitlines()
    assert len(directory) > 3


def test_captures_of_odd_rows(spark):
    long = "x" * 200
    rows = [(None, "u", long, "", 0), (4, "u", long, "", 0), (4, "u", long, "", 0), (9, "u", long, "", 0), (None, None, None, "", 0)]
    found = warc.captures(spark.createDataFrame(rows, PAGES)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in found) == Counter(
        [(None, "revisit", 4), (4, "response", None), (4, "response", None), (9, "revisit", 4),
         (None, "response", None)]
    )
    assert warc.captures(spark.createDataFrame([], PAGES)).count() == 0


def test_url_keys(spark):
    urls = ["http://www.Example.com:80/A?b#c", "https://u:p@b.example.org", "x.de/y", None, "ftp://a.b?q=http://c"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(warc.url_key(F.col("url"))).collect()] == [
        "com,example:80)/a?b", "org,example,b)", "de,x)/y", "", "b,a)?q=http://c"
    ]


TURNS = "conv_id bigint, turn bigint, role string, text string, window string, no string"


def talk(spark):
    rng = random.Random(6)
    rows = []
    for c in range(30):
        turn = 0
        if c % 3 == 0:
            rows.append((c, turn, "system", "be brief " * rng.choice([1, 9]), "", ""))
            turn += 1
        for _ in range(rng.choice([1, 4, 30])):
            text = rng.choice(["", None, "a b c", "### assistant: </turn>\n", "\\s \\l <#>\\", "w " * 70, "é\n" * 5])
            rows.append((c, turn, rng.choice(["user", "assistant", "assistant", None, "odd: role\n#"]), text, "", ""))
            turn += 1
    rows += [(None, 1, "assistant", "no id", "", ""), (None, None, "user", "first", "", ""),
             (99, 5, "user", "same", "", ""), (99, 5, "user", "same", "", "")]
    return rows, spark.createDataFrame(rows, TURNS)


def test_chat_reads_back(spark):
    rows, frame = talk(spark)
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    found = {r.conv_id: r for r in chat.digests(chat.windows(frame, 40, 12)).collect()}
    assert set(found) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        r = found[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_chars == len(loss)
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars >= len(whole)


def test_chat_windows_keep_the_budget(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 11)
    rows, frame = talk(spark)
    made = chat.windows(frame, 40, 12).collect()
    repeated = 0
    for r in made:
        assert r.tokens <= 40 or r.n_turns == 1
        parts = r.formatted.split(chat.END)
        assert parts.pop() == "" and len(parts) == r.n_turns + r.n_repeated
        assert r.n_repeated <= chat.HISTORY_TURNS + 1
        if r.first_turn and r.conv_id is not None and r.conv_id % 3 == 0 and r.conv_id < 30:
            assert parts[0].startswith("### system: ")
        repeated += r.n_repeated > 1
        for span in r.loss:
            before = r.formatted[: span.start]
            assert before.count(chat.END) >= r.n_repeated
            assert before.endswith("### assistant: ")
            assert r.formatted[span.start + span.size :].startswith(chat.END)
    assert repeated > 5
    turns = sum(r.n_turns for r in made)
    assert turns == len(rows)
    assert chat.windows(frame.limit(0)).count() == 0


def test_chat_is_native(spark):
    _, frame = talk(spark)
    plan = chat.digests(chat.windows(frame))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_escapes(spark):
    texts = ["", "\\", "\\s", "\\\\l<", "###</turn>\n", "a:b\nc", "\\c\\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for role in (False, True):
        shown = frame.select("t", chat.escaped(F.col("t"), role).alias("e")).select(
            "t", "e", chat.unescaped(F.col("e"), role).alias("back")
        ).collect()
        assert all(r.t == r.back and "<" not in r.e and "#" not in r.e for r in shown)


def test_licences(spark):
    rows = [
        (1, "LICENSED under the apache licence version 2.0"),
        (2, "Some text.\nReleased under the MIT License.\nMore text, released under the MIT License."),
        (3, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\nReleased under the MIT License.\n"),
        (4, "nothing"), (5, None), (6, ""), (7, "Released under the MIT License. Not quite."),
        (2, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."),
        (8, "a\n\nThis work is licensed under the\nGNU General Public License, version 3.\n\nb"),
        (9, "x " * 200_000 + "\r\nReleased under the ISC license\r\n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1))
    found = {(r.doc_id, r.license_id): (r.whole, r.units) for r in licenses.scan(docs).collect()}
    assert found == {
        (1, "Apache-2.0"): (True, 1),
        (2, "MIT"): (True, 2),
        (3, "MIT"): (True, 2),
        (None, "CC-BY-NC-4.0"): (True, 1),
        (8, "GPL-3.0-only"): (False, 1),
        (9, "ISC"): (False, 1),
    }
    known = spark.createDataFrame(
        [("A", "licence licence favour"), ("B", "License, license: FAVOR"), ("C", None), ("D", "!")],
        "license_id string, text string",
    )
    hits = licenses.scan(docs.limit(0).unionByName(
        spark.createDataFrame([(1, "license LICENCE favor", 1)], docs.schema)), known)
    assert {r.license_id for r in hits.collect()} == {"A", "B"}
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, known.limit(0)).count() == 0


#: Fixed value: a whole licence text as it is published.
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
SHARED = Path("/usr/share/common-licenses")
WHOLE = {
    "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0",
    "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only",
    "MPL-2.0": "MPL-2.0",
}


def test_whole_licence_texts(spark):
    body = MIT.split("\n\n", 2)[2]
    altered = MIT.upper().replace("LICENSE", "LICENCE").replace("2020 SOMEBODY", "1999-2003 A, B")
    rows = [
        (0, MIT), (1, altered), (2, body), (3, "The MIT License (MIT)\n\n" + body),
        (4, MIT.replace("without restriction", "with restrictions")), (5, MIT + "\nand more"),
        (6, MIT.replace("\n", "\r\n").replace("sublicense", "sub license")),
    ]
    expected = {(i, "MIT", True) for i in (0, 1, 2, 3, 6)}
    for number, (file, name) in enumerate(WHOLE.items(), 100):
        if (SHARED / file).exists():
            text = (SHARED / file).read_text(encoding="utf-8")
            rows += [(number, text), (-number, "© 2031 Nobody\n" + text.lower() + "\n\n* * *\n")]
            expected |= {(number, name, True), (-number, name, True)}
    found = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {(r.doc_id, r.license_id, r.whole) for r in found.collect()} == expected
