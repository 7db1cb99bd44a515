"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright lines, equivalent spellings
made one, only letters and digits left. Its digest is joined with those of known licence texts.
Looked up are the whole document, each paragraph and each line, every one as an entire text.

Known are short notices, and whole licence texts by their digest alone. As copyright lines are told
by how a line begins, a whole text must have its lines broken as its publisher does where a line of
its body would else begin with that word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.decontamination import normal_words
from groundwell.operators.sizes import broadcast_if_small

#: Notices by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)
#: SHA-256 of the canonical form of whole licence texts, by SPDX identifier; several
#: where a title above the text or a word in it differs.
TEXT_DIGESTS = (
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("BSD-2-Clause", "c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.3-only", "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0-only", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0-only", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0-only", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("ISC", "6e9dc1cd727a12354f4cef293d9d285ed81ed312d597842774d1120ac62a6dc6"),
    ("LGPL-2.0-only", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.1-only", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)
#: Spellings that mean the same, as words of the canonical form.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)
#: What the lines of a copyright statement begin with.
_COPYRIGHT = ("copyright", "(c)", "©", "all rights reserved")
_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Plain searches are much cheaper than the pattern, and few texts need it.
    stated = F.lit(False)
    for phrase in _COPYRIGHT:
        stated = stated | F.contains(low, F.lit(phrase))
    bare = F.when(stated, F.regexp_replace(low, _COPYRIGHT_LINE, " ")).otherwise(low)
    # Every word has two blanks of its own, so that neighbours can both be replaced.
    words = F.concat(F.lit(" "), F.concat_ws("  ", normal_words(bare)), F.lit(" "))
    for spelling, meant in SPELLINGS:
        words = F.replace(words, F.lit(_padded(spelling)), F.lit(_padded(meant)))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def _padded(words: str) -> str:
    return "".join(f" {word} " for word in words.split())


def known_licences(spark: SparkSession) -> DataFrame:
    """The built-in notices: ``license_id, text``."""
    return spark.createDataFrame(list(NOTICES), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, license_id, whole, units``: the licences that each document states.

    ``known`` has ``license_id, text`` (the built-in notices, and the whole texts of
    ``TEXT_DIGESTS``, if left out). ``whole`` says
    that the entire document is the licence text, ``units`` in how many of its lines,
    paragraphs of several lines, and the whole it was found. Nothing is found in null and
    empty texts, and empty licence texts are passed over; repeated rows and a repeated id add
    up in one row; a text known under two licences gives both. Empty tables give an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    digests = (
        (known_licences(spark) if known is None else known)
        .select("license_id", canonical(F.col("text")).alias("form"))
        .where("form != ''")
        .select("license_id", F.sha2("form", 256).alias("digest"))
    )
    if known is None:
        texts = spark.createDataFrame(list(TEXT_DIGESTS), "license_id string, digest string")
        digests = digests.unionByName(texts)
    digests = digests.distinct()
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r", "")
    parts = F.when(F.col("text").rlike(r"\n[ \t]*\n"), F.split("text", r"\n[ \t]*\n"))
    unit = lambda whole, x: F.struct(F.lit(whole).alias("whole"), x.alias("text"))
    paragraphs = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: p.rlike(r"\S[^\n]*\n\s*\S"))
    lines = F.when(F.contains("text", F.lit("\n")), F.split("text", "\n")).otherwise(
        F.array().cast("array<string>")
    )
    units = F.concat(
        F.array(unit(True, F.col("text"))),
        F.transform(F.concat(paragraphs, lines), lambda p: unit(False, p)),
    )
    return (
        docs.select("doc_id", text.alias("text"))
        .select("doc_id", F.explode(units).alias("unit"))
        .select(
            "doc_id", "unit.whole", F.sha2(canonical(F.col("unit.text")), 256).alias("digest")
        )
        .join(broadcast_if_small(digests), "digest")
        .groupBy("doc_id", "license_id")
        .agg(F.max("whole").alias("whole"), F.count("*").alias("units"))
    )
