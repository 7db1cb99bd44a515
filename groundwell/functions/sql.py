"""The same functions for SQL text.

They are defined in SQL, expand into the plan of the query that calls them, and start no Python
worker. ``register`` makes them known as temporary functions. Chunks are a list, made in a
subquery and opened by ``lateral view outer inline(...)``: a function that returns a table would be
joined back to its rows by the whole text, and without ``outer`` a filter on the size of the list
would make it a second time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from groundwell.functions.ids import URL_NAMESPACE
from groundwell.functions.prompts import CONTEXT_HEADING, CONTEXT_SEPARATOR
from groundwell.functions.text import TOKEN_PATTERN
from groundwell.settings import Settings


def _quoted(text: str) -> str:
    """A SQL string with the same characters, whatever the session thinks of escapes."""
    if "\\" in text and "'" not in text:
        return f"r'{text}'"
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def statements(prefix: str = "") -> list[str]:
    """The definitions, each a statement; names start with ``prefix``."""
    size, overlap = Settings.chunk_size, Settings.chunk_overlap
    make = f"create or replace temporary function {prefix}"
    separator = _quoted(CONTEXT_SEPARATOR)
    return [
        f"""{make}text_tokens(text string) returns array<string>
        return regexp_extract_all(coalesce(text, ''), {_quoted(TOKEN_PATTERN)}, 0)""",
        f"""{make}chunk_count(n int, size int, overlap int) returns int
        return case
          when size <= 0 or overlap < 0 or overlap >= size then
            raise_error('the overlap does not fit the window')
          when n = 0 then 0
          else cast(greatest(0, ceil((n - size) / (size - overlap))) as int) + 1 end""",
        f"""{make}word_windows(words array<string>, size int, overlap int)
        returns array<struct<chunk_index int, chunk_text string>>
        return case
          when {prefix}chunk_count(size(words), size, overlap) = 0 then array()
          else transform(
            sequence(0, {prefix}chunk_count(size(words), size, overlap) - 1),
            i -> named_struct(
              'chunk_index', i,
              'chunk_text', array_join(slice(words, i * (size - overlap) + 1, size), ' '))) end""",
        f"""{make}text_chunks(
          text string, size int default {size}, overlap int default {overlap}
        ) returns array<struct<chunk_index int, chunk_text string>>
        return {prefix}word_windows({prefix}text_tokens(text), size, overlap)""",
        f"""{make}uuid5(name string) returns string
        return concat(
          substring(sha1(concat(unhex('{URL_NAMESPACE}'), encode(name, 'UTF-8'))), 1, 8), '-',
          substring(sha1(concat(unhex('{URL_NAMESPACE}'), encode(name, 'UTF-8'))), 9, 4), '-5',
          substring(sha1(concat(unhex('{URL_NAMESPACE}'), encode(name, 'UTF-8'))), 14, 3), '-',
          translate(
            substring(sha1(concat(unhex('{URL_NAMESPACE}'), encode(name, 'UTF-8'))), 17, 1),
            '0123456789abcdef', '89ab89ab89ab89ab'),
          substring(sha1(concat(unhex('{URL_NAMESPACE}'), encode(name, 'UTF-8'))), 18, 3), '-',
          substring(sha1(concat(unhex('{URL_NAMESPACE}'), encode(name, 'UTF-8'))), 21, 12))""",
        f"""{make}chunk_id(document_id string, chunk_index int) returns string
        return {prefix}uuid5(concat(document_id, ':', cast(chunk_index as string)))""",
        f"""{make}path_document_id(path string) returns string
        return substring(sha1(path), 1, 16)""",
        f"""{make}grounded_prompt(query string, contexts array<string>) returns string
        return concat(
          {_quoted(CONTEXT_HEADING)}, {separator}, array_join(contexts, {separator}), {separator},
          '\\nQuestion: ', query, '\\n\\nAnswer:')""",
    ]


def register(spark: SparkSession, prefix: str = "") -> None:
    """Define ``text_tokens``, ``chunk_count``, ``word_windows``, ``text_chunks``, ``uuid5``,
    ``chunk_id``, ``path_document_id`` and ``grounded_prompt`` for this session."""
    for statement in statements(prefix):
        spark.sql(statement)
