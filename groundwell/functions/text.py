"""Whitespace tokens and overlapping token windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.binding import let
from groundwell.settings import Settings

# First and last code point of each run of Unicode white space. A token is a run
# of anything else. Java's \s knows only ASCII white space, so the set is spelled out.
WHITE_SPACE = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)


def _token_pattern() -> str:
    """A class of the ranges between white space, with the common ones in front.

    The matcher tries the parts of a nested class in order, so most characters pass at the
    first range; a negated class would try all ranges for every character.
    """
    edges = [(-1, -1), *WHITE_SPACE, (0x110000, 0x110000)]
    between = [(left[1] + 1, right[0] - 1) for left, right in zip(edges, edges[1:])]
    ranges = [rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in between if first <= last]
    ascii_and_latin = [r for r, (first, _) in zip(ranges, between) if first in (0x21, 0xA1)]
    others = [r for r in ranges if r not in ascii_and_latin]
    return f"[{ascii_and_latin[0]}[{ascii_and_latin[1]}[{''.join(others)}]]]+"


TOKEN_PATTERN = _token_pattern()


def check_window(chunk_size: int, chunk_overlap: int) -> int:
    """Validate the window when the plan is built; returns the step between windows."""
    if chunk_size <= 0:
        raise ValueError(f"a window of {chunk_size} tokens is too short")
    if not 0 <= chunk_overlap < chunk_size:
        raise ValueError(f"an overlap of {chunk_overlap} does not fit a window of {chunk_size}")
    return chunk_size - chunk_overlap


def tokens(text: Column) -> Column:
    """Tokens in order. Null, empty and blank text give an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def count_tokens(text: Column) -> Column:
    """Number of tokens, counted without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN))


def chunk_count(n_tokens: Column, chunk_size: int, chunk_overlap: int) -> Column:
    """Number of windows over ``n_tokens`` tokens; the last one is the first to reach the end."""
    step = check_window(chunk_size, chunk_overlap)
    beyond_first = F.ceil((n_tokens - chunk_size) / step).cast("int")
    return F.when(n_tokens == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(0), beyond_first) + 1
    ).cast("int")


def chunk_text(
    text: Column,
    chunk_size: int = Settings.chunk_size,
    chunk_overlap: int = Settings.chunk_overlap,
) -> Column:
    """Array of chunks: token windows joined by single spaces."""
    step = check_window(chunk_size, chunk_overlap)

    def windows(words: Column) -> Column:
        last = chunk_count(F.size(words), chunk_size, chunk_overlap) - 1
        return F.when(last < 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.array_join(F.slice(words, i * step + 1, chunk_size), " "),
            )
        )

    return let(tokens(text), windows)
