"""Text column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms U+FF01..U+FF5E sit this far above their ASCII twins.
FULLWIDTH_FIRST = 0xFF01
FULLWIDTH_LAST = 0xFF5E
FULLWIDTH_SHIFT = 65248
IDEOGRAPHIC_SPACE = 0x3000


def fullwidth_to_halfwidth(text: Column) -> Column:
    wide = [IDEOGRAPHIC_SPACE, *range(FULLWIDTH_FIRST, FULLWIDTH_LAST + 1)]
    narrow = [32, *(c - FULLWIDTH_SHIFT for c in wide[1:])]
    return F.translate(text, "".join(map(chr, wide)), "".join(map(chr, narrow)))


def safe_decode(data: Column) -> Column:
    """UTF-8 bytes to text; malformed bytes are dropped, as are replacement marks."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "�", "")


def any_pattern_match(text: Column, patterns: list[str]) -> Column:
    """True where at least one regular expression is found."""
    if not patterns:
        return F.lit(False)
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    """As an OR of plain tests, which readers can push down."""
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes], F.lit(False))


def inner_substring(text: Column, skip: int, trailing: int) -> Column:
    """Drop ``skip`` leading and ``trailing`` closing characters; empty if too short."""
    keep = F.greatest(F.length(text) - skip - trailing, F.lit(0))
    return F.substring(text, F.lit(skip + 1), keep)
