"""Whitespace handling and a local binding helper for column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of the Unicode White_Space property, and the
# narrower class that ``\s`` denotes inside the tag patterns (no vertical tab).
SPACE_POINTS = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
)
TAG_SPACE = r"[\t\n\f\r ]"

SPACE_CHARS = "".join(map(chr, SPACE_POINTS))

# Spaces other than U+0020 and the line break. The wide ranges on the left let
# most characters fail on one comparison.
_ODD_SPACE = (
    r"[\x09-\x0D\x7F-\u3000&&["
    + "".join(f"\\u{p:04X}" for p in SPACE_POINTS if p not in (0x0A, 0x20))
    + "]]"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def trim_space(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def ltrim_space(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE_CHARS))


def rtrim_space(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def single_spaces(c: Column) -> Column:
    """Runs of spaces within a line become one U+0020."""
    return F.regexp_replace(F.regexp_replace(c, _ODD_SPACE, " "), "  +", " ")


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces, line ends included, become one; ends are trimmed."""
    return F.trim(single_spaces(F.replace(c, F.lit("\n"), F.lit(" "))))


def word_count(c: Column) -> Column:
    """Number of space-separated words; 0 for blank text."""

    def count(text: Column) -> Column:
        words = F.size(F.split(F.regexp_replace(text, _ODD_SPACE, " "), "[ \n]+"))
        return F.when(text == "", F.lit(0)).otherwise(words).cast("bigint")

    return let(trim_space(c), count)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def remembered(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column a builder made for the same column names.

    Building a large expression costs many calls into the JVM; expressions over
    the same names are interchangeable within one Spark application.
    """

    @functools.lru_cache(maxsize=None)
    def for_application(_app: str, *names: str) -> Column:
        return build(*names)

    @functools.wraps(build)
    def lookup(*names: str) -> Column:
        return for_application(SparkContext._active_spark_context.applicationId, *names)

    return lookup
