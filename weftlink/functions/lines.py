"""Leading and trailing line blocks of a text, as column expressions.

A block is up to ``MAX_LINES`` trimmed, non-blank lines joined by a line break.
Only those few lines are split off; the text itself is never split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, ltrim_space, rtrim_space, trim_space

# Longest header and footer block.
MAX_LINES = 6


def _until_blank(lines: Column) -> Column:
    return let(
        F.transform(lines, trim_space),
        lambda t: let(
            F.array_position(t, ""),
            lambda at: F.when(at == 0, t).otherwise(F.slice(t, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))),
        ),
    )


def header_block(text: Column) -> Column:
    first = F.substring_index(ltrim_space(text), "\n", MAX_LINES)
    return F.array_join(_until_blank(F.split(first, "\n", -1)), "\n")


def footer_block(text: Column) -> Column:
    last = F.substring_index(rtrim_space(text), "\n", -MAX_LINES)
    return F.array_join(F.reverse(_until_blank(F.reverse(F.split(last, "\n", -1)))), "\n")


def starts_with_block(block: Column, candidate: Column) -> Column:
    """Whether a text whose header block is ``block`` starts with ``candidate``."""
    return F.concat(block, F.lit("\n")).startswith(F.concat(candidate, F.lit("\n")))


def ends_with_block(block: Column, candidate: Column) -> Column:
    return F.concat(F.lit("\n"), block).endswith(F.concat(F.lit("\n"), candidate))


def line_count(block: Column) -> Column:
    return F.when(block == "", F.lit(0)).otherwise(F.length(block) - F.length(F.replace(block, F.lit("\n"))) + 1)


def drop_first_lines(text: Column, n: Column) -> Column:
    """Text after its first ``n`` non-blank lines, ends trimmed."""
    return let(
        ltrim_space(text), lambda t: trim_space(F.substr(t, F.length(F.call_function("substring_index", t, F.lit("\n"), n)) + 2))
    )


def drop_last_lines(text: Column, n: Column) -> Column:
    return let(
        rtrim_space(text),
        lambda t: trim_space(F.left(t, F.length(t) - F.length(F.call_function("substring_index", t, F.lit("\n"), -n)))),
    )
