"""Extraction from HTML text with regular expressions, as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import pagetext
from .entities import decode_entities
from .text import TAG_SPACE, let, trim_space

# Link pattern, skipped link schemes, head patterns and the two
# phrases of the output. The loose tag patterns are part of the results: ``<a``
# covers any tag whose name starts with a.
#
# Between two ``>`` only the first ``<a`` need be tried: what a later one could
# match, the first can. The atomic groups say so; without them a page of tags
# that never end takes time by the square of its length.
_PIECE = r"(?:\G|(?<=>))"
HREF = (
    rf"(?i){_PIECE}(?>[^>]*?<a)[^>]*?(?<![0-9A-Za-z_])href{TAG_SPACE}*={TAG_SPACE}*"
    rf"(\"[^\"]*\"|'[^']*'|[^\t\n\f\r \"'>]+)"
)
SKIPPED_SCHEMES = ("javascript:", "mailto:", "tel:")
TITLE = r"(?is)\A(?>.*?<title)(?>[^>]*>)(.*?)</title>"
DESCRIPTION = rf"(?:name|property){TAG_SPACE}*={TAG_SPACE}*['\"](?:description|og:description)['\"]"
REFRESH = rf"http-equiv{TAG_SPACE}*={TAG_SPACE}*['\"]refresh['\"]"
EMPTY_PAGE = "*No textual content extracted.*\n"
REFRESH_LABEL = "Meta refresh redirect target: "


def hrefs(html: Column) -> Column:
    """Raw ``href`` values in document order, quotes removed."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(found, unquote)


def unquote(c: Column) -> Column:
    quoted = c.startswith('"') | c.startswith("'")
    return F.when(quoted, F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def clean_href(raw: Column) -> Column:
    """Trimmed and decoded link text."""
    return decode_entities(trim_space(raw))


def is_followable(href: Column) -> Column:
    lower = F.lower(href)
    skipped = (href == "") | (href == "#")
    for scheme in SKIPPED_SCHEMES:
        skipped = skipped | lower.startswith(scheme)
    return ~skipped


def title(html: Column) -> Column:
    return trim_space(decode_entities(F.regexp_extract(html, TITLE, 1)))


def meta_content(html: Column, attribute: str) -> Column:
    """``content`` of the first meta tag that has ``attribute`` before it; empty if there is none.

    Of several contents in a tag the last counts, which may run on behind the
    tag's ``>``, to the next quote. Every piece between two ``>`` is read once,
    from its first ``<meta``: a later one in it can match nothing else.
    """
    opening = rf"(?is)\A(.*)content{TAG_SPACE}*={TAG_SPACE}*['\"]([^'\"]+)"

    def of_pieces(pieces: Column) -> Column:
        last_quote = F.array_max(F.transform(pieces, lambda p, i: F.when(p.rlike("['\"]"), i)))

        def content(p: Column, i: Column, last: Column) -> Column:
            def of_tag(tag: Column) -> Column:
                def parts(end: str) -> Column:
                    names = enumerate(("before", "value", "end"), 1)
                    return F.struct(i.alias("i"), *(F.regexp_extract(tag, opening + end, k).alias(n) for k, n in names))

                # A value without an end in its piece needs a quote in a later one.
                return F.when(i < last, parts(r"(['\"]|\z)")).otherwise(parts("(['\"])"))

            return let(F.regexp_extract(p, r"(?is)<meta(.*)\z", 1), of_tag)

        def value(found: Column) -> Column:
            rest = F.array_join(F.slice(pieces, found["i"] + 2, F.size(pieces)), ">")
            behind = F.concat(F.lit(">"), F.regexp_extract(rest, r"\A[^'\"]*", 0))
            whole = F.concat(found["value"], F.when(found["end"] == "", behind).otherwise(F.lit("")))
            return F.coalesce(whole, F.lit(""))

        tags = let(last_quote, lambda last: F.transform(pieces, lambda p, i: content(p, i, last)))
        fits = F.filter(tags, lambda t: (t["value"] != "") & t["before"].rlike(rf"(?is).{attribute}"))
        return let(F.get(fits, F.lit(0)), value)

    return F.when(html.rlike(rf"(?i){attribute}"), let(F.split(html, ">", -1), of_pieces)).when(html.isNotNull(), F.lit(""))


def description(html: Column) -> Column:
    return trim_space(decode_entities(meta_content(html, DESCRIPTION)))


def refresh_target(html: Column) -> Column:
    """Target of the first meta refresh; empty if there is none."""

    def target(content: Column) -> Column:
        urls = F.filter(
            F.transform(F.split(content, ";", -1), trim_space), lambda part: F.lower(part).startswith("url=")
        )
        first = F.coalesce(F.get(urls, F.lit(0)), F.lit("url="))
        unquoted = F.regexp_replace(trim_space(F.substr(first, F.lit(5))), r"^['\"]+|(?<!['\"])['\"]+\z", "")
        return decode_entities(unquoted)

    return let(
        meta_content(html, REFRESH), lambda c: F.when(c == "", c).otherwise(target(c))
    )


@F.arrow_udf(StringType())
def visible_text(html: pa.Array) -> pa.Array:
    """What a reader sees, ended by a line break; empty if nothing."""
    return pa.array([None if h is None else pagetext.visible(h) for h in html.to_pylist()], pa.string())


def fallback_document(html: Column) -> Column:
    """Document of a page without Markdown: title, description, refresh, text."""

    def part(value: Column, prefix: str = "") -> Column:
        return let(
            value, lambda v: F.when(v == "", v).otherwise(F.concat(F.lit(prefix), v, F.lit("\n\n")))
        )

    text = let(visible_text(html), lambda v: F.when(v == "", F.lit(EMPTY_PAGE)).otherwise(v))
    return F.concat(part(title(html), "# "), part(description(html)), part(refresh_target(html), REFRESH_LABEL), text)
