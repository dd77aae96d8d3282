"""Page to Markdown, and the exported document around it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from . import pagetext, urls
from .html import clean_href, is_followable
from .text import collapse_spaces, let

_LINK = pa.struct([("label", pa.string()), ("target", pa.string()), ("image", pa.bool_())])
_PARTS = pa.struct([("texts", pa.list_(pa.string())), ("links", pa.list_(_LINK))])


@F.arrow_udf(from_arrow_type(_PARTS))
def markdown_parts(html: pa.Array) -> pa.Array:
    """A page's Markdown cut at its links, and the links that go between, their targets as they are written."""
    names = [f.name for f in _LINK]
    out = []
    for page in html.to_pylist():
        texts, links = pagetext.markdown_parts(page) if page is not None else (None, None)
        out.append({"texts": texts, "links": None if links is None else [dict(zip(names, x)) for x in links]})
    return pa.array(out, _PARTS)


def _written(link: Column, base: Column) -> Column:
    """``[label](absolute URL)``, ``![alt](absolute URL)``, or the label alone if it leads nowhere."""

    def with_target(href: Column) -> Column:
        url = F.when(is_followable(href), urls.canonical_url(href, base))
        sign = F.when(link["image"], F.lit("![")).otherwise(F.lit("["))
        return let(url, lambda u: F.coalesce(F.concat(sign, link["label"], F.lit("]("), u, F.lit(")")), link["label"]))

    return let(clean_href(link["target"]), with_target)


def page_markdown(html: Column, base: Column) -> Column:
    """Markdown of a page: headings, lists, emphasis, tables, code, absolute links and images.

    ``base`` is the page's split URL. Empty for a page without text.
    """

    def join(page: Column) -> Column:
        links = F.transform(page["parts"]["links"], lambda x: _written(x, page["base"]))
        both = F.zip_with(page["parts"]["texts"], F.concat(links, F.array(F.lit(""))), lambda text, link: F.concat(text, link))
        return F.array_join(both, "")

    # The Arrow function stays outside of the lambda, which can't call it.
    return let(F.struct(markdown_parts(html).alias("parts"), base.alias("base")), join)


def _quoted(text: Column) -> Column:
    return F.concat(
        F.lit('"'),
        F.regexp_replace(F.regexp_replace(text, r'([\\"])', r"\\$1"), "\n", r"\\n"),
        F.lit('"'),
    )


def document(
    url: Column,
    status: Column,
    retrieved_ms: Column,
    fetched_at: Column,
    digest: Column,
    words: Column,
    internal_links: Column,
    external_links: Column,
    error: Column,
    text: Column,
) -> Column:
    """Front matter and text, as written to an exported file."""

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\n"))

    return F.concat(
        F.lit("---\n"),
        field("url", url),
        field("status", status),
        field("retrieved_ms", retrieved_ms),
        field("fetched_at", F.date_format(fetched_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("content_sha256", digest),
        field("word_count", words),
        field("internal_links", internal_links),
        field("external_links", external_links),
        F.when(error == "", F.lit("")).otherwise(field("error", _quoted(error))),
        F.lit("---\n\n"),
        text,
        F.lit("\n"),
    )


def front_matter_hash(doc: Column) -> Column:
    """``content_sha256`` of an exported document; NULL when it has none."""

    def within(text: Column) -> Column:
        block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
        value = F.regexp_extract(block, r"(?dm)^[\t\x0B\f\r ]*content_sha256:([^\n]*)$", 1)
        return F.when(
            block.rlike(r"(?dm)^[\t\x0B\f\r ]*content_sha256:"), collapse_spaces(value)
        )

    return let(F.replace(doc, F.lit("\r\n"), F.lit("\n")), within)
