"""Single-pass HTML character reference decoding as column expressions."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_TOKEN = r"&(?:#[xX][0-9A-Fa-f]*;?|#[0-9]+;?|[0-9A-Za-z]+;?)"

# References met on most pages; looked up before the full HTML5 table because
# map lookup is a linear scan.
_COMMON = {name: html5[name] for name in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;", "amp")}

# Names that also work without the closing semicolon, longest first so that a
# leftmost alternation finds the longest prefix.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE_PREFIX = "^(" + "|".join(_BARE) + ")"

# Code points 0x80-0x9F stand for the Windows-1252 characters of those bytes.
_C1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]

_REPLACEMENT = "\ufffd"


def _table(entries: dict[str, str]) -> Column:
    # One constant-folded map literal instead of thousands of expression nodes.
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


# The same for plain strings, in the helpers that work on one page at a time.
ENTITY = re.compile(_TOKEN)
_BARE_START = re.compile("|".join(_BARE))


def decoded(token: str) -> str:
    """The text of one reference; the token itself if it is none."""
    if token.startswith("&#"):
        if len(token) <= 3:
            return token
        hexadecimal = token[2] in "xX"
        digits = token[3 if hexadecimal else 2 :].rstrip(";").lstrip("0")
        code = 1 << 21 if len(digits) > 8 else int(digits or "0", 16 if hexadecimal else 10)
        if 0x80 <= code <= 0x9F:
            return _C1[code - 0x80]
        return _REPLACEMENT if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code)
    name = token[1:]
    if name in html5:
        return html5[name]
    bare = _BARE_START.match(name)
    return html5[bare[0]] + name[bare.end() :] if bare else token


def _character(code: Column) -> Column:
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return (
        F.when(code.between(0x80, 0x9F), F.element_at(F.array(*map(F.lit, _C1)), (code - 0x7F).cast("int")))
        .when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit(_REPLACEMENT))
        .otherwise(F.decode(utf32, "UTF-32"))
    )


def _numeric(token: Column) -> Column:
    # Fewer than four characters ("&#5", "&#x") are not a reference.
    digits = F.regexp_extract(token, r"^&#[xX]?0*([0-9A-Fa-f]*)", 1)
    code = (
        F.when(digits == "", F.lit("0"))
        .when(token.rlike("^&#[xX]"), F.conv(digits, 16, 10))
        .otherwise(F.conv(digits, 10, 10))
        .cast("bigint")
    )
    return (
        F.when(F.length(token) <= 3, token)
        .when(F.length(digits) > 8, F.lit(_REPLACEMENT))
        .otherwise(let(code, _character))
    )


def _named(token: Column) -> Column:
    name = F.substr(token, F.lit(2))
    bare = F.regexp_extract(name, _BARE_PREFIX, 1)
    by_prefix = F.when(
        bare != "",
        F.concat(
            F.element_at(_table({n: html5[n] for n in _BARE}), bare),
            F.substr(token, F.length(bare) + 2),
        ),
    )
    return F.coalesce(
        F.try_element_at(_table(_COMMON), name),
        F.try_element_at(_table(html5), name),
        by_prefix,
        token,
    )


def decode_entities(c: Column) -> Column:
    """Decode named and numeric references once: ``&amp;lt;`` becomes ``&lt;``."""

    def decode(text: Column) -> Column:
        decoded = F.transform(
            F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)),
            lambda t: F.when(t.startswith("&#"), _numeric(t)).otherwise(_named(t)),
        )
        pieces = F.split(text, _TOKEN, -1)
        return F.array_join(
            F.zip_with(pieces, F.concat(decoded, F.array(F.lit(""))), lambda p, d: F.concat(p, d)), ""
        )

    return let(c, lambda text: F.when(text.rlike("&[#0-9A-Za-z]"), decode(text)).otherwise(text))
