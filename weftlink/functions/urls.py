"""URL splitting, resolution and canonical form as column expressions.

``parse_url`` of Spark is not used: it rejects paths that contain spaces or
brackets and hides the port. Unparsable input yields NULL throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, rtrim_space, trim_space

# Characters that stay as they are in an encoded path or host
# (inside a character class), and those a path may hold without re-encoding.
_PATH_KEEP = r"A-Za-z0-9_.~$&+,/:;=@-"
_HOST_KEEP = r"A-Za-z0-9_.~!$&'()*+,;=:\[\]<>\"-"
_PATH_VALID = r"^[A-Za-z0-9._~!$&'()*+,;=:@/%\[\]-]*$"
# A path that is its own canonical form: no escapes, empty or dot segments.
_PLAIN_PATH = r"^(?!.*(?://|/\.\.?(?:/|$)))/[A-Za-z0-9._~!$&'()*+,;=:@/\[\]-]*$"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_CONTROL = r"[\x00-\x1F\x7F]"
_BAD_USER = r"[^A-Za-z0-9._~!$&'()*+,;=:%@-]"
_BAD_HOST = r"[\x00-\x20#/?@\\^`{|}\x7F]"
_BAD_PORT = r":[^:]*[^0-9:][^:]*$"
_BRACKETED = r"^\[[^\]]*\](:[0-9]*)?$"

# Extensions followed when no list is given.
DEFAULT_EXTENSIONS = ("", ".html", ".htm")


def percent_decode(c: Column) -> Column:
    """Decode %XX escapes; a plus sign is literal. NULL on a bad escape."""
    return F.when(~c.contains("%"), c).otherwise(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def _percent_encode(c: Column, keep: str) -> Column:
    """Percent-encode the UTF-8 bytes of every character outside ``keep``."""
    runs = F.regexp_extract_all(c, F.lit(f"[{keep}]+|[^{keep}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(r.rlike(f"^[{keep}]"), r).otherwise(
                F.regexp_replace(F.regexp_replace(F.url_encode(r), r"\+", "%20"), r"\*", "%2A")
            ),
        ),
        "",
    )


def encode_path(c: Column) -> Column:
    return F.when(c.rlike(f"^[{_PATH_KEEP}]*$"), c).otherwise(_percent_encode(c, _PATH_KEEP))


def _escaped_path(raw: Column) -> Column:
    return F.when(raw.rlike(_PATH_VALID), raw).otherwise(encode_path(percent_decode(raw)))


# A reference is cut by patterns over its whole text: an optional scheme, an
# authority after two slashes, a path, a query, a fragment.
_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
_BEFORE_AUTHORITY = f"(?:{_SCHEME}//|//(?!/))"
_PATH = f"^(?:{_BEFORE_AUTHORITY}[^/?#]*|{_SCHEME})?([^?#]*)"


def split_url(url: Column) -> Column:
    """``struct(scheme, opaque, user, host, path, query)``, or NULL if unparsable.

    ``query`` keeps its question mark, ``user`` its at sign; the path is still
    encoded. The fragment is dropped.
    """
    parts = F.struct(
        F.lower(F.regexp_extract(url, f"^({_SCHEME[:-1]}):", 1)).alias("scheme"),
        url.rlike(f"^{_SCHEME}(?!/)").alias("opaque"),
        F.regexp_extract(url, f"^{_BEFORE_AUTHORITY}([^/?#]*@)", 1).alias("user"),
        percent_decode(F.regexp_extract(url, f"^{_BEFORE_AUTHORITY}(?:[^/?#]*@)?([^/?#@]*)", 1)).alias("host"),
        F.regexp_extract(url, _PATH, 1).alias("path"),
        F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
    )
    # No control characters, no colon in a first segment that is no scheme, and
    # no broken escape in the fragment.
    readable = ~url.rlike(rf"{_CONTROL}|^(?!{_SCHEME})[^/?#]*:|#.*{_BAD_ESCAPE}")

    def valid(p: Column) -> Column:
        host = p["host"]
        bad_host = F.when(host == "", F.lit(False)).otherwise(
            host.rlike(_BAD_HOST)
            | F.when(host.startswith("["), ~host.rlike(_BRACKETED)).otherwise(host.rlike(_BAD_PORT))
        )
        bad_path = ~p["opaque"] & p["path"].rlike(_BAD_ESCAPE)
        return ~(host.isNull() | bad_host | bad_path | p["user"].rlike(_BAD_USER))

    return F.when(readable, let(parts, lambda p: F.when(valid(p), p)))


def _fold_dots(segments: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )


def _remove_dots(path: Column) -> Column:
    """Drop ``.`` and ``..`` as reference resolution does; empty segments count."""
    joined = F.concat(
        F.lit("/"),
        F.array_join(_fold_dots(F.split(path, "/", -1)), "/"),
        F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit("")),
    )
    plain = (path == "") | (path.startswith("/") & ~path.rlike(r"/\.\.?(/|$)"))
    return F.when(plain, path).otherwise(F.regexp_replace(joined, "^//", "/"))


def _clean(path: Column) -> Column:
    """Cleaned decoded path: no ``.``, ``..`` or ``//``; a trailing slash stays."""
    kept = _fold_dots(F.filter(F.split(path, "/", -1), lambda s: s != ""))
    tail = F.when(path.endswith("/"), F.lit("/")).otherwise(F.lit(""))
    folded = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^//$", "/")
    return F.when(path == "", F.lit("/")).when(path.rlike(r"//|/\.\.?(/|$)"), folded).otherwise(path)


def resolve(ref: Column, base: Column) -> Column:
    """Resolve a reference (text) against a base already split by ``split_url``.

    Gives the split target with its path escaped, or NULL.
    """

    def against_base(r: Column) -> Column:
        absolute = r["scheme"] != ""
        own_host = r["host"] != ""
        ref_path = _escaped_path(r["path"])
        inherits_query = (r["path"] == "") & (r["query"] == "") & ~own_host
        base_dir = F.regexp_extract(base["path"], "^(.*/)[^/]*$", 1)
        merged = (
            F.when(own_host | r["path"].startswith("/"), ref_path)
            .when(r["path"] == "", base["path"])
            .otherwise(F.concat(base_dir, ref_path))
        )
        base_query = F.when(base["query"] == "?", F.lit("")).otherwise(base["query"])
        return F.struct(
            F.when(absolute, r["scheme"]).otherwise(base["scheme"]).alias("scheme"),
            r["opaque"].alias("opaque"),
            F.when(absolute | own_host, r["user"]).otherwise(base["user"]).alias("user"),
            F.when(absolute | own_host, r["host"]).otherwise(base["host"]).alias("host"),
            F.when(r["opaque"], r["path"]).when(absolute, ref_path).otherwise(let(merged, _remove_dots)).alias("path"),
            F.when(absolute | ~inherits_query, r["query"]).otherwise(base_query).alias("query"),
        )

    return let(split_url(ref), lambda r: F.when(r.isNotNull() & base.isNotNull(), against_base(r)))


def _encode_host(host: Column) -> Column:
    return F.when(host.rlike(r"[^\x00-\x7F]"), _percent_encode(host, _HOST_KEEP)).otherwise(host)


def render(parts: Column) -> Column:
    """Text of a split URL."""
    return F.when(
        parts["opaque"], F.concat(parts["scheme"], F.lit(":"), parts["path"], parts["query"])
    ).otherwise(
        F.concat(parts["scheme"], F.lit("://"), parts["user"], _encode_host(parts["host"]), parts["path"], parts["query"])
    )


def canonical(target: Column, base: Column) -> Column:
    """Canonical text of a resolved target; NULL unless it is http or https."""

    def web(t: Column) -> Column:
        query = F.when(t["query"] == "", t["query"]).otherwise(rtrim_space(t["query"]))
        host = F.lower(F.when(t["host"] == "", base["host"]).otherwise(t["host"]))
        decoded = percent_decode(t["path"])
        path = F.when(t["path"].rlike(_PLAIN_PATH), t["path"]).otherwise(
            let(_clean(decoded), lambda c: F.when(c == decoded, t["path"]).otherwise(encode_path(c)))
        )
        return F.when(t["opaque"], F.concat(t["scheme"], F.lit(":"), t["path"], query)).otherwise(
            F.concat(t["scheme"], F.lit("://"), t["user"], _encode_host(host), path, query)
        )

    return F.when(target["scheme"].isin("http", "https"), web(target))


def is_plainly_canonical(url: str) -> bool:
    """Whether a URL is evidently its own canonical form; False settles nothing."""
    return re.match(r"^https?://[a-z0-9.-]+(:[0-9]+)?" + _PLAIN_PATH[1:], url) is not None


def canonical_url(url: Column, base: Column) -> Column:
    """Canonical form of any spelling of a URL, relative ones against ``base``."""
    return let(base, lambda b: let(resolve(trim_space(url), b), lambda t: canonical(t, b)))


def is_same_host(target: Column, base: Column) -> Column:
    return F.lower(target["host"]) == F.lower(base["host"])


def link_type(target: Column, base: Column) -> Column:
    """``internal`` when the host, port included, is the base's own."""
    return F.when(is_same_host(target, base), F.lit("internal")).otherwise(F.lit("external"))


# Canonical URLs are regular enough for plain string functions.


def host_of(url: Column) -> Column:
    """Lower-case host, port included, of a canonical URL."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.substring_index(authority, "@", -1))


def escaped_path_of(url: Column) -> Column:
    """Encoded path of a canonical URL; ``/`` when empty."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def decoded_path_of(url: Column) -> Column:
    return percent_decode(escaped_path_of(url))


def query_of(url: Column) -> Column:
    """Query without its question mark; empty if there is none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def extension_of(url: Column) -> Column:
    """Lower-case extension, dot included, of the last path segment."""
    return F.lower(F.regexp_extract(decoded_path_of(url), r"(\.[^./]*)$", 1))


def allowed_extensions(items: list[str] | None = None) -> list[str]:
    """The allow-list of a run; extensionless paths are always part of it."""
    if not items:
        return list(DEFAULT_EXTENSIONS)
    allowed = {""}
    for item in items:
        ext = item.strip().lower()
        if ext and ext != "/" and not ext.startswith("."):
            ext = "." + ext
        allowed.add(ext)
    return sorted(allowed)


def has_allowed_extension(url: Column, items: list[str] | None = None) -> Column:
    return extension_of(url).isin(allowed_extensions(items))


def _safe_segment(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]", "-"), r"^-+|(?<!-)-+\z", "")


def export_path(url: Column) -> Column:
    """Relative path of a page's Markdown document: ``host/segments[__query].md``."""
    host = _safe_segment(F.substring_index(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "@", -1))
    inner = F.regexp_replace(decoded_path_of(url), r"^/+|(?<!/)/+\z", "")
    segments = F.transform(
        F.split(inner, "/", -1),
        lambda s: let(_safe_segment(s), lambda t: F.when(t == "", F.lit("section")).otherwise(t)),
    )
    path = F.when(inner == "", F.lit("index")).otherwise(F.array_join(segments, "/"))
    query = query_of(url)
    suffix = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("__"), _safe_segment(query)))
    return F.concat(F.when(host == "", F.lit("unknown-host")).otherwise(host), F.lit("/"), path, suffix, F.lit(".md"))
