from pyspark.sql import functions as F

from weftlink.functions import html as H
from weftlink.functions import lines as L
from weftlink.functions import markdown as M
from weftlink.functions import pagetext as P
from weftlink.functions import text as T
from weftlink.functions import urls as U
from weftlink.functions.entities import decode_entities

BASE = "https://site.example.com/dir/page?z=1#f"

CANONICAL = {
    "/für": "https://site.example.com/f%C3%BCr",
    "/a%2Fb": "https://site.example.com/a%2Fb",
    "a!b": "https://site.example.com/dir/a!b",
    "x/../y": "https://site.example.com/dir/y",
    "/a//b/": "https://site.example.com/a/b/",
    "/a//../b": "https://site.example.com/a/b",
    "/a/../b!c": "https://site.example.com/b!c",
    "/a//b!c": "https://site.example.com/a/b%21c",
    "//OTHER.org:80/x/../y": "https://other.org:80/y",
    "?q=1": "https://site.example.com/dir/page?q=1",
    "#top": "https://site.example.com/dir/page?z=1",
    "http://Ho.ST": "http://ho.st/",
    "http:///x": "http://site.example.com/x",
    "mailto:x": None,
    "/a|b": "https://site.example.com/a%7Cb",
    "/a b?c d": "https://site.example.com/a%20b?c d",
    "%zz": None,
    "a#%zz": None,
    "1:2": None,
    "/a/b/..": "https://site.example.com/a/",
    "http://h/a/b/..": "http://h/a",
    "http://u:p@h/x": "http://u:p@h/x",
    "http://für.de/": "http://f%C3%BCr.de/",
    "/a?": "https://site.example.com/a?",
    "..": "https://site.example.com/",
    "/../../b": "https://site.example.com/b",
    "http://h:8a/": None,
    "http://[::1]:80/x": "http://[::1]:80/x",
    "http://a b/": None,
    "/a\tb": None,
    "HTTP://A/b#c": "http://a/b",
    "/that.": "https://site.example.com/that.",
}


def test_canonical_urls(one):
    got = one(lambda v: U.canonical_url(v, U.split_url(F.lit(BASE))), *CANONICAL)
    assert dict(zip(CANONICAL, got)) == CANONICAL


def test_plainly_canonical_urls_are_canonical(one):
    urls = ["https://h.example/", "http://h:80/a/b.html", "https://h/a/", "https://h", "https://H/a", "https://h/a//b", "https://h/a/.", "https://h/a?x"]
    plain = [u for u in urls if U.is_plainly_canonical(u)]
    assert plain == urls[:3]
    assert one(lambda v: U.canonical_url(v, U.split_url(v)), *plain) == plain


def test_very_long_path_does_not_overflow(one):
    path = "/a" * 200_000
    assert one(lambda v: U.canonical_url(v, U.split_url(F.lit(BASE))), path) == "https://site.example.com" + path


def test_link_type_counts_port_and_subdomain(one):
    def kind(v):
        base = U.split_url(F.lit("https://Site.example.com/"))
        return U.link_type(U.resolve(v, base), base)

    refs = ["/a", "https://SITE.example.com/x", "https://site.example.com:443/", "https://www.site.example.com/", "http:///x"]
    assert one(kind, *refs) == ["internal", "internal", "external", "external", "external"]


def test_extensions(one):
    urls = ["https://h/", "https://h/a", "https://h/a.HTML", "https://h/that.", "https://h/x.pdf", "https://h/x.d/y", "https://h/a%2Epdf"]
    assert one(U.extension_of, *urls) == ["", "", ".html", ".", ".pdf", "", ".pdf"]
    assert U.allowed_extensions() == ["", ".html", ".htm"]
    assert U.allowed_extensions(["PDF", " .x ", ""]) == ["", ".pdf", ".x"]


def test_export_paths(one):
    cases = {
        "https://h.example/": "h.example/index.md",
        "https://h.example/a/": "h.example/a.md",
        "https://h.example/a/b?x=1&y": "h.example/a/b__x-1-y.md",
        "https://h.example:80/f%C3%BCr/%20/z": "h.example-80/f-r/section/z.md",
        "https://h.example/a%2Fb": "h.example/a/b.md",
    }
    assert dict(zip(cases, one(U.export_path, *cases))) == cases


def test_entities(one):
    cases = {
        "&amp;lt;": "&lt;", "&amp": "&", "&am": "&am", "&#8364;": "€", "&#x20AC;": "€", "&#5": "&#5", "&#x": "&#x",
        "&#x;": "�", "&ampfoo": "&foo", "&notit;": "¬it;", "&#128;": "€", "&#xD800;": "�",
        "&#99999999999;": "�", "x&": "x&", "&frac12x": "½x", "&Eacute;&eacute": "Éé", "&nope;": "&nope;", "a & b": "a & b",
    }
    assert dict(zip(cases, one(decode_entities, *cases))) == cases


def test_spaces(one):
    assert one(T.trim_space, "   a　b \u0085\n") == "a　b"
    assert one(T.word_count, "", " \n ", "a", " a b\n c\x0bd ") == [0, 0, 1, 4]
    assert one(T.collapse_spaces, " a  \n b ") == "a b"


def test_hrefs(one):
    html = "<A class=x HREF='/a'><area href=/b><a data-href=\"/c\"><a title='>' href=/no><ahref=/d><a href=\"\"><a href=/e?x>"
    assert one(H.hrefs, html) == ["/a", "/b", "/c", "", "/e?x"]


def test_head_fields(one):
    html = (
        '<title>\n T &amp;amp; x </title><meta name="description" content=" D &quot;q&quot; ">'
        '<META http-equiv="Refresh" content="0; URL=/next?a=1&amp;b">'
    )
    assert one(H.title, html) == "T &amp; x"
    assert one(H.description, html) == 'D "q"'
    # The content is split at semicolons before it is decoded.
    assert one(H.refresh_target, html) == "/next?a=1&"
    assert one(H.refresh_target, '<meta http-equiv="refresh" content="5">') == ""


def test_visible_text(one):
    html = (
        "<div>\n <h1>Über  uns</h1><p>Text &amp; mehr<br> neu</p><script>x</script><!-- c --><ul>\n<li>eins</li>"
        "<li> zwei</li></ul><p>#tag</p><pre>a  b</pre></div>"
    )
    assert one(H.visible_text, html) == "# Über uns\n\nText & mehr\nneu\n\n- eins\n- zwei\n\n# tag\n\na b\n"
    assert one(H.visible_text, " \n<p></p>") == ""


def test_fallback_document(one):
    page = '<title>Bare Bed</title><meta name="description" content="Nothing sown here yet."><body></body>'
    assert one(H.fallback_document, page) == (
        "# Bare Bed\n\nNothing sown here yet.\n\nBare Bed\n"
    )
    assert one(H.fallback_document, "<p></p>") == "*No textual content extracted.*\n"


def test_markdown(one):
    html = (
        "<html><head><title>T</title></head><body><h1>Herbs</h1><ul><li><a href='/mint?a=1&amp;copy=2'>Garden  mint</a></li></ul>"
        "<p><a href='mailto:a@b'>mail</a></p><pre><code>sow\n  &lt;3></code></pre><p>end</p></body></html>"
    )
    got = one(lambda v: M.page_markdown(v, U.split_url(F.lit("https://example.test/start"))), html)
    assert got == (
        "# Herbs\n\n- [Garden mint](https://example.test/mint?a=1&copy=2)\n\nmail\n\n```\nsow\n  <3>\n```\n\nend"
    )
    assert one(lambda v: M.page_markdown(v, U.split_url(F.lit("https://e/"))), "<head><title>T</title></head><body></body>") == ""


def test_line_blocks(one):
    text = "\n  H1 \nH2\n\nbody\nx\n\nF1\n F2 \n\n"
    assert one(L.header_block, text) == "H1\nH2"
    assert one(L.footer_block, text) == "F1\nF2"
    assert one(L.header_block, "a\nb\nc\nd\ne\nf\ng") == "a\nb\nc\nd\ne\nf"
    assert one(L.footer_block, "a\nb\nc\nd\ne\nf\ng") == "b\nc\nd\ne\nf\ng"
    assert one(lambda v: L.drop_first_lines(v, F.lit(2)), text) == "body\nx\n\nF1\n F2"
    assert one(lambda v: L.drop_last_lines(v, F.lit(2)), text) == "H1 \nH2\n\nbody\nx"


def test_front_matter_hash(one):
    docs = ["---\nurl: x\n content_sha256:  abc \n---\n\nbody\n", "---\r\ncontent_sha256: d\r\n---\r\n", "content_sha256: x\n",
            "---\ncontent_sha256: x\n", "---\nurl: y\n---\n\ncontent_sha256: z\n"]
    assert one(M.front_matter_hash, *docs) == ["abc", "d", None, None, None]


def test_tags_that_never_end_take_linear_time(spark):
    import time

    functions = [H.visible_text, H.hrefs, H.title, H.description, H.refresh_target]
    for text in ("<", "<a ", "<script>", "<meta ", "<pre>", "<title>", "<!--"):
        page = spark.createDataFrame([(text * (1_000_000 // len(text)),)], "v string")
        for function in functions:
            started = time.perf_counter()
            page.select(F.length(function(F.col("v")).cast("string"))).first()
            assert time.perf_counter() - started < 15, (function.__name__, text)


def test_patterns_at_their_ends(one):
    assert P.drop_unseen("a<script>b</script>c<script>d") == "a c<script>d"
    assert P.drop_unseen("<SCRIPT x>b</Script ><i>é</script><!-- c --><!-- d") == " <!-- d".replace(" ", "  ", 1)
    assert one(H.hrefs, "<a <a href=x><b href=y><a>href=z<a b='>' href=\"q>r\" href=s><abbr href='t'") == ["x", "t"]
    assert one(H.title, "<title<title>a</title>b</title>") == "a" and one(H.title, "<title>a") == ""
    long = "<p>x</p>" * 800_000 + "<a href='/last'>"
    assert one(lambda v: F.element_at(H.hrefs(v), -1), long) == "/last"
