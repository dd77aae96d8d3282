"""Text and Markdown of single pages, against rules applied one by one and expectations spelled by hand."""

import random
import re
import time

from pyspark.sql import functions as F

from weftlink.functions import html as H
from weftlink.functions import markdown as M
from weftlink.functions import pagetext as P
from weftlink.functions import urls as U
from weftlink.functions.entities import decode_entities

PIECES = ["<", ">", "</", "<p", "<P>", "<br>", "<br ", "<li>", "</li>", "<link", "<h1>", "</h3 >", "<h2", "</h2>", "<script>", "</script>", "<style ", "</STYLE>", "<!--", "-->", "a", " ", "\n", "#", "-", "İ", "&amp;", "é", "<b>", "</div>"]


def one_by_one(html):
    """The rules of visible text as patterns, each over the whole page."""
    for tag in ("script", "style", "noscript", "template", "iframe"):
        html = re.sub(rf"(?isa)<{tag}[^>]*>.*?</{tag}>", " ", html)
    html = re.sub(r"(?s)<!--.*?-->", " ", html)
    for pattern, new in [(r"<br[^>]*>", "\n"), (r"<li[^>]*>", "\n- "), (r"</li>", "")]:
        html = re.sub(rf"(?isa){pattern}", new, html)
    for n in range(1, 7):
        html = re.sub(rf"(?isa)<h{n}[^>]*>", "\n\n" + "#" * n + " ", html)
    html = re.sub(r"(?isa)</h[1-6]>", "\n\n", html)
    block = "p|div|section|article|main|header|footer|address|blockquote|table|tr|tbody|thead|tfoot|ul|ol"
    html = re.sub(rf"(?isa)<({block})[^>]*>", "\n\n", html)
    html = re.sub(rf"(?isa)</({block})>", "\n\n", html)
    return re.sub(r"<[^>]+>", "", html)


def test_layout_equals_the_rules_one_by_one():
    rng = random.Random(8)
    for _ in range(30_000):
        html = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        assert P.strip_tags(P.drop_unseen(html)) == one_by_one(html), html


def test_plain_decoding_equals_the_columns(one):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["&", "#", "x", "X", ";", "amp", "lt", "not", "it", "0", "128", "20AC", "9", "frac12", "Eacute", "é", " ", "D800", "110000"]) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    assert [P.decode(t) for t in texts] == one(decode_entities, *texts)


def meta(html, attribute):
    m = re.search(rf"(?isa)<meta[^>]+{attribute}[^>]*content[\t\n\f\r ]*=[\t\n\f\r ]*['\"]([^'\"]+)['\"]", html)
    return m[1] if m else ""


def test_meta_fields_equal_the_pattern(one):
    rng = random.Random(10)
    parts = ["<meta ", "<META", "name='description'", 'property = "og:description"', "http-equiv=refresh", 'http-equiv="Refresh"', "content=", "content = ", "'", '"', ">", "a", " ", "=", "<p>", "x>y", "''", "</meta>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 16))) for _ in range(4000)]
    pages += ["<meta name='description' content='a > b'>", "<meta content='x' name='description'>", "<meta name='description' content='1' content='2'>", "<metaname='description'content='x'>", ""]
    for attribute in (H.DESCRIPTION, H.REFRESH):
        assert one(lambda v, a=attribute: H.meta_content(v, a), *pages) == [meta(p, attribute) for p in pages]


def markdown(one, *pages):
    return one(lambda v: M.page_markdown(v, U.split_url(F.lit("https://h.example/dir/page"))), *pages)


CASES = {
    "<p>one</p><p>two <b>bold</b>, <em> slanted </em>and <code>code</code></p>": "one\n\ntwo **bold**, *slanted* and `code`",
    "<p><b>open<br><p>next</b> x": "open\n\nnext x",
    "<b><i>both</i></b> <i><b>crossed</i></b><s>gone</s>": "***both*** *crossed*~~gone~~",
    "<b> </b><b></b>x<b>y": "xy",
    "<ol><li>a<li>b</ol><ol start=7><li>c</li></ol><ul><li>d</li></ul>": "1. a\n2. b\n\n7. c\n\n- d",
    "<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul>": "- a\n\n1. b\n\n- c",
    "<table><tr><th>k</th><th>v</th></tr><tr><td>a|b</td><td><a href=x>l</a> <br>m</td></tr></table>z": "| k | v |\n| --- | --- |\n| a\\|b | [l](https://h.example/dir/x) m |\n\nz",
    "<table><tr><td><div>a</div><p>b</p></td><td>c</td></tr></table>": "a\n\nb\n\nc",
    "<table><tr><td>never closed<p>x": "never closed\n\nx",
    "<a href='/a'><div>A</div><div>B</div></a>": "[A B](https://h.example/a)",
    "x<a href=y> l </a>z <a href='mailto:q@q'>mail</a> <a href=w></a>!": "x [l](https://h.example/dir/y) z mail !",
    "<a href=1>one <a href=2>two</a> <a name=n>three</a> <a href=4>open": "[one](https://h.example/dir/1) [two](https://h.example/dir/2) three open",
    "<b><a href=1>l</a></b> <a href=2><b>m</b> n</a>": "**[l](https://h.example/dir/1)** [**m** n](https://h.example/dir/2)",
    "<img src='/i.png' alt='A &amp; B'> <img alt=x><a href=t><img src=s alt=pic></a>": "![A & B](https://h.example/i.png) x[pic](https://h.example/dir/t)",
    "<pre>\n a\x01  <b>b</b>\n</pre>t<pre></pre>": "```\n a  b\n```\n\nt\n\n```\n\n```",
    "a<hr>b<span>c</span><td>d</td><dd>e<h2>  H<i>i</i></h2>f": "a\n\n---\n\nbc\n\nd\n\ne\n\n## H*i*\n\nf",
    "1 < 2 &lt;3 <4 a> <!-- c --><!-- open": "1 < 2 <3 <4 a> <!-- open",
    "<head><title>t</title></head>x<title>u</title><script>s</script><script>v": "x v",
    "<p\n class=x>n\x00ul</p><BR/>é": "nul\n\né",
}


def test_markdown_constructs(one):
    assert dict(zip(CASES, markdown(one, *CASES))) == CASES
    assert markdown(one, None, "") == [None, ""]


def test_words_are_never_glued():
    """Between words of different blocks, cells and items stands white space, whatever the tags."""
    rng = random.Random(12)
    blocks = ["p", "div", "li", "td", "th", "tr", "h2", "section", "dd", "figcaption", "option", "br", "table", "ul", "ol", "a href=x", "pre"]
    for _ in range(4000):
        html, words = "", []
        for k in range(rng.randint(1, 8)):
            words.append(f"w{k}w")
            tag = rng.choice(blocks)
            html += f"<{tag}>{words[-1]}" + (f"</{tag.split()[0]}>" if rng.random() < 0.7 else "")
        texts, links = P.markdown_parts(html)
        out = "".join(x for k, t in enumerate(texts) for x in (t, links[k][0] if k < len(links) else ""))
        if "<a" not in html:
            assert [w for w in re.findall(r"w\d+w", out)] == words, (html, out)
        assert not re.search(r"w\d+ww\d+w", re.sub(r"<a href=x>", "", out)) or "<a" in html, (html, out)


UNITS = ["<script ", "<pre>", "<a href=x>", "<b>", "<table>", "<td>", "<meta ", 'name="description" ', "<!--", "<", "<p ", "a=", "x-", "<li>", "&amp", "<b><i>", "<h1 ", "<ol start=1>"]


def test_pages_of_one_tag_take_linear_time():
    for unit in UNITS:
        many = unit * (500_000 // len(unit))
        for html in (many, many + ">", many + "</script>", many + "</pre></a></table>-->", many + "</b>" * 50_000, '<meta name="description" ' + many):
            started = time.perf_counter()
            P.visible(html)
            P.markdown_parts(html)
            assert time.perf_counter() - started < 8, (unit, html[-20:])


def test_head_fields_of_one_tag_take_linear_time(spark):
    texts = ["<meta ", 'name="description" ', "<meta content=", "<title>", ">", "'", '<meta name="description" content=']
    pages = spark.createDataFrame([(t * (500_000 // len(t)) + end,) for t in texts for end in ("", "'>")], "v string")
    started = time.perf_counter()
    pages.agg(*(F.max(F.length(f(F.col("v")))) for f in (H.description, H.refresh_target, H.title))).first()
    assert time.perf_counter() - started < 60
