"""Each registered query as one DuckDB statement over the same tables.

Written independently of the Spark code: inputs, URL rules and text rules are
spelled out again in SQL, as common table expressions put together below.
"""

from __future__ import annotations

# --- scalar rules -----------------------------------------------------------

SPACES = r"\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INLINE = SPACES.replace(r"\n", "")


def trim(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"


def decode(e: str) -> str:
    """Character references of this data; ``&amp;`` last, so that it counts once."""
    out = e
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·")):
        out = f"replace({out}, '&{name};', '{ch}')"
    return rf"regexp_replace({out}, '&amp;?', '&', 'g')"


def clean_path(e: str) -> str:
    """Single slashes, no dot segments (none go up in this data), escaped anew."""
    kept = f"list_filter(string_split(url_decode(replace({e}, '+', '%2B')), '/'), lambda s: s <> '' AND s <> '.')"
    path = f"('/' || array_to_string({kept}, '/') || CASE WHEN {e} LIKE '%_/' AND len({kept}) > 0 THEN '/' ELSE '' END)"
    out = f"url_encode({path})"
    for ch in "/:$&+,;=@":
        out = f"replace({out}, '%{ord(ch):02X}', '{ch}')"
    return out


SCHEME = r"regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"


def host(e: str) -> str:
    return rf"lower(regexp_extract({e}, '^[A-Za-z]+://([^/?#]*)', 1))"


def extension(e: str) -> str:
    return rf"lower(regexp_extract(url_decode(replace({path_of(e)}, '+', '%2B')), '(\.[^./]*)$', 1))"


def path_of(e: str) -> str:
    return rf"regexp_extract({e}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


def allowed_extension(e: str) -> str:
    return f"{extension(e)} IN ('', '.html', '.htm')"


def resolved(href: str, base: str) -> str:
    """Absolute text of a reference, its path not cleaned yet."""
    origin = rf"regexp_extract({base}, '^([A-Za-z]+://[^/?#]*)', 1)"
    scheme = rf"regexp_extract({base}, '^([A-Za-z]+):', 1)"
    directory = rf"regexp_replace({path_of(base)}, '[^/]*$', '')"
    no_fragment = f"split_part({href}, '#', 1)"
    query = rf"regexp_extract({base}, '\?[^#]*')"
    return f"""CASE
      WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {no_fragment}
      WHEN {href} LIKE '//%' THEN {scheme} || ':' || {no_fragment}
      WHEN {href} LIKE '/%' THEN {origin} || {no_fragment}
      WHEN {no_fragment} = '' THEN {origin} || {path_of(base)} || {query}
      WHEN {href} LIKE '?%' THEN {origin} || {path_of(base)} || {no_fragment}
      ELSE {origin} || {directory} || {no_fragment} END"""


def canonical(e: str) -> str:
    """Canonical form of an absolute http(s) URL without a fragment."""
    query = rf"regexp_extract({e}, '\?.*$')"
    return f"lower({SCHEME.format(e)}) || '://' || {host(e)} || {clean_path(path_of(e))} || {query}"


def escaped(e: str) -> str:
    """Resolved text with its path escaped but not cleaned."""
    out = f"url_encode({path_of(e)})"
    for ch in "/:$&+,;=@%!'()*[]":
        sql = "''" if ch == "'" else ch
        out = f"replace({out}, '%{ord(ch):02X}', '{sql}')"
    return rf"regexp_extract({e}, '^([A-Za-z]+://[^/?#]*)', 1) || {out} || regexp_extract({e}, '\?.*$')"


def segment(e: str) -> str:
    return f"trim(regexp_replace({e}, '[^A-Za-z0-9._-]', '-', 'g'), '-')"


def export_path(e: str) -> str:
    inner = f"trim(url_decode(replace({path_of(e)}, '+', '%2B')), '/')"
    part = f"CASE WHEN {segment('s')} = '' THEN 'section' ELSE {segment('s')} END"
    path = f"CASE WHEN {inner} = '' THEN 'index' ELSE array_to_string(list_transform(string_split({inner}, '/'), lambda s: {part}), '/') END"
    query = rf"regexp_extract({e}, '\?(.*)$', 1)"
    raw_host = rf"regexp_extract({e}, '^[A-Za-z]+://([^/?#]*)', 1)"
    return (
        f"{segment(raw_host)} || '/' || {path} || "
        f"CASE WHEN {query} = '' THEN '' ELSE '__' || {segment(query)} END || '.md'"
    )


def drop_unseen(e: str) -> str:
    out = e
    for tag in ("script", "style", "noscript", "template", "iframe"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"


BLOCKS = "p|div|section|article|main|header|footer|address|blockquote|table|tr|tbody|thead|tfoot|ul|ol"


def layout(e: str) -> str:
    steps = [("<br[^>]*>", "chr(10)"), ("<li[^>]*>", "chr(10) || '- '"), ("</li>", "''")]
    steps += [(f"<h{n}[^>]*>", f"chr(10) || chr(10) || '{'#' * n} '") for n in range(1, 7)]
    steps += [
        ("</h[1-6]>", "chr(10) || chr(10)"),
        (f"<({BLOCKS})[^>]*>", "chr(10) || chr(10)"),
        (f"</({BLOCKS})>", "chr(10) || chr(10)"),
        ("<[^>]+>", "''"),
    ]
    out = e
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, '(?is){pattern}', {replacement}, 'g')"
    return decode(out)


def tidy(e: str) -> str:
    """Line by line: trim, collapse, space after heading marks; then blank runs."""
    line = rf"trim(regexp_replace(l, '[{INLINE}]+', ' ', 'g'))"
    marked = rf"regexp_replace({line}, '^(#+)([^# ])', '\1 \2')"
    lines = f"array_to_string(list_transform(string_split({e}, chr(10)), lambda l: {marked}), chr(10))"
    return trim(rf"regexp_replace({lines}, '\n\n\n+', chr(10) || chr(10), 'g')")


def visible(e: str) -> str:
    return tidy(layout(drop_unseen(e)))


# --- inputs -----------------------------------------------------------------

# The link pattern, and the tag patterns and phrases above and below.
HREF = r"""(?i)<a[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""


def suffix(i: str) -> str:
    return f"CASE WHEN ({i}) % 11 = 10 THEN '.pdf' WHEN ({i}) % 4 = 1 THEN '.html' WHEN ({i}) % 4 = 2 THEN '/' ELSE '' END"


SITE = f"""site AS (
  SELECT page_id, 'https://site.example.com/p/' || page_id || {suffix('page_id')} AS url,
    CASE WHEN page_id % 17 = 16 THEN 404 WHEN page_id % 29 = 28 THEN 500 ELSE 200 END AS status,
    html || '<a href="/p/' || (2 * page_id + 1) || {suffix('2 * page_id + 1')} || '">left</a>'
      || '<a class=x HREF=''//SITE.example.com/p//' || (2 * page_id + 2) || {suffix('2 * page_id + 2')} || '#f''>right</a>'
      || '<a href=/p/0>home</a>'
      || '<a href="https://ext' || (page_id % 5) || '.example.org/x?i=' || (page_id % 7) || '">out</a>'
      || '<a href="mailto:a@b.c">mail</a>' AS html,
    page_id % 400 AS retrieved_ms,
    TIMESTAMP '2024-01-01' + to_seconds(page_id) AS fetched_at
  FROM pages)"""

SITE_META = f"""{SITE}, site_meta AS (
  SELECT page_id, url, status, retrieved_ms, fetched_at, CASE page_id % 10
    WHEN 0 THEN '<meta http-equiv="refresh" content="0; url=/p/' || (page_id + 3) || '">' || html
    WHEN 1 THEN '<meta name="description" content="About ' || page_id || ' &amp; more">' || html
    WHEN 2 THEN '<!doctype html><html><head><title>Empty ' || page_id
      || '</title><meta name="description" content="Nothing on ' || page_id || '."></head><body></body></html>'
    ELSE html END AS html
  FROM site)"""

EXT_SNAPSHOT = """ext_snapshot AS (
  SELECT DISTINCT 'https://ext' || (page_id % 5) || '.example.org/x?i=' || (page_id % 7) AS url,
    CASE WHEN ((page_id % 5) * (page_id % 7)) % 5 = 4 THEN 404 ELSE 200 END AS status
  FROM pages WHERE (page_id % 5 + page_id % 7) % 6 <> 5)"""

PRIOR_VISITED = """prior_visited AS (
  SELECT url, status, CASE WHEN status >= 400 THEN 'status ' || status ELSE '' END AS error, fetched_at AS last_visited
  FROM site WHERE page_id % 6 = 5)"""

BP = f"""bp AS (
  SELECT {host('url')} AS host, page_id AS ord,
    CASE WHEN page_id % 7 = 6 THEN '' ELSE 'Header ' || {host('url')} || chr(10) || 'Home' || chr(10) || chr(10) END
      || 'Page ' || page_id || chr(10) || 'body ' || page_id || chr(10) || chr(10) || 'Footer ' || {host('url')} AS text
  FROM pages)"""

PROBES = """probes AS (
  SELECT ts, 'https://svc' || (user_id % 10) || '.example.com/' AS url,
    CASE WHEN event_id % 23 = 0 THEN 503 ELSE 200 END AS status, event_id % 500 AS duration_ms
  FROM events)"""

PAGE_SAVES = """page_saves AS (
  SELECT 'https://site.example.com/u/' || (user_id % 50) AS url, event_id AS seq,
    CASE WHEN event_id % 3 = 0 THEN 200 ELSE 0 END AS status,
    CASE WHEN event_id % 5 = 0 THEN 'status 404' ELSE '' END AS error,
    CASE WHEN event_id % 9 = 0 THEN ['/l/' || event_id, '/l'] ELSE [] END AS links,
    CASE WHEN event_id % 4 = 0 THEN event_id % 400 ELSE 0 END::BIGINT AS retrieved_ms,
    CASE WHEN event_id % 7 = 0 THEN '/m/' || event_id ELSE '' END AS markdown_path,
    CASE WHEN event_id % 11 = 0 THEN 'unchanged content' ELSE '' END AS skip_reason
  FROM events)"""


def href_rows(source: str) -> str:
    """``found(page_url, pos, raw)`` of ``source(url, html)``."""
    return f"""matched AS (SELECT url, regexp_extract_all(html, '{HREF}', 1) AS m FROM {source}),
found AS (SELECT url AS page_url, (generate_subscripts(m, 1) - 1)::INT AS pos,
  regexp_replace(unnest(m), '^["'']|["'']$', '', 'g') AS raw FROM matched)"""


FOLLOWABLE = "href <> '' AND href <> '#' AND NOT regexp_matches(href, '(?i)^(javascript|mailto|tel):')"
CLEANED = f"cleaned AS (SELECT * FROM (SELECT page_url, pos, {decode(trim('raw'))} AS href FROM found) WHERE {FOLLOWABLE})"


def classified(source: str) -> str:
    """``classified(page_url, pos, href, link_url, link_type)``."""
    return f"""{href_rows(source)}, {CLEANED},
absolute AS (SELECT *, {resolved('href', 'page_url')} AS target FROM cleaned),
classified AS (SELECT page_url, pos, href, {canonical('target')} AS link_url,
  CASE WHEN {host('target')} = {host('page_url')} THEN 'internal' ELSE 'external' END AS link_type
  FROM absolute WHERE regexp_matches(target, '^https?://'))"""


def distinct_links(source: str) -> str:
    """``listed(page_url, pos, link_url, link_type)``: first occurrence per page, renumbered."""
    return f"""{classified(source)},
firsts AS (SELECT page_url, link_url, min(pos) AS p, arg_min(link_type, pos) AS link_type
  FROM classified GROUP BY page_url, link_url),
listed AS (SELECT page_url, (row_number() OVER (PARTITION BY page_url ORDER BY p) - 1)::INT AS pos, link_url, link_type
  FROM firsts)"""


START = "https://site.example.com/p/0"
REFRESH = r"""(?is)<meta[^>]+http-equiv\s*=\s*[''"]refresh[''"][^>]*content\s*=\s*[''"]([^''"]+)[''"]"""
REFRESH_URL = rf"regexp_extract(regexp_extract(html, '{REFRESH}', 1), '(?i)^(?:.*;)?\s*url=([^;]*)', 1)"
DESCRIPTION = r"""(?is)<meta[^>]+(?:name|property)\s*=\s*[''"](?:description|og:description)[''"][^>]*content\s*=\s*[''"]([^''"]+)[''"]"""
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def refreshed_links(source: str) -> str:
    """``linked``: listed links plus the refresh target where it is new."""
    return f"""{distinct_links(source)},
targets AS (SELECT url AS page_url, {canonical(resolved('t', f"'{START}'"))} AS link_url
  FROM (SELECT url, {REFRESH_URL} AS t FROM {source}) WHERE t <> ''),
linked AS (SELECT * FROM listed UNION ALL
  SELECT t.page_url, (SELECT count(*) FROM listed l WHERE l.page_url = t.page_url)::INT, t.link_url,
    CASE WHEN {host('t.link_url')} = 'site.example.com' THEN 'internal' ELSE 'external' END
  FROM targets t WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.page_url = t.page_url AND l.link_url = t.link_url))"""


ORACLE: dict[str, str] = {}

# --- links of pages ---------------------------------------------------------

ORACLE["hrefs"] = f"WITH {href_rows('pages')} SELECT page_url, pos, raw AS href FROM found"
ORACLE["hrefs_clean"] = f"WITH {href_rows('pages')}, {CLEANED} SELECT page_url, pos, href FROM cleaned"
ORACLE["links_resolved"] = f"""WITH {href_rows('pages')}, {CLEANED}
SELECT page_url, pos, href, {escaped('target')} AS resolved
FROM (SELECT *, {resolved('href', 'page_url')} AS target FROM cleaned)"""
ORACLE["links_classified"] = f"WITH {SITE}, {classified('site')} SELECT * FROM classified"


def spellings(source: str) -> str:
    return f"""{href_rows(source)}, {CLEANED},
spelled AS (SELECT page_url, href AS raw FROM cleaned UNION ALL SELECT url, url FROM {source}),
spelling AS (SELECT page_url, raw, {canonical('target')} AS canonical
  FROM (SELECT *, {resolved('raw', 'page_url')} AS target FROM spelled) WHERE regexp_matches(target, '^https?://'))"""


ORACLE["canonical_urls"] = f"WITH {spellings('pages')} SELECT page_url, raw, canonical FROM spelling"
ORACLE["canonical_dups"] = f"""WITH {SITE}, {spellings('site')}
SELECT canonical, count(DISTINCT raw) AS spellings, count(*) AS occurrences FROM spelling GROUP BY canonical"""
ORACLE["page_links"] = f"WITH {SITE}, {distinct_links('site')} SELECT * FROM listed"
ORACLE["link_type_counts"] = f"""WITH {distinct_links('pages')}
SELECT page_url, count(*) FILTER (link_type = 'internal') AS internal_links,
  count(*) FILTER (link_type = 'external') AS external_links FROM listed GROUP BY page_url"""
ORACLE["extension_filter"] = f"""WITH {distinct_links('pages')}
SELECT page_url, link_url, {extension('link_url')} AS extension, {allowed_extension('link_url')} AS allowed FROM listed"""
ORACLE["meta_refresh"] = f"WITH {SITE_META} SELECT url, {REFRESH_URL} AS target FROM site_meta"
ORACLE["links_with_refresh"] = f"WITH {SITE_META}, {refreshed_links('site_meta')} SELECT * FROM linked"
ORACLE["start_url_check"] = r"""WITH bare AS (SELECT url, regexp_replace(url, '^[a-z]+://', '') AS b FROM pages),
urls AS (SELECT url FROM bare UNION SELECT '//' || b FROM bare UNION SELECT 'ftp://' || b FROM bare
  UNION SELECT '/' || b FROM bare UNION SELECT '')
SELECT url, CASE WHEN regexp_matches(url, '^https?://') THEN url WHEN url LIKE '//%' THEN 'https:' || url ELSE '' END AS start_url,
  CASE WHEN url = '' THEN 'start URL is required' WHEN url LIKE 'ftp:%' THEN 'unsupported scheme "ftp"'
    WHEN regexp_matches(url, '^/[^/]') THEN 'start URL must include a host' ELSE '' END AS reason
FROM urls"""

# --- page text --------------------------------------------------------------

ORACLE["page_titles"] = f"SELECT page_id, {trim(decode(TITLE))} AS title FROM pages"
ORACLE["decoded_titles"] = f"SELECT page_id, {TITLE} AS raw, {decode(trim(TITLE))} AS decoded FROM pages"
ORACLE["page_descriptions"] = f"""WITH {SITE_META}
SELECT url, {trim(decode(f"regexp_extract(html, '{DESCRIPTION}', 1)"))} AS description FROM site_meta"""
TEXTS = f"texts AS (SELECT page_id, {visible('html')} || chr(10) AS text FROM pages)"
ORACLE["visible_text"] = f"WITH {TEXTS} SELECT page_id, text FROM texts"
ORACLE["word_counts"] = rf"""WITH {TEXTS}
SELECT page_id, len(regexp_extract_all(text, '[^{SPACES}]+')) AS words FROM texts"""
ORACLE["content_hash"] = f"WITH {TEXTS} SELECT page_id, sha256(text) AS content_sha256 FROM texts"
ORACLE["fallback_document"] = f"""WITH {SITE_META}, parts AS (
  SELECT url, {trim(decode(TITLE))} AS title, {REFRESH_URL} AS target, {visible('html')} AS text,
    {trim(decode(f"regexp_extract(html, '{DESCRIPTION}', 1)"))} AS description FROM site_meta)
SELECT url, CASE WHEN title = '' THEN '' ELSE '# ' || title || chr(10) || chr(10) END
  || CASE WHEN description = '' THEN '' ELSE description || chr(10) || chr(10) END
  || CASE WHEN target = '' THEN '' ELSE 'Meta refresh redirect target: ' || target || chr(10) || chr(10) END
  || CASE WHEN text = '' THEN '*No textual content extracted.*' ELSE text END || chr(10) AS document
FROM parts"""

# --- Markdown and export ----------------------------------------------------

ANCHOR = r"(?is)<a(?:[\t\n\f\r ][^>]*)?>.*?</a>"
NO_HEAD = rf"regexp_replace({drop_unseen('html')}, '(?is)<head(?:[\t\n\f\r ][^>]*)?>.*?</head>|<title[^>]*>.*?</title>', ' ', 'g')"


def markdown(source: str) -> str:
    """``md(url, markdown)``; this data has no preformatted blocks."""
    label = rf"trim(regexp_replace(regexp_replace(a, '(?is)<[^>]+>', '', 'g'), '[{SPACES}]+', ' ', 'g'))"
    raw = rf"regexp_replace(regexp_extract(a, '{HREF}', 1), '^[\"'']|[\"'']$', '', 'g')"
    return rf"""headless AS (SELECT url, {NO_HEAD} AS h FROM {source}),
anchors AS (SELECT url, unnest(regexp_extract_all(h, '{ANCHOR}')) AS a,
  generate_subscripts(regexp_extract_all(h, '{ANCHOR}'), 1) AS n FROM headless),
hrefs_of AS (SELECT url, n, {label} AS label, {decode(trim(raw))} AS href FROM anchors),
targets_of AS (SELECT *, CASE WHEN {FOLLOWABLE} THEN {resolved('href', 'url')} END AS target FROM hrefs_of),
written AS (SELECT url, n, CASE WHEN label = '' OR target IS NULL OR NOT regexp_matches(target, '^https?://') THEN label
  ELSE '[' || label || '](' || replace(replace({canonical('target')}, '&', '&amp;'), '<', '&lt;') || ')' END AS link
  FROM targets_of),
pieces AS (SELECT url, unnest(string_split_regex(h, '{ANCHOR}')) AS piece,
  generate_subscripts(string_split_regex(h, '{ANCHOR}'), 1) AS n FROM headless),
relinked AS (SELECT p.url, string_agg(piece || coalesce(link, ''), '' ORDER BY p.n) AS h
  FROM pieces p LEFT JOIN written w ON w.url = p.url AND w.n = p.n GROUP BY p.url),
md AS (SELECT url, {tidy(layout('h'))} AS markdown FROM relinked)"""


ORACLE["page_markdown"] = f"WITH {SITE}, {markdown('site')} SELECT url, markdown FROM md"
SELF = f"(SELECT url, {canonical(resolved('url', 'url'))} AS c FROM pages)"
ORACLE["export_paths"] = f"SELECT url, {export_path('c')} AS path FROM {SELF}"
ORACLE["export_path_collisions"] = f"""WITH {SITE}, {distinct_links('site')},
paths AS (SELECT {export_path('link_url')} AS path FROM (SELECT DISTINCT link_url FROM listed WHERE link_type = 'internal'))
SELECT path, count(*) AS pages FROM paths GROUP BY path HAVING count(*) > 1"""


def block(e: str, footer: bool = False) -> str:
    """First (last) block of up to six trimmed lines of a text."""
    lines = f"list_transform(string_split({trim(e)}, chr(10)), lambda l: {trim('l')})"
    if footer:
        lines = f"list_reverse({lines})"
    stop = f"coalesce(nullif(list_position({lines}, ''), 0), len({lines}) + 1) - 1"
    kept = f"{lines}[1:least(6, {stop})]"
    return f"array_to_string({f'list_reverse({kept})' if footer else kept}, chr(10))"


def boilerplate(source: str) -> str:
    """``ruled(host, header, header_at, footer, footer_at)`` of ``source(host, ord, text)``.

    A fold over each host's pages in order, one recursion step per page.
    """

    def side(name: str, test: str) -> str:
        return f"""CASE WHEN f.{name}_at IS NULL AND NOT {test} THEN b.{name} ELSE f.{name} END AS {name},
    CASE WHEN f.{name}_at IS NOT NULL THEN f.{name}_n WHEN {test} THEN f.{name}_n + 1 ELSE 0 END AS {name}_n,
    CASE WHEN f.{name}_at IS NOT NULL THEN f.{name}_at WHEN {test} AND f.{name}_n = 2 THEN b.ord END AS {name}_at"""

    starts = "starts_with(b.header || chr(10), f.header || chr(10))"
    ends = "ends_with(chr(10) || b.footer, chr(10) || f.footer)"
    return f"""blocks AS MATERIALIZED (SELECT host, ord, {block('text')} AS header, {block('text', True)} AS footer,
  row_number() OVER (PARTITION BY host ORDER BY ord) AS rn FROM {source} WHERE text <> ''),
fold AS (SELECT host, rn, header, 0 AS header_n, NULL::BIGINT AS header_at, footer, 0 AS footer_n, NULL::BIGINT AS footer_at
  FROM blocks WHERE rn = 1
  UNION ALL SELECT b.host, b.rn, {side('header', starts)}, {side('footer', ends)}
  FROM fold f JOIN blocks b ON b.host = f.host AND b.rn = f.rn + 1),
ruled AS (SELECT host, CASE WHEN header_at IS NULL THEN '' ELSE header END AS header, coalesce(header_at, -1) AS header_at,
  CASE WHEN footer_at IS NULL THEN '' ELSE footer END AS footer, coalesce(footer_at, -1) AS footer_at
  FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY host ORDER BY rn DESC) = 1)
  WHERE header_at IS NOT NULL OR footer_at IS NOT NULL)"""


def stripped(source: str) -> str:
    """``bare(host, ord, text)`` of ``source`` after ``ruled`` is known."""
    lines = "string_split(t, chr(10))"
    count = "len(string_split({0}, chr(10)))"
    cut_header = f"array_to_string({lines}[{count.format('header')} + 1:], chr(10))"
    cut_footer = f"array_to_string(string_split(r, chr(10))[1:len(string_split(r, chr(10))) - {count.format('footer')}], chr(10))"
    return f"""paged AS (SELECT s.host, s.ord, s.text, {trim('s.text')} AS t, r.header, r.header_at, r.footer, r.footer_at
  FROM {source} s LEFT JOIN ruled r ON r.host = s.host),
headed AS (SELECT *, CASE WHEN header <> '' AND ord >= header_at
    AND starts_with({block('t')} || chr(10), header || chr(10)) THEN {trim(cut_header)} ELSE t END AS r FROM paged),
footed AS (SELECT *, CASE WHEN footer <> '' AND ord >= footer_at AND r <> ''
    AND ends_with(chr(10) || {block('r', True)}, chr(10) || footer) THEN {trim(cut_footer)} ELSE r END AS u FROM headed),
bare AS (SELECT host, ord, CASE WHEN u = '' THEN text ELSE u END AS text FROM footed)"""


ORACLE["header_candidates"] = f"""WITH {BP}, b AS (SELECT host, ord, {block('text')} AS header FROM bp)
SELECT host, ord, header, len(string_split(header, chr(10)))::INT AS lines FROM b"""
ORACLE["footer_candidates"] = f"""WITH {BP}, b AS (SELECT host, ord, {block('text', True)} AS footer FROM bp)
SELECT host, ord, footer, len(string_split(footer, chr(10)))::INT AS lines FROM b"""
ORACLE["boilerplate_rules"] = f"WITH RECURSIVE {BP}, {boilerplate('bp')} SELECT * FROM ruled"
ORACLE["boilerplate_stripped"] = f"WITH RECURSIVE {BP}, {boilerplate('bp')}, {stripped('bp')} SELECT * FROM bare"
ORACLE["stream_boilerplate"] = ORACLE["boilerplate_stripped"]

EXPORT_TEXTS = f"""{SITE}, {markdown('site')},
source AS (SELECT {host('s.url')} AS host, s.page_id AS ord, markdown AS text, s.url
  FROM site s JOIN md ON md.url = s.url),
{boilerplate('source')}, {stripped('source')},
texts AS (SELECT s.page_id, s.url, CASE WHEN m.text = '' THEN '' ELSE b.text END AS text
  FROM site s JOIN source m ON m.url = s.url JOIN bare b ON b.ord = s.page_id)"""
ORACLE["markdown_export"] = rf"""WITH RECURSIVE {EXPORT_TEXTS}, {refreshed_links('site')},
counts AS (SELECT page_url, count(*) FILTER (link_type = 'internal') AS i, count(*) FILTER (link_type = 'external') AS e
  FROM linked GROUP BY page_url),
docs AS (SELECT {host('s.url')} AS host, {export_path('s.url')} AS path, s.page_id, s.url, sha256(text) AS content_sha256,
    len(regexp_extract_all(text, '[^{SPACES}]+')) AS word_count, coalesce(i, 0) AS internal_links, coalesce(e, 0) AS external_links,
    status, retrieved_ms, fetched_at, text
  FROM site s JOIN texts t ON t.page_id = s.page_id LEFT JOIN counts c ON c.page_url = s.url)
SELECT host, path, url, content_sha256, word_count, internal_links, external_links,
  '---' || chr(10) || 'url: ' || url || chr(10) || 'status: ' || status || chr(10) || 'retrieved_ms: ' || retrieved_ms || chr(10)
  || 'fetched_at: ' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'content_sha256: ' || content_sha256 || chr(10)
  || 'word_count: ' || word_count || chr(10) || 'internal_links: ' || internal_links || chr(10)
  || 'external_links: ' || external_links || chr(10)
  || CASE WHEN status >= 400 THEN 'error: "status ' || status || '"' || chr(10) ELSE '' END
  || '---' || chr(10) || chr(10) || text || chr(10) AS content
FROM docs QUALIFY row_number() OVER (PARTITION BY path ORDER BY page_id DESC) = 1"""
ORACLE["export_unchanged"] = f"""WITH RECURSIVE {EXPORT_TEXTS}
SELECT url, {export_path('url')} AS path, sha256(text) AS content_sha256,
  CASE WHEN page_id % 24 = 5 THEN 'unchanged content' ELSE '' END AS skip_reason FROM texts"""
ORACLE["frontmatter_hash"] = f"""WITH {SITE}
SELECT {export_path('url')} AS path, sha256({visible('html')} || chr(10)) AS content_sha256
FROM site WHERE page_id % 5 IN (0, 1)"""

# --- sources ----------------------------------------------------------------

ORACLE["snapshot_canonical"] = f"""WITH {SITE}, raws AS (
  SELECT url AS raw, status, retrieved_ms, fetched_at FROM site
  UNION ALL SELECT 'HTTPS://SITE.example.com' || substr(url, 25) || '#top', 203, retrieved_ms,
    fetched_at + (CASE WHEN page_id % 6 = 0 THEN -1 ELSE 1 END) * INTERVAL 1 HOUR FROM site WHERE page_id % 3 = 0),
spelled AS (SELECT *, {resolved('raw', 'raw')} AS target FROM raws)
SELECT {canonical('target')} AS url, status, retrieved_ms, fetched_at FROM spelled
QUALIFY row_number() OVER (PARTITION BY {canonical('target')} ORDER BY fetched_at DESC) = 1"""
ORACLE["snapshot_fetch"] = f"""WITH {SITE}, {distinct_links('site')},
wanted AS (SELECT DISTINCT link_url AS url FROM listed WHERE link_type = 'internal')
SELECT w.url, coalesce(status, 0) AS status, CASE WHEN status IS NULL THEN 'no response' ELSE '' END AS error,
  coalesce(length(html), 0) AS body_chars
FROM wanted w LEFT JOIN site s ON s.url = w.url"""
ORACLE["url_list"] = r"""WITH lines AS (SELECT CASE WHEN page_id % 7 = 6 THEN '' WHEN page_id % 5 = 4 THEN '# c'
    WHEN page_id % 3 = 0 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END AS line FROM pages)
SELECT CASE WHEN contains(line, '://') THEN line ELSE 'https://' || line END AS url
FROM lines WHERE line <> '' AND line NOT LIKE '#%'"""
ORACLE["visited_load"] = f"WITH {SITE}, {PRIOR_VISITED} SELECT * FROM prior_visited"
ORACLE["visited_upsert"] = f"""WITH {SITE}, {PRIOR_VISITED}, {PAGE_SAVES},
every AS (SELECT * FROM prior_visited UNION ALL
  SELECT url, status, error, TIMESTAMP '2024-01-01' + to_seconds(seq) FROM page_saves)
SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY url ORDER BY last_visited DESC) = 1"""
ORACLE["cache_skip"] = f"WITH {SITE} SELECT url FROM site WHERE page_id % 6 <> 5"
ORACLE["cache_skip_export"] = f"WITH {SITE} SELECT url FROM site WHERE page_id % 12 <> 5"

# --- checks and reports -----------------------------------------------------


def errors(source: str) -> str:
    """Error rows of ``source(source, target, status)``, NULL status for no response."""
    return f"""SELECT source, target, CASE WHEN status IS NULL THEN 'request' ELSE 'http' END AS type,
  CASE WHEN status IS NULL THEN 'no response' ELSE 'status ' || status END AS message, coalesce(status, 0) AS status
FROM {source} WHERE status IS NULL OR status >= 400"""


ORACLE["broken_links"] = f"""WITH {SITE}, {distinct_links('site')},
checked AS (SELECT page_url AS source, link_url AS target, status FROM listed l LEFT JOIN site s ON s.url = l.link_url
  WHERE link_type = 'internal')
{errors('checked')}"""
ORACLE["page_report_merge"] = f"""WITH {PAGE_SAVES}, merged AS (SELECT url,
  coalesce(arg_max(status, seq) FILTER (status <> 0), 0) AS status,
  coalesce(arg_max(error, seq) FILTER (error <> ''), '') AS error,
  coalesce(arg_max(links, seq) FILTER (len(links) > 0), []) AS links,
  coalesce(arg_max(retrieved_ms, seq) FILTER (retrieved_ms <> 0), 0) AS retrieved_ms,
  coalesce(arg_max(markdown_path, seq) FILTER (markdown_path <> ''), '') AS markdown_path,
  coalesce(arg_max(skip_reason, seq) FILTER (skip_reason <> ''), '') AS skip_reason
FROM page_saves GROUP BY url)
SELECT url, status, error, links, retrieved_ms, markdown_path, CASE WHEN markdown_path <> '' THEN '' ELSE skip_reason END AS skip_reason FROM merged"""
PER_URL = f"""{PROBES}, per_url AS (SELECT url, CASE WHEN count(*) FILTER (status >= 400) > 0 THEN 'fail' ELSE 'pass' END AS status,
  sum(duration_ms)::BIGINT AS duration_ms, count(*) AS pages_visited, count(*) FILTER (status >= 400) AS failures,
  coalesce(string_agg(DISTINCT 'status ' || status, chr(10) ORDER BY 'status ' || status) FILTER (status >= 400), '') AS errors
FROM probes GROUP BY url)"""
ORACLE["health_per_url"] = f"WITH {PER_URL} SELECT * FROM per_url"
ORACLE["health_batch"] = f"""WITH {PER_URL} SELECT CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status,
  count(*) AS urls, count(*) FILTER (status = 'fail') AS failed FROM per_url"""
ORACLE["health_json"] = f"""WITH {PER_URL} SELECT url, '{{"url":"' || url || '","status":"' || status || '","duration_ms":'
  || duration_ms || ',"pages_visited":' || pages_visited || CASE WHEN errors = '' THEN '' ELSE ',"errors":[' ||
  array_to_string(list_transform(string_split(errors, chr(10)), lambda m: '{{"message":"' || m || '"}}'), ',') || ']' END || '}}' AS result
FROM per_url"""
ORACLE["health_windows"] = f"""WITH {PROBES}, windows AS (SELECT date_trunc('hour', ts) AS window_start,
  CASE WHEN count(*) FILTER (status >= 400) > 0 THEN 'fail' ELSE 'pass' END AS status,
  count(*) AS probes, count(*) FILTER (status >= 400) AS failures FROM probes GROUP BY 1)
SELECT *, coalesce(window_start <= (SELECT min(window_start) FROM windows WHERE status = 'fail'), true) AS reached FROM windows"""
ORACLE["fetch_batches"] = f"""WITH {SITE}, slots AS (SELECT url, {host('url')} AS host, page_id AS ord,
  row_number() OVER (ORDER BY page_id) AS slot FROM site)
SELECT *, greatest(slot - 8, 0) * 1.0::DOUBLE AS at_second, (greatest(slot - 8, 0) // 60)::BIGINT AS batch FROM slots"""

# --- robots -----------------------------------------------------------------

ROBOTS = rf"""hosts AS (SELECT {host('url')} AS host, count(*) AS n, min(page_id) AS i FROM pages GROUP BY 1),
robots_txt AS (
  SELECT host, CASE WHEN i % 7 = 6 THEN 404 ELSE 200 END AS status, '# robots of ' || host ||
    E'\nUser-agent: *\nUser-agent: Slow-Bot\nDisallow: /en/\nAllow: /en/' || n ||
    E'\nDisallow:\nUser-agent: weftlink-bot/1.0\nDisallow: /de/*' || i || E'\nAllow: fr\n\nDisallow: /lost\nSitemap: /s.xml\n' AS body
  FROM hosts
  UNION ALL SELECT 'site.example.com', 200,
    E'User-agent: *\nDisallow: /p/7\nAllow: /p/70\n\nUser-agent: other-bot\nDisallow: /\n# end\nDisallow: /orphan\n'
  UNION ALL SELECT 'ext0.example.org', 200, E'User-agent: weftlink-bot\nDisallow: /\n'
  UNION ALL SELECT 'ext1.example.org', 404, E'User-agent: weftlink-bot\nDisallow: /\n'),
robots_lines AS (SELECT host, generate_subscripts(l, 1) AS n, trim(split_part(unnest(l), '#', 1)) AS text
  FROM (SELECT host, string_split(body, chr(10)) AS l FROM robots_txt WHERE status < 400)),
fields AS (SELECT host, n, text, lower(trim(split_part(text, ':', 1))) AS field,
  trim(substr(text, instr(text, ':') + 1)) AS value FROM robots_lines),
sections AS (SELECT *, count(*) FILTER (text = '') OVER (PARTITION BY host ORDER BY n) AS section FROM fields),
steps AS (SELECT *, coalesce(lag(field) OVER (PARTITION BY host, section ORDER BY n), '') AS before FROM sections
  WHERE field IN ('user-agent', 'allow') OR (field = 'disallow' AND value <> '')),
grouped AS (SELECT *, count(*) FILTER (field = 'user-agent' AND before <> 'user-agent')
  OVER (PARTITION BY host, section ORDER BY n) AS g FROM steps),
rules AS (SELECT a.host, a.agent, r.field AS kind,
    CASE WHEN r.value = '' THEN '' WHEN replace(r.value, '*', '') LIKE '/%' THEN replace(r.value, '*', '')
      ELSE '/' || replace(r.value, '*', '') END AS rule
  FROM (SELECT DISTINCT host, section, g, lower(value) AS agent FROM grouped WHERE field = 'user-agent') a
  JOIN grouped r ON r.host = a.host AND r.section = a.section AND r.g = a.g AND r.field <> 'user-agent'),
bound AS (SELECT host, agent, kind, rule FROM rules WHERE agent IN ('weftlink-bot', 'weftlink-bot/1.0', '*')
  QUALIFY dense_rank() OVER (PARTITION BY host
    ORDER BY CASE agent WHEN 'weftlink-bot' THEN 0 WHEN 'weftlink-bot/1.0' THEN 1 ELSE 2 END) = 1)"""


def judged(source: str, name: str) -> str:
    """``name(url, allowed)`` of the distinct ``url`` of ``source``."""
    path = f"CASE WHEN {path_of('u.url')} = '' THEN '/' ELSE {path_of('u.url')} END"
    hit = f"b.host = {host('u.url')} AND b.rule <> '' AND starts_with({path}, b.rule)"
    return f"""{name} AS (SELECT u.url, coalesce(max(length(rule)) FILTER (kind = 'disallow'), 0) = 0
    OR coalesce(max(length(rule)) FILTER (kind = 'allow'), 0) >= max(length(rule)) FILTER (kind = 'disallow') AS allowed
  FROM (SELECT DISTINCT url FROM {source}) u LEFT JOIN bound b ON {hit} GROUP BY u.url)"""


ORACLE["robots_rules"] = f"WITH {ROBOTS} SELECT * FROM rules"
ORACLE["robots_agent_rules"] = f"WITH {ROBOTS} SELECT * FROM bound"
ORACLE["robots_allowed"] = f"""WITH {SITE}, {distinct_links('site')}, {ROBOTS},
urls AS (SELECT url FROM pages UNION SELECT link_url FROM listed), {judged('urls', 'verdicts')}
SELECT * FROM verdicts"""

# --- crawl ------------------------------------------------------------------


def crawl(robots: bool = False, cache: bool = False, pages: int = 0, depth: int = -1, inputs: str = SITE) -> str:
    """``admitted(url, depth, key, allowed)`` of a run from the start page.

    ``key`` spells the link positions that lead to a page, so that within a
    depth it sorts like the breadth-first order.
    """
    rules = f"{ROBOTS}, " if robots else ""
    verdicts = judged("linked_urls", "verdicts") if robots else "verdicts AS (SELECT DISTINCT url, true AS allowed FROM linked_urls)"
    not_cached = f"AND link_url NOT IN (SELECT url FROM prior_visited WHERE url <> '{START}')" if cache else ""
    prior = f"{PRIOR_VISITED}, " if cache else ""
    deep = f"WHERE depth <= {depth}" if depth >= 0 else ""
    cap = f"QUALIFY row_number() OVER (ORDER BY depth, key) <= {pages}" if pages else ""
    return f"""{inputs}, {rules}{prior}{refreshed_links('site')},
linked_urls AS (SELECT '{START}' AS url UNION SELECT link_url FROM linked), {verdicts},
graph AS MATERIALIZED (SELECT page_url, pos, link_url FROM linked
  WHERE link_type = 'internal' AND {allowed_extension('link_url')} {not_cached}
    AND page_url IN (SELECT url FROM verdicts WHERE allowed)),
walk(url, depth, key) USING KEY (url) AS (SELECT '{START}', 0, ''
  UNION SELECT g.link_url, min(w.depth) + 1, min(w.key || lpad(g.pos::VARCHAR, 5, '0'))
  FROM walk w JOIN graph g ON g.page_url = w.url
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.url = g.link_url) GROUP BY g.link_url),
admitted AS (SELECT w.url, depth, key, allowed FROM walk w JOIN verdicts v ON v.url = w.url {deep} {cap}),
visited AS (SELECT a.*, s.status, s.retrieved_ms FROM admitted a LEFT JOIN site s ON s.url = a.url AND a.allowed)"""


EXTERNALS = """externals AS (SELECT link_url AS url, arg_min(page_url, (depth, key, pos)) AS source
  FROM linked l JOIN admitted a ON a.url = l.page_url AND a.allowed WHERE link_type = 'external' GROUP BY link_url)"""
CHECKED = f"""{EXT_SNAPSHOT}, {EXTERNALS}, {judged('externals', 'external_verdicts')},
checked AS (SELECT e.source, e.url AS target, allowed, CASE WHEN allowed THEN s.status END AS status
  FROM externals e JOIN external_verdicts v ON v.url = e.url LEFT JOIN ext_snapshot s ON s.url = e.url)"""

REACHED = "SELECT url, depth, coalesce(status, 0) AS status FROM visited"
PAGE_ERROR = """CASE WHEN NOT allowed THEN 'blocked by robots.txt' WHEN status IS NULL THEN 'no response'
    WHEN status >= 400 THEN 'status ' || status ELSE '' END"""
PAGE_CHECKS = "(SELECT url AS source, url AS target, status FROM visited WHERE allowed)"
EXTERNAL_CHECKS = "(SELECT source, target, status FROM checked WHERE allowed)"
ORACLE["crawl"] = f"WITH RECURSIVE {crawl()} {REACHED}"
ORACLE["crawl_levels"] = f"WITH RECURSIVE {crawl()} SELECT depth, count(*) AS pages FROM admitted GROUP BY depth"
ORACLE["crawl_max_depth"] = f"WITH RECURSIVE {crawl(depth=3)} {REACHED}"
ORACLE["crawl_max_pages"] = f"WITH RECURSIVE {crawl(pages=40)} {REACHED}"


def crawl_sites(limit: str) -> str:
    """``admitted(start, url, depth, key, allowed)`` of a run from the first page of every host, as far as ``limit``."""
    return f"""hosted AS (SELECT *, {host('url')} AS host FROM pages),
ids AS (SELECT page_id, host, lead(page_id, 1) OVER w AS next1, lead(page_id, 4) OVER w AS next4, min(page_id) OVER (PARTITION BY host) AS first
  FROM hosted WINDOW w AS (PARTITION BY host ORDER BY page_id)),
named AS (SELECT *, '/' || CASE WHEN page_id % 5 = 4 THEN 'en' ELSE 'p' END || '/' || page_id AS path FROM ids),
sites AS (SELECT 'https://' || n.host || n.path AS url, 'https://' || n.host || f.path AS start, CASE WHEN n.page_id % 17 = 16 THEN 404 ELSE 200 END AS status, n.page_id % 400 AS retrieved_ms,
    html || coalesce('<a href="' || l.path || '">later</a>', '') || coalesce('<a href="' || x.path || '">next</a>', '') || '<a href="' || f.path || '">first</a>' AS html
  FROM named n JOIN pages p ON p.page_id = n.page_id JOIN named f ON f.page_id = n.first
  LEFT JOIN named x ON x.page_id = n.next1 LEFT JOIN named l ON l.page_id = n.next4),
{distinct_links('sites')}, {ROBOTS},
linked_urls AS (SELECT start AS url FROM sites UNION SELECT link_url FROM listed), {judged("linked_urls", "verdicts")},
graph AS MATERIALIZED (SELECT page_url, pos, link_url FROM listed
  WHERE link_type = 'internal' AND {allowed_extension('link_url')} AND page_url IN (SELECT url FROM verdicts WHERE allowed)),
walk(start, url, depth, key) USING KEY (start, url) AS (SELECT DISTINCT start, start, 0, '' FROM sites
  UNION SELECT w.start, g.link_url, min(w.depth) + 1, min(w.key || lpad(g.pos::VARCHAR, 5, '0'))
  FROM walk w JOIN graph g ON g.page_url = w.url
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.start = w.start AND r.url = g.link_url) GROUP BY w.start, g.link_url),
admitted AS (SELECT w.*, allowed FROM walk w JOIN verdicts v ON v.url = w.url {limit})"""


SITE_ERROR = """CASE WHEN NOT allowed THEN 'blocked by robots.txt' WHEN s.status IS NULL THEN 'no response'
    WHEN s.status >= 400 THEN 'status ' || s.status ELSE '' END"""
ORACLE["crawl_sites"] = f"""WITH RECURSIVE {crawl_sites("QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, key) <= 40")}
SELECT a.start, a.url, depth, coalesce(s.status, 0) AS status, {SITE_ERROR} AS error
FROM admitted a LEFT JOIN sites s ON s.url = a.url AND a.allowed"""
ORACLE["health_document"] = f"""WITH RECURSIVE {crawl_sites("WHERE depth <= 1")},
checked AS (SELECT a.start, {SITE_ERROR} AS error, coalesce(s.retrieved_ms, 0) AS ms FROM admitted a LEFT JOIN sites s ON s.url = a.url AND a.allowed),
per_url AS (SELECT start AS url, CASE WHEN count(*) FILTER (error <> '') > 0 THEN 'fail' ELSE 'pass' END AS status, sum(ms)::BIGINT AS duration_ms,
    count(*) AS pages_visited, list_sort(list(DISTINCT error) FILTER (error <> '')) AS errors
  FROM checked WHERE error <> 'blocked by robots.txt' GROUP BY start),
parts AS (SELECT row_number() OVER (ORDER BY url) AS position, count(*) OVER () AS n, '{{"url":"' || url || '","status":"' || status || '","duration_ms":' || duration_ms
    || ',"pages_visited":' || pages_visited || coalesce(',"errors":[' || array_to_string(list_transform(errors, lambda e: '{{"message":"' || e || '"}}'), ',') || ']', '') || '}}' AS text FROM per_url)
SELECT position, text || CASE WHEN position < n THEN ',' ELSE '' END AS text FROM parts
UNION ALL SELECT 0, '{{"status":"' || CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END || '","results":[' FROM per_url
UNION ALL SELECT count(*) + 1, ']}}' FROM per_url"""
ORACLE["crawl_robots"] = f"""WITH RECURSIVE {crawl(robots=True)}
SELECT url, depth, coalesce(status, 0) AS status, {PAGE_ERROR} AS error FROM visited"""
ORACLE["pages_report"] = f"""WITH RECURSIVE {crawl(robots=True, inputs=EXPORT_TEXTS)},
skips AS (SELECT url FROM texts WHERE page_id % 24 = 5)
SELECT url, coalesce(status, 0) AS status, {PAGE_ERROR} AS error, coalesce(retrieved_ms, 0) AS retrieved_ms,
  CASE WHEN status IS NULL OR url IN (FROM skips) THEN '' ELSE {export_path('url')} END AS markdown_path,
  CASE WHEN status IS NOT NULL AND url IN (FROM skips) THEN 'unchanged content' ELSE '' END AS markdown_skipped_reason
FROM visited"""
ORACLE["crawl_visited"] = f"""WITH RECURSIVE {crawl(robots=True)}
SELECT url, coalesce(status, 0) AS status, {PAGE_ERROR} AS error, TIMESTAMP '2024-01-01' AS last_visited FROM visited"""
ORACLE["crawl_export"] = f"""WITH RECURSIVE {crawl(robots=True, inputs=f"{SITE}, {markdown('site')}")},
arrived AS (SELECT url, row_number() OVER (ORDER BY depth, key) AS ord FROM visited WHERE status IS NOT NULL),
source AS (SELECT {host('a.url')} AS host, a.ord, markdown AS text, a.url FROM arrived a JOIN md ON md.url = a.url),
{boilerplate('source')}, {stripped('source')},
docs AS (SELECT {export_path('s.url')} AS path, s.url, s.ord, sha256(CASE WHEN s.text = '' THEN '' ELSE b.text END) AS content_sha256
  FROM source s JOIN bare b ON b.ord = s.ord)
SELECT path, url, ord, content_sha256 FROM docs QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord DESC) = 1"""
ORACLE["page_errors"] = f"WITH RECURSIVE {crawl()} {errors(PAGE_CHECKS)}"
ORACLE["error_report"] = f"""WITH RECURSIVE {crawl(robots=True)}, {CHECKED}
{errors(PAGE_CHECKS)} UNION ALL {errors(EXTERNAL_CHECKS)}"""
ORACLE["external_unique"] = f"WITH RECURSIVE {crawl()}, {EXTERNALS} SELECT url, source FROM externals"
ORACLE["external_check"] = f"WITH RECURSIVE {crawl(robots=True)}, {CHECKED} {errors(EXTERNAL_CHECKS)}"
ORACLE["crawl_stats"] = f"""WITH RECURSIVE {crawl(robots=True, cache=True, pages=60, depth=6)}, {CHECKED},
fill AS (SELECT depth, key FROM admitted QUALIFY row_number() OVER (ORDER BY depth, key) = 60),
seen AS (SELECT l.link_type, a.depth + 1 AS depth, a.key || lpad(l.pos::VARCHAR, 5, '0') AS key,
    {allowed_extension('l.link_url')} AS ext_ok, l.link_url IN (SELECT url FROM prior_visited WHERE url <> '{START}') AS cached
  FROM linked l JOIN admitted a ON a.url = l.page_url AND a.allowed),
sorted AS (SELECT *, link_type = 'internal' AND ext_ok AND NOT cached AS kept,
    coalesce((depth, key) > (SELECT (depth, key) FROM fill), false) AS late FROM seen)
SELECT (SELECT count(*) FROM admitted WHERE allowed) AS pages_visited, (SELECT count(*) FROM admitted) AS unique_internal_pages,
  (SELECT count(*) FROM checked) AS unique_external_links,
  count(*) FILTER (link_type = 'internal') AS total_internal_links, count(*) FILTER (link_type = 'external') AS total_external_links,
  (SELECT count(*) FROM checked WHERE status IS NOT NULL) AS external_links_checked,
  count(*) FILTER (link_type = 'internal' AND NOT ext_ok) AS skipped_by_extension,
  count(*) FILTER (link_type = 'internal' AND ext_ok AND cached) AS skipped_by_cache,
  count(*) FILTER (kept AND depth > 6) AS skipped_by_depth,
  count(*) FILTER (kept AND depth <= 6 AND late) AS skipped_by_limit,
  (SELECT count(*) FROM admitted WHERE NOT allowed) + (SELECT count(*) FROM checked WHERE NOT allowed) AS skipped_by_robots
FROM sorted"""
ORACLE["stream_new_urls"] = f"WITH {SITE}, {distinct_links('site')} SELECT DISTINCT link_url AS url FROM listed"
