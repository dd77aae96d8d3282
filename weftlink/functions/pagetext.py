"""One page's text and Markdown, by scanning its tags once.

Plain functions over one page, used by the Arrow functions of ``html`` and
``markdown``. Everything here takes time in proportion to the page: no pattern
is tried again from every opening tag.
"""

from __future__ import annotations

import re

from .entities import ENTITY, decoded
from .text import SPACE_CHARS, SPACE_POINTS

# The elements that are not seen, and those that end a block.
UNSEEN_ELEMENTS = ("script", "style", "noscript", "template", "iframe")
BLOCK_ELEMENTS = (
    "p|div|section|article|main|header|footer|address|blockquote|table|tr|tbody|thead|tfoot|ul|ol"
)

_FLAGS = re.IGNORECASE | re.ASCII
# The layout rules in the order in which they apply: pattern, replacement. Names
# are matched loosely: ``<li`` also covers ``<link``.
_LAYOUT = [
    (r"<br[^>]*>", "\n"),
    (r"<li[^>]*>", "\n- "),
    (r"</li>", ""),
    *[(rf"<h{n}[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    (r"</h[1-6]>", "\n\n"),
    (rf"<(?:{BLOCK_ELEMENTS})[^>]*>", "\n\n"),
    (rf"</(?:{BLOCK_ELEMENTS})>", "\n\n"),
    (r"<[^>]+>", ""),
]
_RULES = [(re.compile(pattern, _FLAGS), new) for pattern, new in _LAYOUT]
_ANY_RULE = re.compile("<(?:" + "|".join(f"({pattern[1:]})" for pattern, _ in _LAYOUT) + ")", _FLAGS)
_TAG_IN_TAG = re.compile(r"<[^<>]*<")

_ODD_SPACE = re.compile("[" + "".join(chr(p) for p in SPACE_POINTS if p not in (0x0A, 0x20)) + "]")
_SPACES = re.compile(r"  +")
_BLANK_LINES = re.compile(r"\n{3,}")
_HEADING = re.compile(r"^(#+)(?=[^#\n ])", re.MULTILINE)


def ascii_lower(text: str) -> str:
    """A-Z lower-cased and nothing else, so that places stay the same."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def decode(text: str) -> str:
    return ENTITY.sub(lambda m: decoded(m[0]), text) if "&" in text else text


def drop_unseen(html: str) -> str:
    """Unseen elements, one kind after the other, and then comments become one space."""
    for tag in UNSEEN_ELEMENTS:
        low = ascii_lower(html)
        if f"<{tag}" in low:
            html = _drop(html, low, f"<{tag}", ">", f"</{tag}>")
    return _drop(html, html, "<!--", "", "-->") if "<!--" in html else html


def _drop(text: str, low: str, start: str, begun: str, end: str) -> str:
    kept, at = [], 0
    while (a := low.find(start, at)) >= 0:
        b = low.find(begun, a + len(start)) if begun else a + len(start)
        # Without an end behind this start there is none behind a later one.
        c = low.find(end, b + len(begun)) if b >= 0 else -1
        if c < 0:
            break
        kept += [text[at:a], " "]
        at = c + len(end)
    return "".join([*kept, text[at:]])


def strip_tags(html: str) -> str:
    """Tags become line breaks, bullets and heading marks, or nothing."""
    if not _TAG_IN_TAG.search(html):
        return _ANY_RULE.sub(lambda m: _LAYOUT[m.lastindex - 1][1], html)
    # A tag inside an unfinished one: what a rule leaves may be read by the next.
    end = html.rfind(">") + 1
    inside, rest = html[:end], html[end:]
    for pattern, new in _RULES:
        # Behind the last ``>`` every opening would be tried to the end.
        end = inside.rfind(">") + 1
        inside = pattern.sub(new, inside[:end]) + inside[end:]
    return inside + rest


def single_spaces(text: str) -> str:
    return _SPACES.sub(" ", _ODD_SPACE.sub(" ", text))


def tidy(text: str) -> str:
    """One space between words, one blank line between blocks, ends trimmed."""
    out = "\n".join([line.strip(" ") for line in single_spaces(text).split("\n")])
    out = _BLANK_LINES.sub("\n\n", out)
    return _HEADING.sub(r"\1 ", out).strip(SPACE_CHARS)


def visible(html: str) -> str:
    """What a reader sees, ended by a line break; empty if nothing."""
    text = tidy(decode(strip_tags(drop_unseen(html))))
    return text + "\n" if text else ""


# ---- Markdown

_HIDDEN = (*UNSEEN_ELEMENTS, "head", "title")
_HEADINGS = {f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)}
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " header hgroup html legend main menu nav noframes ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_LINES = _BLOCKS | _HEADINGS.keys() | {"br", "hr", "li"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "tt": "`", "kbd": "`", "del": "~~", "s": "~~", "strike": "~~"}
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>|<[/!?][^>]*>")
_ATTRIBUTE = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r \"'>]+))")
_CODE_TAG = re.compile(r"<(?:([A-Za-z][A-Za-z0-9]*)[^<>]*|[/!?][^<>]*)>")
# What a table holds that is there for the page's layout.
_LAYOUT_CELL = re.compile(r"</table|<(?:table|p|div|ul|ol|li|dl|pre|form|section|article|h[1-6]|hr)(?![a-z0-9])")
#: These stand for a link and for a code block while the text is laid out.
LINK, CODE = "\x00", "\x01"


def attribute(tag: str, name: str) -> str:
    """The first value of an attribute in the text of a tag; empty without one."""
    return next((a or b or c for key, a, b, c in _ATTRIBUTE.findall(tag) if key.lower() == name), "")


class Inline:
    """Text with marks around what closes within its block.

    A mark stands next to the words, not next to the spaces around them. One
    that is opened waits for its first word, and is dropped if it stays open.
    """

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.before: dict[int, list[str]] = {}
        self.after: dict[int, list[str]] = {}
        self.words = -1  # the last piece that isn't blank
        self.drop_open()

    def drop_open(self) -> None:
        self.open: list[list] = []  # element, place of its first word
        self.count = dict.fromkeys(_MARKS, 0)
        self.waiting = 0  # how many of the last opened have no word yet

    def add(self, text: str) -> None:
        core = text.strip(SPACE_CHARS)
        if not core:
            self.pieces.append(text)
            return
        at = text.index(core)
        self.words = len(self.pieces) + 1
        self.pieces += [text[:at], core, text[at + len(core) :]]
        for mark in self.open[len(self.open) - self.waiting :]:
            mark[1] = self.words
        self.waiting = 0

    def begin(self, name: str) -> None:
        self.open.append([name, -1])
        self.count[name] += 1
        self.waiting += 1

    def end(self, name: str) -> None:
        found = None
        while self.count[name] and found != name:
            found, place = self.open.pop()
            self.count[found] -= 1
            self.waiting = max(0, self.waiting - 1)
        if found == name and place >= 0:
            self.before.setdefault(place, []).append(_MARKS[name])
            self.after.setdefault(self.words, []).append(_MARKS[name])

    def __str__(self) -> str:
        if not self.before:
            return "".join(self.pieces)
        out = []
        for k, piece in enumerate(self.pieces):
            out += [*reversed(self.before.get(k, ())), piece, *self.after.get(k, ())]
        return "".join(out)


class MarkdownFold:
    """Folds a page's tags and texts, in their order, into laid-out text.

    Links and code blocks are kept aside, and a sign stands for each. While a
    link is open its label is gathered on its own; within a label or a table's
    cell a break between blocks is a space.
    """

    def __init__(self) -> None:
        self.body = self.here = Inline()
        self.links: list[tuple[str, str, bool]] = []
        self.codes: list[str] = []
        self.target = ""
        self.lists: list[int] = []  # the next number; 0 in a list of bullets
        self.in_table, self.cells, self.rows = False, 0, 0

    def text(self, encoded: str) -> None:
        if encoded:
            text = decode(encoded)
            self.here.add(text.replace("|", "\\|") if self.cells else text)

    def gap(self, line: str) -> None:
        if self.cells or self.here is not self.body:
            line = " "
        elif line != "\n":
            self.here.drop_open()
        self.here.pieces.append(line)

    def begin(self, name: str, rest: str) -> None:
        if name == "br":
            self.gap("\n")
        elif name == "hr":
            self.gap("\n\n---\n\n")
        elif name == "img":
            self.image(decode(attribute(rest, "alt")), attribute(rest, "src"))
        elif name in _MARKS:
            self.here.begin(name)
        elif name == "li":
            number = self.lists[-1] if self.lists else 0
            if number:
                self.lists[-1] += 1
            self.gap(f"\n{number}. " if number else "\n- ")
        elif self.in_table and name == "tr":
            self.end_row()
        elif self.in_table and name in ("td", "th"):
            self.here.drop_open()
            self.here.pieces.append(" | " if self.cells else "\n| ")
            self.cells += 1
        elif name in _HEADINGS:
            self.gap(_HEADINGS[name])
        elif name in _BLOCKS:
            if name in ("ul", "ol"):
                start = attribute(rest, "start") or "1"
                self.lists.append(0 if name == "ul" else int(start) if re.fullmatch("[0-9]{1,9}", start) else 1)
            self.gap("\n\n")

    def end(self, name: str) -> None:
        if name == "a":
            self.end_link()
        elif name in _MARKS:
            self.here.end(name)
        elif self.in_table and name in ("tr", "table"):
            self.end_row()
            if name == "table":
                self.in_table = False
                self.gap("\n\n")
        elif name in _HEADINGS or (name in _BLOCKS and not self.cells):
            if name in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.gap("\n\n")

    def end_row(self) -> None:
        if self.cells:
            cells, self.cells = self.cells, 0
            self.here.drop_open()
            self.here.pieces.append(" |" + ("" if self.rows else "\n|" + " --- |" * cells))
            self.rows += 1

    def image(self, alt: str, source: str) -> None:
        alt = single_spaces(alt.replace("\n", " ")).strip(" ")
        if source and self.here is self.body:
            self.links.append((alt, source, True))
            self.here.add(LINK)
        else:
            self.here.add(alt)

    def begin_link(self, target: str) -> None:
        self.end_link()
        if target:
            self.target, self.here = target, Inline()

    def end_link(self) -> None:
        if self.here is self.body:
            return
        label, self.here = str(self.here), self.body
        plain = single_spaces(label.replace("\n", " ")).strip(" ")
        if plain:
            self.links.append((plain, self.target, False))
            plain = LINK
        self.here.add(" " * label[:1].isspace() + plain + " " * label[-1:].isspace())

    def code(self, encoded: str) -> None:
        lines = _CODE_TAG.sub(lambda m: "\n" if m[1] and m[1].lower() in _LINES else "", encoded)
        plain = decode(lines)
        plain = plain.removeprefix("\n").removesuffix("\n")
        self.codes.append(f"```\n{plain}\n```")
        self.gap("\n\n")
        self.here.add(CODE)
        self.gap("\n\n")


def markdown_parts(html: str) -> tuple[list[str], list[tuple[str, str, bool]]]:
    """Markdown cut at its links, and the links (label, raw target, whether an image) that go between."""
    html = html.replace(LINK, "").replace(CODE, "")
    low = ascii_lower(html)
    fold, at, known = MarkdownFold(), 0, {}

    def ahead(what: str, start: int) -> int:
        """Where something is next, -1 if nowhere; the text up to there is not searched again."""
        found = known.get(what, 0)
        if 0 <= found < start or what not in known:
            known[what] = found = low.find(what, start)
        return found

    while (a := html.find("<", at)) >= 0:
        fold.text(html[at:a])
        if html.startswith("<!--", a) and (end := ahead("-->", a + 4)) >= 0:
            fold.here.pieces.append(" ")
            at = end + 3
            continue
        m = _TAG.match(html, a) if ahead(">", a) >= 0 else None
        if not m:
            fold.text("<")
            at = a + 1
            continue
        at, name = m.end(), (m[2] or "").lower()
        if m[1]:
            fold.end(name)
        elif (name in _HIDDEN or name == "pre") and (end := ahead(f"</{name}>", at)) >= 0:
            if name == "pre":
                fold.code(html[at:end])
            else:
                fold.here.pieces.append(" ")
            at = end + len(name) + 3
        elif name == "a":
            fold.begin_link(attribute(m[3], "href") if ahead("</a", at) >= 0 else "")
        else:
            if name == "table" and not fold.in_table and (end := _LAYOUT_CELL.search(low, at)) and end[0] == "</table":
                fold.gap("\n\n")
                fold.in_table, fold.rows = True, 0
            fold.begin(name, m[3])
    fold.text(html[at:])
    fold.end_link()
    fold.end_row()
    laid_out = tidy(str(fold.body))
    codes = iter(fold.codes)
    return re.sub(CODE, lambda _: next(codes), laid_out).split(LINK), fold.links
