"""Visible text of web pages, laid out as a reader sees it.

A small tree builder closes what the next tag implies closed and adds the table parts that a page may
leave out; visibility rules drop what no reader sees; the rest is laid out: white space collapses,
blocks stand apart, lists get their marks, cells of a table line up.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallydesk.llm.common import col

# Element names with a meaning of their own in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist rp".split())
# Inputs that show a text, with the one that they show without a value of their own.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul fieldset".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("html body option optgroup li dd dt tr td th tbody thead tfoot caption legend".split())
# These hold the parts of a table and no text of their own: what else stands in them is moved before the table.
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
# What a start tag closes, if it is open and no element of the second set lies between.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset(["table"])),
    "th": (frozenset("td th".split()), frozenset(["table"])),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Elements nested deeper than this become children of the last one, as in browsers.
DEEPEST = 200


class Element:
    __slots__ = ("children", "given", "tag")

    def __init__(self, tag: str, given: str = ""):
        self.tag, self.given, self.children = tag, given, []

    def attributes(self) -> dict[str, str]:
        if not self.given.strip():
            return {}
        return {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in reversed(_ATTRIBUTE.findall(self.given))}


class _Builder:
    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]

    def close(self, tags: frozenset, scope: frozenset) -> None:
        """End the outermost open element of ``tags`` that no element of ``scope`` shields."""
        found = 0
        for n in range(len(self.open) - 1, 0, -1):
            if self.open[n].tag in scope:
                break
            if self.open[n].tag in tags:
                found = n
        if found:
            del self.open[found:]

    def table(self) -> tuple[int, int]:
        """Places of the innermost open table and of its innermost open part; zeros in cells and outside of tables."""
        part = 0
        for n in range(len(self.open) - 1, 0, -1):
            tag = self.open[n].tag
            if tag in ("td", "th", "caption", "template"):
                break
            if tag in TABLE_PARTS:
                part = part or n
            if tag == "table":
                return n, part
        return 0, 0

    def put(self, child: Element | str, table: int = 0) -> None:
        """Add to what is open, or right before the open table at this place: it is its parent's last child."""
        if table:
            self.open[table - 1].children.insert(-1, child)
        else:
            self.open[-1].children.append(child)

    def start(self, tag: str, given: str) -> None:
        if tag == "html":
            return
        if tag in ENDS_PARAGRAPH:
            self.close(frozenset(["p"]), frozenset("td th table button".split()))
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.open.pop()
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.open.pop()
        moved = self.open[-1].tag in TABLE_PARTS and tag not in IN_TABLE and tag not in ("script", "style", "template")
        table, part = self.table() if moved or tag in IN_TABLE or tag in ("form", "table") else (0, 0)
        if table and tag == "form":
            self.put(Element(tag, given))  # an empty one
            return
        if table and tag == "table":
            del self.open[table:]
            moved = False
        elif table and tag in IN_TABLE:
            del self.open[(table if tag in ("caption", "colgroup", "col") else part) + 1 :]
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", "")
        if tag == "tr" and self.open[-1].tag == "table":
            self.start("tbody", "")
        element = Element(tag, given)
        self.put(element, table if moved else 0)
        if tag not in VOID and not (given.endswith("/") and tag not in BLOCKS and tag not in RAW) and len(self.open) < DEEPEST:
            self.open.append(element)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and all(element.tag != "p" for element in self.open):
            self.start("p", "")
            self.open.pop()
        else:
            for n in range(len(self.open) - 1, 0, -1):
                if self.open[n].tag == tag:
                    del self.open[n:]
                    return
                if self.open[n].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "template", "body", "html"):
                    return

    def text(self, value: str) -> None:
        if self.open[-1].tag == "head" and value.strip():
            self.open.pop()
        if self.open[-1].tag == "colgroup" and value.strip():
            self.open.pop()
        moved = self.open[-1].tag in TABLE_PARTS and value.strip()
        self.put(unescape(value), self.table()[0] if moved else 0)


def _tag_end(page: str, at: int) -> int:
    """Where a start tag ends whose name ends at ``at``, after its closing bracket; -1 if it never does."""
    while True:
        equals, ended = page.find("=", at), page.find(">", at)
        if ended < 0:
            return -1
        if equals < 0 or ended < equals:
            return ended + 1
        at = equals + 1
        while page[at : at + 1] in (" ", "\t", "\n", "\r", "\f"):
            at += 1
        if page[at : at + 1] in ('"', "'"):
            at = page.find(page[at], at + 1) + 1
            if not at:
                return -1


def build(page: str) -> Element:
    """The tree of a page. Time grows with its length, whatever is broken in it.

    Quotes hold brackets only as values of attributes. After a tag with a value that never ends,
    quotes hold nothing any more; a page whose last tag does not end has that as text.
    """
    builder, at, quotes, text_from = _Builder(), 0, True, 0
    while True:
        found = _TAG.search(page, at)
        if found is None:
            break
        after = found.end()
        if found[2]:
            after = _tag_end(page, found.end()) if quotes else page.find(">", found.end()) + 1
            if after <= 0:
                if quotes and page.find(">", found.end()) >= 0:
                    quotes = False
                    continue
                break
        if found.start() > text_from:
            builder.text(page[text_from : found.start()])
        at = text_from = after
        if found[1]:
            builder.end(found[1].lower())
        elif found[2]:
            tag = found[2].lower()
            builder.start(tag, page[found.end() : after - 1])
            if tag in RAW:
                ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                inside, at = (page[at:], len(page)) if ended is None else (page[at : ended.start()], ended.end())
                text_from = at
                if tag in ("textarea", "title"):
                    builder.text(inside)
                builder.end(tag)
    if text_from < len(page):
        builder.text(page[text_from:])
    return builder.root


def _style(given: str) -> dict[str, str]:
    """Declarations of a style attribute; of several for one property the last holds, or the last important one."""
    found: dict[str, str] = {}
    for declaration in re.sub(r"/\*.*?(?:\*/|\Z)", "", given, flags=re.S).lower().split(";"):
        name, _, value = declaration.partition(":")
        name, value = name.strip(), value.strip()
        if name and value and ("!important" in value or "!important" not in found.get(name, "")):
            found[name] = value
    return {name: value.replace("!important", "").strip() for name, value in found.items()}


def _shown(element: Element) -> tuple[bool, bool | None]:
    """Whether the element takes part at all, and whether its text is visible (None: as its parent's)."""
    if element.tag in UNSEEN:
        return False, None
    given = element.attributes()
    if "hidden" in given or (element.tag == "dialog" and "open" not in given):
        return False, None
    if element.tag == "input" and given.get("type", "").strip().lower() not in BUTTONS:
        return False, None
    style = _style(given.get("style", ""))
    if style.get("display") == "none":
        return False, None
    visibility = style.get("visibility")
    if visibility in ("hidden", "collapse"):
        return True, False
    return True, True if visibility == "visible" else None


class _Layout:
    """Lines of text: ``gap`` blank lines are due before the next text, ``parts`` are those of the line being filled."""

    def __init__(self):
        self.lines, self.parts, self.gap, self.indent, self.mark = [], [], 0, "", ""
        self.space = self.bare = False

    def word(self, text: str) -> None:
        if not self.parts:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.parts, self.mark = [self.indent + self.mark], ""
            self.bare = True  # nothing but the mark so far
        elif self.space and not self.bare:
            self.parts.append(" ")
        self.space = False
        if text:
            self.bare = False
            self.parts.append(text)

    def ended(self) -> str:
        """The line that was being filled; a new one begins."""
        line = "".join(self.parts).rstrip()
        self.parts, self.space = [], False
        return line

    def flow(self, text: str) -> None:
        pieces = _SPACE.split(text)
        for n, piece in enumerate(pieces):
            if n:
                self.space = True
            if piece:
                self.word(piece)

    def end_line(self) -> None:
        if self.parts and "".join(self.parts):
            self.lines.append(self.ended())
        self.ended()

    def apart(self, blank: int) -> None:
        self.end_line()
        self.gap = max(self.gap, blank)


def _layout(element: Element, out: _Layout, visible: bool, kept: bool, depth: int) -> None:
    number = _start_of(element)
    folded = element.tag == "details" and "open" not in element.attributes()
    for place, child in enumerate(element.children):
        if isinstance(child, str):
            if not visible or folded:
                continue
            if element.tag == "pre" and not place:
                child = child.removeprefix("\n")  # the line break after the tag is no text
            if kept:
                for n, line in enumerate(child.split("\n")):
                    if n:
                        out.end_line() if out.parts else out.lines.append("")
                    if line:
                        out.word(line)
            else:
                out.flow(child)
            continue
        takes_part, own = _shown(child)
        if not takes_part or (folded and child.tag != "summary"):
            continue
        seen = visible if own is None else own
        tag = child.tag
        if tag == "br":
            if not out.parts:
                out.word("")
            out.lines.append(out.ended())
        elif tag == "table":
            out.apart(1)
            for line in _table(child, seen):
                if line:
                    out.word(line)
                out.end_line()
            out.apart(1)
        elif tag == "input":
            if seen:
                given = child.attributes()
                out.flow(given.get("value", BUTTONS[given.get("type", "").strip().lower()]))
        elif tag == "li":
            out.apart(0)
            if element.tag == "ol":
                number = _whole(child.attributes().get("value"), number)
            mark = f"{number}. " if element.tag == "ol" else "- "
            number += 1
            before = out.indent
            out.mark = mark
            inner = _Marked(out, before, mark)
            inner.enter()
            _layout(child, out, seen, kept, depth + 1)
            inner.leave()
        elif tag in BLOCKS:
            blank = 1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and depth) else 0
            before = out.indent
            out.apart(blank)
            if tag in ("blockquote", "dd"):
                out.indent += "  "
            _layout(child, out, seen, kept or tag == "pre", depth + (tag in ("ul", "ol", "menu")))
            out.apart(blank)
            out.indent = before
        else:
            _layout(child, out, seen, kept, depth)


class _Marked:
    """A list item: its mark stands before its first line, the other lines are indented as wide."""

    def __init__(self, out: _Layout, indent: str, mark: str):
        self.out, self.indent, self.mark = out, indent, mark

    def enter(self) -> None:
        self.out.indent, self.out.mark = self.indent, self.mark
        word = self.out.word
        width = len(self.mark)

        def first_then_rest(text: str) -> None:
            word(text)
            self.out.indent = self.indent + " " * width
            self.out.word = word

        self.out.word = first_then_rest

    def leave(self) -> None:
        self.out.apart(0)
        self.out.__dict__.pop("word", None)
        self.out.indent, self.out.mark = self.indent, ""


def _start_of(element: Element) -> int:
    if element.tag != "ol":
        return 1
    return _whole(element.attributes().get("start"), 1)


def _whole(given: str | None, otherwise: int) -> int:
    return int(given) if given is not None and re.fullmatch(r"-?[0-9]{1,9}", given.strip()) else otherwise


def _rows(element: Element, visible: bool):
    """(row, visible) of a table's rows, those of nested tables left out; captions come as rows too."""
    for child in element.children:
        if isinstance(child, Element):
            takes_part, own = _shown(child)
            seen = visible if own is None else own
            if takes_part and child.tag in ("tr", "caption"):
                yield child, seen
            elif takes_part and child.tag in ("tbody", "thead", "tfoot"):
                yield from _rows(child, seen)


def _cell_text(cell: Element, visible: bool) -> list[str]:
    out = _Layout()
    _layout(cell, out, visible, False, 0)
    out.end_line()
    return [line for line in out.lines if line.strip()] or [""]


def _table(table: Element, visible: bool) -> list[str]:
    """Lines of a table, its columns lined up, two spaces apart; a cell over several rows stands in its first."""
    grid: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}  # by column, how many further rows a cell from above covers
    for row, seen in _rows(table, visible):
        if row.tag == "caption":
            grid.append([(0, _cell_text(row, seen), 0)])
            continue
        cells, at, below = [], 0, {}
        for cell in row.children:
            if isinstance(cell, Element) and cell.tag in ("td", "th"):
                takes_part, own = _shown(cell)
                if takes_part:
                    given = cell.attributes()
                    wide = min(1000, max(1, _whole(given.get("colspan"), 1)))
                    high = min(65534, max(0, _whole(given.get("rowspan"), 1)))
                    while taken.get(at, 0) > 0:
                        at += 1
                    cells.append((at, _cell_text(cell, seen if own is None else own), wide))
                    if high != 1:  # none means all that follow
                        below.update((column, high - 1 if high else 65534) for column in range(at, at + wide))
                    at += wide
        taken = {column: rows - 1 for column, rows in taken.items() if rows > 1} | below
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for at, lines, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines)))
    # A cell over several columns that is wider than they are widens the last of them.
    for at, lines, span in sorted((cell for cells in grid for cell in cells if cell[2] > 1), key=lambda cell: cell[2]):
        held = sum(widths[column] + 2 for column in range(at, at + span) if column in widths)
        lacking = max(map(len, lines)) + 2 - held
        if lacking > 0:
            last = at + span - 1
            widths[last] = widths[last] + lacking if last in widths else max(0, lacking - 2)
    columns = max((at + span for cells in grid for at, _, span in cells), default=0)
    begins = [0]
    for column in range(columns):
        begins.append(begins[-1] + (widths[column] + 2 if column in widths else 0))
    text = []
    for cells in grid:
        for n in range(max((len(lines) for _, lines, _ in cells), default=0)):
            line = ""
            for number, (at, lines, _) in enumerate(cells):
                own = lines[n] if n < len(lines) else ""
                if own:
                    start = max(begins[at], len(line) + 2 if number else 0) if line else begins[at]
                    line = line.ljust(start) + own
            text.append(line.rstrip())
    return [line for line in text if line]


def render(page: str | None) -> str | None:
    """The visible text of a page; null for null, empty for a page without any."""
    if page is None:
        return None
    out = _Layout()
    _layout(build(page), out, True, False, 0)
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The rows with the visible text of each page as one more column; one called like it is replaced.

    Null pages have null text, empty pages and pages without visible text an empty one. Broken
    markup is read as browsers do, but a tag that never ends is text. What is hidden is told from
    elements and their own attributes: rules of style sheets and scripts play no part.
    """

    def rendered(values: pd.Series) -> pd.Series:
        return values.map(render, na_action="ignore")

    return pages.withColumn(text, F.pandas_udf(rendered, "string")(col(html)))
