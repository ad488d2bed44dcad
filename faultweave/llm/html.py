"""Layout-aware text of web pages: what a reader would see, laid out in lines.

Tags open and close elements with the implied ends of HTML (a block ends an open paragraph,
an item ends the item before it, a row ends its cells), at any depth. Elements that are not
displayed give no text; what is made invisible may hold visible elements. Paragraphs and
headings are set apart by a blank line, other blocks by a line end; list items have a dash or
their number and are indented by depth; cells of a table stand under their column, spans
included. White space is one blank except in ``pre``, ``textarea`` and ``xmp``. A drop-down
shows its chosen option. The time is in proportion to the page, whatever is broken in it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SHOWN_RAW = frozenset({"textarea", "xmp"})
HIDDEN = frozenset(
    "head script style title template noscript iframe noembed noframes object audio video canvas datalist".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li"
    " main menu nav section summary tbody thead tfoot tr td th caption search textarea xmp".split()
)
LISTS = frozenset("ul ol menu dir".split())
# an opening tag -> (open elements that it ends, elements beyond which it looks for none)
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]

CELLS = frozenset({"td", "th"})
#: Opening blocks end a paragraph that is open within these.
P_SCOPE = frozenset("table td th caption button li div section article".split())
#: End tags that may end elements outside a cell.
OUTSIDE_CELLS = frozenset("table tr tbody thead tfoot body html".split())
#: Spans beyond these count as these.
COLSPAN, ROWSPAN = 1000, 65_534
#: Layout only, no text depends on it: the deepest indentation, and the widest cell that widens its column.
WIDEST_INDENT, WIDEST_CELL = 80, 120

_BLANKS = re.compile(r"[ \t\n\r\f]+")
_SKIPPED = re.compile(r"[\s/]*")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE_VALUE = re.compile(r"[^\s>]*")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


def _attributes(html: str, at: int) -> tuple[int, dict[str, str]] | None:
    """The place after a tag whose attributes begin at ``at``, and these; None if it never ends.

    A quote opens a value only directly after its equals sign.
    """
    attrs: dict[str, str] = {}
    while True:
        at = _SKIPPED.match(html, at).end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return at + 1, attrs
        name = _ATTR_NAME.match(html, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            quote = html[at : at + 1]
            if quote and quote in "\"'":
                close = html.find(quote, at + 1)
                if close < 0:
                    return None
                value, at = html[at + 1 : close], close + 1
            else:
                bare = _BARE_VALUE.match(html, at)
                value, at = bare[0], bare.end()
        attrs.setdefault(name[0].lower(), unescape(value))


def _style(attrs: dict[str, str]) -> dict[str, str]:
    """The declarations of the style attribute, the last of each property."""
    if "style" not in attrs:
        return {}
    found = {}
    for declaration in _CSS_COMMENT.sub("", attrs["style"]).split(";"):
        name, _, value = declaration.partition(":")
        found[name.strip().lower()] = value.replace("!important", "").strip().lower()
    return found


def _number(attrs: dict[str, str], name: str, default: int, most: int) -> int:
    digits = re.match(r"\s*(\d{1,9})", attrs.get(name, ""))
    return min(int(digits[1]), most) if digits else default


class _Page:
    """Lines of one flow of text: a page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent = 0
        self.mark = ""
        self.gap = False

    def _said(self) -> str:
        said, self.parts = "".join(self.parts), []
        return said

    def _add(self, said: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.lines.append((" " * min(self.indent, WIDEST_INDENT) + self.mark + said).rstrip(" "))
        if self.mark:
            self.indent, self.mark = self.indent + len(self.mark), ""
        self.gap = False

    def break_line(self, spaced: bool = False, as_is: bool = False) -> None:
        said = self._said()
        if said.strip():
            self._add(said if as_is else said.strip(" "))
        self.gap |= spaced

    def say(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        if not self.parts or self.parts[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)

    def say_as_is(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        for line in rest:
            if first:
                self.parts.append(first)
            self.end_line()
            first = line
        if first:
            self.parts.append(first)

    def end_line(self) -> None:
        said = self._said()
        if said.strip():
            self._add(said.rstrip())
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def text(self) -> str:
        self.break_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []

    def _placed(self) -> list[list[tuple[int, list[str], int]]]:
        """For each row its cells as first column, lines and columns; cells from above keep their columns."""
        taken: dict[int, tuple[int, int]] = {}  # a column -> the row that is free again, the column after
        rows = []
        for r, cells in enumerate(self.rows):
            column, row, held = 0, [], None
            for text, columns, down in cells:
                while taken.get(column, (0, 0))[0] > r:
                    column, held = taken[column][1], None
                row.append((column, text.split("\n"), columns))
                until = r + down if down else len(self.rows)
                if down == 1:
                    held = None
                elif held is not None and taken[held][0] == until:
                    taken[held] = until, column + columns
                else:
                    held = column
                    taken[held] = until, column + columns
                column += columns
            rows.append(row)
        # only columns in which a cell begins are set apart
        begins = sorted({cell[0] for row in rows for cell in row})
        number = {column: k for k, column in enumerate(begins)}
        return [
            [(number[c], said, bisect_left(begins, c + columns) - number[c]) for c, said, columns in row] for row in rows
        ]

    def lines(self) -> list[str]:
        """Rows of aligned cells; a cell of several lines makes its row as high."""
        rows = self._placed()
        width = [0] * max((cell[0] + 1 for row in rows for cell in row), default=0)
        wide = lambda cell: min(max(map(len, cell[1])), WIDEST_CELL)
        for row in rows:
            for cell in row:
                if cell[2] == 1:
                    width[cell[0]] = max(width[cell[0]], wide(cell))
        for row in rows:
            for column, *rest in row:
                last = column + rest[1] - 1
                if last > column:
                    spare = wide((column, *rest)) - sum(width[column : last + 1]) - 2 * (last - column)
                    width[last] += max(0, spare)
        begins = [0]
        for w in width:
            begins.append(begins[-1] + w + 2)
        lines = []
        for row in rows:
            if not any(any(cell[1]) for cell in row):
                continue
            for n in range(max(len(cell[1]) for cell in row)):
                line, end = [], 0
                for column, said, _ in row:
                    text = said[n] if n < len(said) else ""
                    if text:
                        blanks = max(begins[column] - end, 2 if line else 0)
                        line.append(" " * blanks + text)
                        end += blanks + len(text)
                lines.append("".join(line).rstrip())
        return lines


class _Element(NamedTuple):
    tag: str
    gone: bool
    visible: bool
    before: tuple[int, str]
    span: tuple[int, int]


class Renderer:
    """Opens and closes elements and lays their text out, at any depth of nesting."""

    def __init__(self) -> None:
        self.open: list[_Element] = []
        #: Where the open elements of a tag stand, so that none is searched for through the others.
        self.at: dict[str, list[int]] = {}
        self.gone = self.pre = 0
        self.visible = True
        self.pages = [_Page()]
        self.tables: list[_Table] = []
        self.lists: list[int | None] = []
        #: Whether all options show, and each option's choice and text.
        self.choices: tuple[bool, list[tuple[bool, list[str]]]] | None = None

    @property
    def page(self) -> _Page:
        return self.pages[-1]

    def _nearest(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in IMPLIED:
            self._end_last(*IMPLIED[tag])
        if tag in BLOCK:
            self._end_last({"p"}, P_SCOPE - {tag})
        style = _style(attrs)
        hidden = "hidden" in attrs and attrs["hidden"].lower() != "until-found"
        gone = tag in HIDDEN or hidden or style.get("display") == "none"
        visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""), self.visible)
        if tag in VOID:
            if not (self.gone or gone):
                self._void(tag)
            return
        span = _number(attrs, "colspan", 1, COLSPAN) or 1, _number(attrs, "rowspan", 1, ROWSPAN)
        before = (self.page.indent, self.page.mark)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(_Element(tag, gone, self.visible, before, span))
        self.gone += gone
        self.visible = visible
        if not self.gone:
            self._begin(tag, attrs)

    def _void(self, tag: str) -> None:
        if tag == "br" and self.pre:
            self.page.end_line()
        elif tag == "br":
            self.page.break_line()
        elif tag == "hr":
            self.page.break_line(True)
        elif tag == "img":
            self.page.say(" " if self.page.parts else "")

    def _begin(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "select":
            self.choices = ("multiple" in attrs or _number(attrs, "size", 1, 1000) > 1, [])
        elif self.choices is not None:
            if tag == "option":
                self.choices[1].append(("selected" in attrs, []))
            return
        if tag in BLOCK:
            nested = tag in LISTS and bool(self.lists)
            self.page.break_line(tag in SPACED and not nested)
        if tag == "pre" or tag in SHOWN_RAW:
            self.pre += 1
        elif tag in LISTS:
            self.lists.append(_number(attrs, "start", 1, 10**9) if tag == "ol" else None)
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            self.page.mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
        elif tag in ("blockquote", "dd"):
            self.page.indent += 2
        elif tag == "table":
            self.tables.append(_Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in CELLS and self.tables:
            self.pages.append(_Page())
        elif tag == "q":
            self.text('"')

    def _end_last(self, tags: Iterable[str], scope: Iterable[str]) -> None:
        """End the outermost open element of ``tags`` within the scope, with all it holds."""
        limit = self._nearest(scope)
        found = []
        for tag in tags:
            places = self.at.get(tag, [])
            first = bisect_right(places, limit)
            found += places[first : first + 1]
        if found:
            self._pop_to(min(found))

    def end(self, tag: str) -> None:
        at = self._nearest((tag,))
        if at < 0:
            if tag == "p" and not self.gone:
                self.page.break_line(True)
        elif tag in OUTSIDE_CELLS or at >= self._nearest(("td", "th", "table")):
            self._pop_to(at)

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            element = self.open.pop()
            self.at[element.tag].pop()
            if self.gone:
                self.gone -= element.gone
            else:
                self._close(element)
            self.visible = element.visible

    def _close(self, element: _Element) -> None:
        tag = element.tag
        if tag == "select" and self.choices is not None:
            (every, options), self.choices = self.choices, None
            chosen = [said for k, (selected, said) in enumerate(options) if every or selected] or [s for _, s in options[:1]]
            shown = chosen if every else chosen[-1:]
            for said in shown:
                self.page.say(" " if self.page.parts else "")
                self.page.say("".join(said))
                if every:
                    self.page.break_line()
            return
        if self.choices is not None:
            return
        if tag in CELLS and self.tables and len(self.pages) > 1:
            cell = self.pages.pop().text()
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append((cell, *element.span))
            return
        if tag == "q":
            self.text('"')
        if tag in BLOCK:
            self.page.break_line(tag in SPACED and not (tag in LISTS and len(self.lists) > 1), self.pre > 0)
        if tag == "table" and self.tables:
            lines = self.tables.pop().lines()
            if lines:
                if self.page.gap and self.page.lines:
                    self.page.lines.append("")
                self.page.lines += [" " * min(self.page.indent, WIDEST_INDENT) + line for line in lines]
                self.page.gap = True
        elif tag == "pre" or tag in SHOWN_RAW:
            self.pre -= 1
        elif tag in LISTS and self.lists:
            self.lists.pop()
        if tag in BLOCK:
            self.page.indent, self.page.mark = element.before if tag != "li" else (element.before[0], "")

    def text(self, data: str) -> None:
        if self.gone or not self.visible or not data:
            return
        if self.choices is not None:
            if self.choices[1]:
                self.choices[1][-1][1].append(data)
        elif self.pre:
            self.page.say_as_is(data)
        else:
            self.page.say(data)

    def done(self) -> str:
        self._pop_to(0)
        while len(self.pages) > 1:
            self.pages.pop()
        return self.page.text()


def visible_text(html: str | None) -> str | None:
    """The visible text of a page; null for null."""
    if html is None:
        return None
    out = Renderer()
    at = 0
    while (tag := html.find("<", at)) >= 0:
        if tag > at:
            out.text(unescape(html[at:tag]))
        at = tag
        if html.startswith("<!--", at):
            close = html.find("-->", at + 2)
            at = len(html) if close < 0 else close + 3
            continue
        end = html.startswith("/", at + 1)
        name = _TAG_NAME.match(html, at + 1 + end)
        if not name:
            if html[at + 1 : at + 2] in ("!", "?", "/"):
                close = html.find(">", at)
                at = len(html) if close < 0 else close + 1
            else:
                out.text("<")
                at += 1
            continue
        parsed = _attributes(html, name.end())
        if parsed is None:  # no later tag can end either
            break
        at, attrs = parsed
        tag_name = name[0].lower()
        if end:
            out.end(tag_name)
            continue
        out.start(tag_name, attrs)
        if tag_name in RAW:
            close = re.compile(rf"</{tag_name}(?=[\s/>])", re.I).search(html, at)
            stop = close.start() if close else len(html)
            if tag_name in SHOWN_RAW:
                said = html[at:stop].removeprefix("\n")
                out.text(unescape(said) if tag_name == "textarea" else said)
            at = stop
    out.text(unescape(html[at:]))
    return out.done()


def page_text(html: Column) -> Column:
    """The visible text of a column of pages. Null gives null, an empty page an empty text;
    broken markup is read as far as it goes, tags without an end count as text."""

    @F.arrow_udf("string")
    def render(pages: pa.Array) -> pa.Array:
        return pa.array([visible_text(p.as_py()) for p in pages], pa.string())

    return render(html)
