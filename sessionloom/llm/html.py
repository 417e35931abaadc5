"""Operator 6: text of web pages as it is laid out.

A tokeniser finds tags, text and raw-text elements; a tree builder keeps the open elements, supplies
the end tags that HTML lets authors leave out, and drops stray ones; rules of visibility decide what is
shown: nothing of head, scripts, styles, templates and embedded media, of elements that are not displayed by
attribute or inline style, nor comments; the text of drawings and formulas is, without their titles, descriptions and annotations. What is
invisible keeps its place, and may hold visible elements. The renderer emits all other text: white space is collapsed
outside preformatted text, blocks stand on lines of their own, paragraphs and headings between empty
lines, list items after bullets or numbers with an indent for each level, and the cells of a table in columns of equal width;
a cell that spans columns or rows stands in the first of them.

One pass without a shuffle; nothing recurses, so neither depth nor length of a page is limited.
Null pages give null, empty ones the empty text. Rows are treated each on its own; further columns are passed on.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

#: Letters that a cell may have to widen its column, and letters of a table as it is shown for each of its own letters and cells, at most.
WIDE, SPREAD = 200, 16

# Elements of HTML by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head title script style template noscript noembed noframes iframe object applet canvas audio video datalist map area param rp desc metadata defs symbol annotation annotation-xml".split())
HEAD = frozenset("title meta link base script style template noscript head".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr menu".split())
BLOCKS = SPACED | frozenset("html body div article section nav aside header footer main address li dt dd form figcaption details summary dialog hgroup center tr caption thead tbody tfoot legend optgroup option search".split())
ENDS_P = BLOCKS - frozenset("html body tr caption thead tbody tfoot legend optgroup option".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
BARRIER = frozenset("table td th caption html body template button object".split())

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_GAP = re.compile(r"[ \t\n\r\f]+")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_QUOTED = re.compile(r"""=\s*(["'])""")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
_SPAN = {k: re.compile(rf"{k}span\s*=\s*[\"']?(\d{{1,5}})", re.I) for k in ("col", "row")}


def tokens(page: str):
    """(kind, name or text, attributes) of a page: kind is text, open or close."""
    at, size = 0, len(page)
    last = {'"': page.rfind('"'), "'": page.rfind("'")}
    raw_end: dict[str, re.Pattern] = {}
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", html.unescape(page[at:]), ""
            return
        if lt > at:
            yield "text", html.unescape(page[at:lt]), ""
        m = _NAME.match(page, lt)
        if not m:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = size if end < 0 else end + 3
            elif lt + 1 < size and page[lt + 1] in "!?/":
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        p = m.end()
        while True:  # the end of the tag, past quoted values
            end = page.find(">", p)
            if end < 0:
                return
            quote = _QUOTED.search(page, p, end)
            if not quote or last[quote[1]] < quote.end():
                break
            p = page.find(quote[1], quote.end()) + 1
        name, inside = m[1].lower(), page[m.end() : end]
        at = end + 1
        if page[lt + 1] == "/":
            yield "close", name, ""
            continue
        yield "open", name, inside
        if name in RAW:
            stop = raw_end.setdefault(name, re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)).search(page, at)
            to = stop.start() if stop else size
            if name in ("textarea", "title"):
                yield "text", html.unescape(page[at:to]), ""
            elif to > at:
                yield "text", page[at:to], ""
            at = to


def look(name: str, attributes: str) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and whether it says that it is visible (None: it says nothing)."""
    if name in UNSEEN:
        return False, None
    visible = None
    if not attributes or "h" not in attributes.lower() and "style" not in attributes.lower():
        return True, visible
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "style" and _GONE.search(value) or key == "type" and name == "input" and value.lower() == "hidden":
            return False, None
        if key == "style":
            for said in _VISIBILITY.finditer(value):
                visible = said[1].lower() in ("visible", "initial")
    return True, visible


def span(attributes: str, of: str) -> int:
    """Columns or rows that a cell takes."""
    m = _SPAN[of].search(attributes)
    return max(1, min(int(m[1]), 100 if of == "col" else 65534)) if m else 1


class Box:
    """Text that is laid out line by line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank, self.indent, self.bullet = False, 0, "", ""

    def end_line(self, blank: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line, self.blank = [], 0
        self.gap = False
        self.blank = max(self.blank, blank)

    def start(self) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines += [""] * self.blank
            self.blank = 0
            self.line = [self.indent[: len(self.indent) - len(self.bullet)] + self.bullet if self.bullet else self.indent]
            self.bullet = ""

    def text(self, s: str) -> None:
        words = _GAP.split(s)
        before, after = words[0] == "", words[-1] == ""
        body = " ".join(w for w in words if w)
        if not body:
            self.gap = True if self.line else self.gap
            return
        if self.line and (self.gap or before):
            self.line.append(" ")
        self.start()
        self.line.append(body)
        self.gap = after

    def exact(self, s: str) -> None:
        parts = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, part in enumerate(parts):
            if k:
                self.start()
                self.lines.append("".join(self.line).rstrip(" "))
                self.line = []
            if part:
                self.start()
                self.line.append(part)

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Rows of cells (column, lines), without the empty ones."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.taken: dict[int, int] = {}  # by column, the last row that a cell from above reaches
        self.free = self.cells = 0  # the next column of the last row, and how many cells there were

    def row(self) -> None:
        self.rows.append([])
        self.free = 0

    def cell(self, lines: list[str], wide: int, tall: int) -> None:
        """Puts a cell into the first free column of the last row."""
        here = len(self.rows) - 1
        while self.taken.get(self.free, -1) >= here:
            self.free += 1
        if any(lines):
            self.rows[-1].append((self.free, lines))
        if tall > 1:
            self.taken |= dict.fromkeys(range(self.free, self.free + wide), here + tall - 1)
        self.free, self.cells = self.free + wide, self.cells + 1

    def lines(self) -> list[str]:
        """The rows with their cells in columns of equal width. A cell of more than WIDE letters widens no column. Where the columns would take more than SPREAD letters for each letter and cell of the table, as with many empty columns, cells are parted by two spaces alone."""
        rows = [r for r in self.rows if r]
        widths = {}
        for r in rows:
            for column, lines in r:
                widths[column] = max(widths.get(column, 0), max((len(x) for x in lines if len(x) <= WIDE), default=0))
        starts, at, last = {}, 0, -1
        for column in sorted(widths):
            at += 2 * (column - last - 1)  # columns without text
            starts[column] = at
            at, last = at + widths[column] + 2, column
        own = sum(len(x) for r in rows for _, lines in r for x in lines) + self.cells
        aligned = sum(starts[r[-1][0]] * max(len(lines) for _, lines in r) for r in rows) <= SPREAD * own
        out = []
        for r in rows:
            for i in range(max(len(lines) for _, lines in r)):
                line = ""
                for column, lines in r:
                    if i < len(lines) and lines[i]:
                        line = (line.ljust(starts[column]) if aligned else line) + ("  " if line and (not aligned or len(line) > starts[column] - 2) else "")
                        line += lines[i]
                out.append(line.rstrip(" "))
        return out


def render(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether they are displayed, and whether visible
    opened: dict[str, int] = {}
    boxes, tables, lists, body, pre = [Box()], [], [], False, 0
    boxes_of: list[str] = []
    spans: list[tuple[int, int]] = []
    fresh = False

    def shown() -> bool:
        return not stack or stack[-1][1]

    def close_one() -> None:
        nonlocal pre
        name, seen, _ = stack.pop()
        opened[name] -= 1
        if not seen:
            return
        box = boxes[-1]
        if name in ("td", "th") and boxes_of and boxes_of[-1] == "cell":
            boxes_of.pop()
            cell = boxes.pop().finish()
            size = spans.pop()
            if tables and tables[-1].rows:
                tables[-1].cell(cell, *size)
        elif name == "table" and boxes_of and boxes_of[-1] == "table":
            boxes_of.pop()
            loose = boxes.pop().finish()
            lines = tables.pop().lines()
            box = boxes[-1]
            box.end_line(1)
            for line in [*loose, *lines]:
                box.start()
                box.line.append(line)
                box.end_line()
            box.end_line(1)
        elif name in ("ul", "ol", "menu"):
            lists.pop()
            box.end_line(0 if lists else 1)
            box.indent = box.indent[:-2] if name != "ol" else box.indent[:-3]
        elif name == "blockquote":
            box.end_line(1)
            box.indent = box.indent[:-2]
        elif name == "dd":
            box.end_line()
            box.indent = box.indent[:-2]
        elif name == "pre":
            pre -= 1
            box.end_line(1)
        elif name in BLOCKS:
            box.end_line(1 if name in SPACED else 0)
            if name == "li":
                box.bullet = ""

    def close_to(names: tuple[str, ...] | frozenset, stop: tuple[str, ...] | frozenset) -> None:
        """Closes the nearest open element of names, and what is open in it, unless one of stop comes first."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    close_one()
                return
            if stack[k][0] in stop:
                return

    for kind, name, attributes in tokens(page):
        if kind == "text":
            if fresh and pre and name[:1] in "\r\n":  # the line break right after the tag is no text
                name = name.removeprefix("\r").removeprefix("\n")
            fresh = False
            if stack and stack[-1][0] == "head" and name.strip():
                close_to(("head",), ())
            if shown() and (not stack or stack[-1][2]) and not (tables and boxes_of and boxes_of[-1] == "table" and not name.strip()):
                (boxes[-1].exact if pre else boxes[-1].text)(name)
            continue
        if kind == "close":
            if name in ("html", "body"):
                continue
            if name == "br":
                kind = "open"
            elif name == "p" and not opened.get("p"):
                boxes[-1].end_line(1) if shown() else None
                continue
            elif opened.get(name):
                close_to((name,), BARRIER - {name} if name not in ("table", "tr", "thead", "tbody", "tfoot", "td", "th", "body", "html") else ("table",) if name != "table" else ())
                continue
            else:
                continue
        if name not in HEAD and opened.get("head"):
            close_to(("head",), ())
        if name in ("html", "body"):
            if not body:
                body = name == "body"
            continue
        if name in ENDS_P and opened.get("p"):
            close_to(("p",), BARRIER)
        if name in IMPLIED:
            wanted, stop = IMPLIED[name]
            while any(opened.get(w) for w in wanted):
                before = len(stack)
                close_to(wanted, stop)
                if len(stack) == before:
                    break
        if name in ("td", "th") and opened.get("table") and boxes_of and boxes_of[-1] == "table" and stack[-1][0] != "tr":
            stack.append(("tr", shown(), not stack or stack[-1][2]))
            opened["tr"] = opened.get("tr", 0) + 1
            tables[-1].row()
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if stack and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close_one()
        if name == "a" and opened.get("a"):
            close_to(("a",), BARRIER)
        displayed, visible = look(name, attributes)
        seen = shown() and displayed
        if name in VOID:
            if seen and name == "br":
                box = boxes[-1]
                if box.line:
                    box.end_line()
                elif box.lines:
                    box.blank = max(box.blank, 1)
            elif seen and name == "hr":
                boxes[-1].end_line(1)
            continue
        stack.append((name, seen, (not stack or stack[-1][2]) if visible is None else visible))
        opened[name] = opened.get(name, 0) + 1
        if not seen:
            continue
        box = boxes[-1]
        if name == "table":
            boxes.append(Box())
            boxes_of.append("table")
            tables.append(Table())
        elif name == "tr" and tables and boxes_of and boxes_of[-1] == "table":
            tables[-1].row()
        elif name in ("td", "th") and tables and boxes_of and boxes_of[-1] == "table":
            boxes.append(Box())
            boxes_of.append("cell")
            spans.append((span(attributes, "col"), span(attributes, "row")))
        elif name in ("ul", "ol", "menu"):
            box.end_line(0 if lists else 1)
            lists.append(0 if name == "ol" else None)
            box.indent += "   " if name == "ol" else "  "
        elif name == "li":
            box.end_line()
            if lists and lists[-1] is not None:
                lists[-1] += 1
                box.bullet = f"{lists[-1]}. "
            else:
                box.bullet = "- "
        elif name == "blockquote":
            box.end_line(1)
            box.indent += "  "
        elif name == "dd":
            box.end_line()
            box.indent += "  "
        elif name == "pre":
            box.end_line(1)
            pre += 1
            fresh = True
        elif name in BLOCKS:
            box.end_line(1 if name in SPACED else 0)
    while stack:
        close_one()
    lines = boxes[0].finish()
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, markup: str = "html", to: str = "text") -> DataFrame:
    """pages with the visible text of each; a column of that name is replaced."""
    prepare(pages.sparkSession)
    pages = pages.drop(to)

    def run(batches):
        for batch in batches:
            texts = pa.array([render(x) for x in batch.column(batch.schema.get_field_index(markup)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, to])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(to, T.StringType())]))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, n_lines, n_chars, text of every row of pages (page_id, html)."""
    done = extract(pages.select("page_id", F.col("html").cast("string").alias("html")))
    return done.select("page_id", F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"), "text")
