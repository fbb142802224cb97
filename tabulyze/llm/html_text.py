"""Text of HTML pages as a reader sees it laid out.

A tree is built with the tags that HTML lets authors leave out; visibility rules remove what a
browser does not draw. Blocks stand on lines of their own, with a blank line where margins would
be; list items get bullets or numbers and are indented by depth; table cells are padded so that
columns line up, also those that span columns or rows. White space is folded outside `pre`.

Defined results: a null page gives null text, an empty one empty text; anything that cannot be
parsed as a tag is text, and so is all that follows a tag without an end; elements nest as deep as
they come; repeated rows are rendered one by one; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import col

#: Fixed values of the HTML standard: element names by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript title meta link datalist iframe noembed noframes svg "
    "object audio video canvas select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre section summary table caption ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre hr figure xmp".split())
#: A start tag of the key ends an open element of the value, up to the given border.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "thead": ({"caption", "colgroup"}, {"table"}), "body": ({"head"}, {"html"}),
}
HEAD_CONTENT = frozenset(
    "base basefont bgsound head link meta noframes noscript script style template title".split())
GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: A start tag of the key ends all that is open inside the nearest of the values.
TABLE_PLACES = dict.fromkeys(("caption", "colgroup", *GROUPS), {"table"}) | {
    "col": {"table", "colgroup"}, "tr": {"table"} | GROUPS,
    "td": {"table", "tr"} | GROUPS, "th": {"table", "tr"} | GROUPS,
}
PARAGRAPH_ENDERS = BLOCKS - {"html", "body", "caption"}

#: A quote opens a string only right after the equals sign; elsewhere it is a character of a name.
NAMED = r"[^\s/>][^\s/>=]*+"
VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{NAMED}(?:\s*+=\s*+(?:{VALUE}))?+)*+)>", re.S)
TAG_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
ATTRIBUTE = re.compile(rf"({NAMED})(?:\s*+=\s*+({VALUE}))?+")
SPACE = re.compile(r"[ \t\r\n\f]+")
NOT_DISPLAYED = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
WHOLE_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}
#: Fixed values of the HTML standard: the largest spans of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _attributes(text: str) -> dict[str, str]:
    """Values by name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


class Node:
    __slots__ = ("name", "children", "hidden", "seen", "number", "columns", "rows", "open")

    def __init__(self, name: str, attributes: str = "") -> None:
        self.name, self.children = name, []
        self.hidden, self.open = name in HIDDEN or name == "dialog", False
        self.seen = None  # as the parent, unless a style says more
        self.number = None  # of a list's first item, or of this item
        self.columns = self.rows = 1
        if attributes.strip():
            self._read(_attributes(attributes))

    def _read(self, found: dict[str, str]) -> None:
        style = found.get("style", "")
        self.open = "open" in found
        if self.name == "dialog" and self.open:
            self.hidden = False
        self.hidden |= ("hidden" in found or self.name == "input"
                        or bool(NOT_DISPLAYED.search(style)))
        if visibility := VISIBILITY.findall(style):
            self.seen = visibility[-1].lower() == "visible"
        if number := WHOLE_NUMBER.match(found.get("value" if self.name == "li" else "start", "")):
            self.number = int(number[1])
        if self.name in ("td", "th"):
            wide, high = (WHOLE_NUMBER.match(found.get(k, "")) for k in ("colspan", "rowspan"))
            if wide and int(wide[1]) > 0:
                self.columns = min(int(wide[1]), MOST_COLUMNS)
            if high and int(high[1]) >= 0:  # 0: all rows that follow
                self.rows = min(int(high[1]), MOST_ROWS) or MOST_ROWS


class Open:
    """The open elements, and where those of each name are."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], defaultdict(list)

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().name].pop()

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost element of some names, 0 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)


def build(page: str) -> Node:
    """The tree of a page, with elements closed and opened where the standard implies it."""
    root = Node("html")
    stack = Open(root)
    at = 0

    def text(data: str) -> None:
        if data:
            if stack.top.name in ("head", "colgroup") and data.strip():
                stack.cut(len(stack.nodes) - 1)
            if stack.top.name in ("table", "tbody", "thead", "tfoot", "tr") and not data.strip():
                return
            stack.top.children.append(html.unescape(data) if "&" in data else data)

    def close(names: Iterable[str], borders: Iterable[str]) -> None:
        while (place := stack.last(names)) > stack.last(borders):
            stack.cut(place)

    def clear(places: Iterable[str]) -> None:
        if (place := stack.last(places)) > stack.last(("template",)):
            stack.cut(place + 1)

    while begin := TAG_START.search(page, at):
        match = TAG.match(page, begin.start())
        if match is None:  # nothing ends this tag, hence none that begins inside it
            break
        text(page[at:match.start()])
        at = match.end()
        name = match.group(2)
        if name is None:
            continue
        name = name.lower()
        if match.group(1):
            if place := stack.last((name,)):
                if name in ("table", "body", "html") or place > stack.last(("table",)):
                    stack.cut(place)
            elif name == "br":
                stack.top.children.append(Node("br"))
            continue
        if name == "html":
            continue
        if stack.top.name == "head" and name not in HEAD_CONTENT and len(stack.nodes) > 1 \
                or stack.top.name == "colgroup" and name not in ("col", "template"):
            stack.cut(len(stack.nodes) - 1)
        if name in TABLE_PLACES:
            clear(TABLE_PLACES[name])
        if name in PARAGRAPH_ENDERS:
            close(("p",), ("table", "td", "th", "li", "div", "article", "section", "button"))
        if name in IMPLIED_ENDS:
            close(*IMPLIED_ENDS[name])
        if name in ("td", "th") and stack.top.name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack.top.children.append(row)
            stack.push(row)
        node = Node(name, match.group(3))
        stack.top.children.append(node)
        if name == "form" and (stack.top.name in GROUPS or stack.top.name in ("table", "tr")):
            continue  # holds nothing there; the rows belong to the table
        if name in VOID or match.group(3).endswith("/") and name in ("svg", "path"):
            continue
        if name in ("pre", "textarea"):  # the line end right after the tag is not drawn
            at += 2 if page.startswith("\r\n", at) else page.startswith("\n", at)
        if name in RAW:
            end = RAW_END[name].search(page, at)
            stop = end.start() if end else len(page)
            if name == "textarea":
                node.children.append(html.unescape(page[at:stop]))
            elif name == "xmp":
                node.children.append(page[at:stop])
            at = end.end() if end else len(page)
            continue
        stack.push(node)
    text(page[at:])
    return root


class Canvas:
    """Lines of text with pending white space and blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.mark = ""

    def write(self, data: str, pre: bool = False) -> None:
        if pre:
            first, *more = data.split("\n")
            self._put(first)
            for part in more:
                self.end_line(True)
                self._put(part)
            return
        folded = SPACE.sub(" ", data)
        if folded.startswith(" "):
            self.space = True
        if core := folded.strip(" "):
            self._put((" " if self.space and self.line else "") + core)
            self.space = folded.endswith(" ")

    def _put(self, data: str) -> None:
        if not data:
            return
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(self.indent + self.mark)
            self.mark = ""
        self.line.append(data)

    def end_line(self, even_empty: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif even_empty and self.lines:
            self.lines.append("")
        self.space = False

    def finish(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(node: Node, out: Canvas, pre: bool = False, depth: int = 0, number: str = "",
           seen: bool = True) -> Iterator[Iterator]:
    """Draws a node. Parts to be drawn in between are handed to `draw`, which keeps the stack."""
    if node.hidden:
        return
    name = node.name
    if node.seen is not None:
        seen = node.seen
    if name == "br":
        out.end_line(True)
        return
    if name == "table":
        yield _table(node, out, seen)
        return
    block = name in BLOCKS
    if block:
        out.end_line()
        out.blank |= name in SPACED and not (depth and name in ("ul", "ol", "menu"))
    if name == "hr" and seen:
        out.write("---")
    outer = out.indent
    if name == "li":
        out.mark = (number or "- ") if seen else ""
    elif name in ("blockquote", "dd"):
        out.indent += "  "
    listed = name in ("ul", "ol", "menu")
    count = 1 if node.number is None else node.number
    summary = True  # of closed details, the first summary alone is drawn
    for child in node.children:
        if name == "details" and not node.open:
            if isinstance(child, str) or child.name != "summary" or not summary:
                continue
            summary = False
        if isinstance(child, str):
            if seen:
                out.write(child, pre)
        elif child.name == "li":
            if listed:
                out.indent = outer + "  " * depth
            if child.number is not None:
                count = child.number
            mark = f"{count}. " if name == "ol" else "- "
            yield render(child, out, pre, depth + (1 if listed else 0), mark, seen)
            count += not child.hidden
        else:
            yield render(child, out, pre or child.name in ("pre", "textarea", "xmp"), depth,
                         seen=seen)
    out.indent = outer
    if name == "li":
        out.mark = ""
    if block:
        out.end_line()
        out.blank |= name in SPACED and not (depth and name in ("ul", "ol", "menu"))


def draw(part: Iterator[Iterator]) -> None:
    """Runs a part and those it hands over, on a stack of its own, however deep they nest."""
    parts = [part]
    while parts:
        inner = next(parts[-1], None)
        if inner is None:
            parts.pop()
        else:
            parts.append(inner)


def _rows(node: Node, seen: bool) -> list[tuple[Node, bool]]:
    """Rows of a table, and whether their text is visible."""
    rows = []
    for child in node.children:
        if isinstance(child, Node) and not child.hidden:
            shown = seen if child.seen is None else child.seen
            if child.name == "tr":
                rows.append((child, shown))
            elif child.name in GROUPS:
                rows += _rows(child, shown)
    return rows


def _misplaced(node: Node, out: Canvas, seen: bool) -> Iterator[Iterator]:
    """Captions, and what is neither a row nor a group of rows."""
    for child in node.children:
        if isinstance(child, str):
            if seen:
                out.write(child)
        elif child.name in GROUPS:
            if not child.hidden:
                yield _misplaced(child, out, seen if child.seen is None else child.seen)
        elif child.name not in ("tr", "colgroup"):
            yield render(child, out, seen=seen)


class Grid:
    """Cells by row, each at the first column that no cell above reaches into."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # column, end, lines
        self.reach: list[tuple[int, int, int]] = []  # column, end, rows left; by column

    def add(self, cells: list[tuple[int, int, list[str]]]) -> None:
        """Cells as (columns, rows, lines), from left to right."""
        placed, reach, at, k = [], [], 0, 0
        above = self.reach
        for columns, rows, lines in cells:
            while k < len(above) and above[k][0] <= at:
                at = max(at, above[k][1])
                k += 1
            end = at + columns
            placed.append((at, end, lines))
            if rows > 1:
                reach.append((at, end, rows - 1))
            at = end
        left = [(a, b, n - 1) for a, b, n in above if n > 1]
        self.reach = sorted(left + reach)
        if any(any(lines) for _, _, lines in placed):
            self.rows.append(placed)

    def lines(self) -> Iterator[str]:
        # Columns in which no cell begins take no place.
        begins = sorted({cell[0] for row in self.rows for cell in row})
        place = {column: i for i, column in enumerate(begins)}
        ends = sorted({cell[1] for row in self.rows for cell in row})
        after, i = {}, 0
        for end in ends:
            while i < len(begins) and begins[i] < end:
                i += 1
            after[end] = i
        rows = [[(place[a], after[b], lines) for a, b, lines in row] for row in self.rows]
        widths = [0] * len(begins)
        for row in rows:
            for a, b, lines in row:
                if b == a + 1:
                    widths[a] = max(widths[a], *map(len, lines))
        for a, b, lines in sorted((c for row in rows for c in row if c[1] > c[0] + 1),
                                  key=lambda c: (c[1], c[0])):
            room = sum(widths[a:b]) + 3 * (b - a - 1)
            widths[b - 1] += max(0, max(map(len, lines)) - room)
        for row in rows:
            for k in range(max(len(lines) for _, _, lines in row)):
                parts, at = [], 0
                for a, b, lines in row:
                    parts += [" " * w for w in widths[at:a]]  # of cells that reach down
                    room = sum(widths[a:b]) + 3 * (b - a - 1)
                    parts.append((lines[k] if k < len(lines) else "").ljust(room))
                    at = b
                yield " | ".join(parts).rstrip()


def _table(node: Node, out: Canvas, seen: bool) -> Iterator[Iterator]:
    out.end_line()
    out.blank = True
    rows = _rows(node, seen)
    yield _misplaced(node, out, seen)  # comes before the rows
    out.end_line()
    grid = Grid()
    for row, shown in rows:
        cells = []
        for cell in row.children:
            inner = Canvas()
            if isinstance(cell, str):
                if shown:
                    inner.write(cell)
            else:
                yield render(cell, inner, seen=shown)
            if (lines := inner.finish()) or isinstance(cell, Node) and not cell.hidden \
                    and cell.name != "form":
                spans = (cell.columns, cell.rows) if isinstance(cell, Node) else (1, 1)
                cells.append((*spans, lines.split("\n")))
        grid.add(cells)
    for line in grid.lines():
        out._put(line)
        out.end_line()
    out.blank = True


def page_text(page: str | None) -> str | None:
    if page is None:
        return None
    out = Canvas()
    draw(render(build(page), out))
    return out.finish()


def rendered(page: Column) -> Column:
    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([page_text(p) for p in pages.to_pylist()], pa.string())

    return texts(page)


def extracted(pages: DataFrame, id_column: str = "page_id",
              html_column: str = "html") -> DataFrame:
    """(id, text) for each page."""
    return pages.select(col(id_column).alias("id"), rendered(col(html_column)).alias("text")) \
        .withColumnRenamed("id", id_column)
