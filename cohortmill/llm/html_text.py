"""HTML extraction: a tree builder with implied tags, and a renderer that keeps the layout.

The builder opens and closes elements as a browser would for the usual
omissions (``p``, ``li``, ``dt``/``dd``, ``option``, table parts) and never fails
on broken markup; a quote that never closes ends with its tag. The renderer emits all visible text: blocks on lines of their
own with blank lines between paragraphs, list items with marks and indents, and
tables with aligned columns. Work is linear in the page, without recursion, and
the text is at most about a hundred times as long as the markup: a cell beyond
``WIDEST`` characters moves its row's later cells instead of widening its column.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortmill.llm import base

#: An attribute's name, and its value: only right after = can a quote open a string that holds >; one that never closes
#: ends with its tag.
NAME = r"[^\s/>][^\s/>=]*+"
VALUE = r"""\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]++)"""
MARKUP = re.compile(
    rf"""<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|{NAME}(?:{VALUE.replace("(", "(?:")}|\s*+=)?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S)
ATTRIBUTE = re.compile(rf"({NAME})(?:{VALUE})?")
#: Comments, strings and brackets of a style, which hold no declaration; and what can be a value's keyword.
STYLE_ASIDE = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'|\([^()]*\)""", re.S)
KEYWORD = re.compile(r"[a-z-]+(?:\s+[a-z-]+)*")
HIDING = {"display": {"none"}, "visibility": {"hidden", "collapse"}}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title meta link datalist "
                   "audio video canvas object".split())
#: Not shown where svg or math hold them; html elements that end an open svg or math.
ASIDE = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                     "listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
#: Blocks with a blank line around them, and blocks with a line break only.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote article section nav aside header footer main "
                      "figure fieldset form hr address".split())
LINE = frozenset("div li dt dd tr caption figcaption legend details summary body html center thead tbody tfoot "
                 "menu dir option optgroup dialog textarea text".split())
#: An opening tag in the set ends an open element of the key's kind, unless one of the barriers lies between.
BLOCKS = (PARAGRAPH | LINE) - {"caption", "tr", "thead", "tbody", "tfoot", "option", "optgroup", "body", "html", "textarea", "text"}
CLOSED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "optgroup": {"optgroup"}, "td": {"td", "th", "tr", "thead", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "thead", "tbody", "tfoot"}, "tr": {"tr", "thead", "tbody", "tfoot"},
    "thead": {"thead", "tbody", "tfoot"}, "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"},
    "caption": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "head": {"body"},
}
CLOSERS: dict[str, set[str]] = {}
for _open, _by in CLOSED_BY.items():
    for _tag in _by:
        CLOSERS.setdefault(_tag, set()).add(_open)
BARRIER = frozenset("table td th caption button object ul ol dl menu select template".split())
OWN_BARRIER = {
    "td": {"table"}, "th": {"table"}, "tr": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"},
    "li": {"ul", "ol", "menu", "table", "td", "th"}, "dt": {"dl", "table"}, "dd": {"dl", "table"},
}
SPACE = re.compile(r"[\x20\t\n\r\f]+")
#: Widest column and widest gap before a cell, in characters; rows that a cell may reach down, and columns if it does.
WIDEST, WIDEST_SPAN, ROWSPAN = 80, 400, 20


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "foreign")

    def __init__(self, tag: str, attrs: str, parent: Node | None, foreign: bool = False):
        self.tag, self.attrs, self.parent, self.children, self.foreign = tag, attrs, parent, [], foreign


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        quoted = value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]
        out.setdefault(name.lower(), html.unescape(value[1:-1] if quoted else value))
    return out


def tree(source: str) -> Node:
    """The element tree; children are nodes and texts with character references resolved."""
    root = Node("#root", "", None)
    here, at = root, 0
    #: Open elements from the root down, and the places of each tag's open elements in that path.
    path: list[Node] = []
    opened: dict[str, list[int]] = {}

    def text(piece: str) -> None:
        if piece:
            here.children.append(html.unescape(piece) if "&" in piece else piece)

    def enter(node: Node) -> Node:
        opened.setdefault(node.tag, []).append(len(path))
        path.append(node)
        return node

    def close(place: int) -> Node:
        """Ends everything down to and with the element at a place of the path; where to go on."""
        parent = path[place].parent
        while len(path) > place:
            opened[path.pop().tag].pop()
        return parent

    def nearest(tags: set[str], barrier: frozenset | set | tuple) -> int | None:
        """Place of the innermost open element in ``tags``, unless one in ``barrier`` lies inside it."""
        found = max((opened[t][-1] for t in tags if opened.get(t)), default=-1)
        wall = max((opened[t][-1] for t in barrier if opened.get(t) and t not in tags), default=-1)
        return found if found > wall else None

    while match := MARKUP.search(source, at):
        text(source[at:match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if opened.get(tag):
                barrier = OWN_BARRIER.get(tag, () if tag in BARRIER else {"td", "th", "table"})
                if (place := nearest({tag}, barrier)) is not None:
                    here = close(place)
            elif tag in ("p", "br"):
                here.children.append(Node(tag, "", here))
            continue
        foreign = bool(opened.get("svg") or opened.get("math")) and not opened.get("foreignobject")
        if foreign and tag in BREAKOUT and not opened.get("annotation-xml"):
            while opened.get("svg") or opened.get("math"):
                here = close(nearest({"svg", "math"}, ()))
            foreign = False
        if (ends := CLOSERS.get(tag)) and any(opened.get(t) for t in ends):
            while True:
                live = {t for t in ends if opened.get(t)}
                barrier = OWN_BARRIER.get(tag, BARRIER - live)
                place = nearest(live, barrier) if live else None
                if place is None:
                    break
                here = close(place)
        if tag in ("td", "th") and opened.get("table") and here.tag != "tr":
            here.children.append(row := Node("tr", "", here))
            here = enter(row)
        here.children.append(node := Node(tag, match[3], here, foreign))
        if tag in VOID or match[3].endswith("/") and (foreign or tag in ("svg", "math", "path")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            stop, after = (end.start(), end.end()) if end else (len(source), len(source))
            if tag not in ("script", "style"):
                content = html.unescape(source[at:stop])
                node.children.append(re.sub(r"\A\r?\n", "", content) if tag == "textarea" else content)
            at = after
            continue
        here = enter(node)
    text(source[at:])
    return root


def hiding(style: str) -> bool:
    """Whether a style's declarations hide: of a property the last one counts, and important ones before others."""
    last: dict[str, tuple[bool, str]] = {}
    for declaration in STYLE_ASIDE.sub(" ", style.lower()).split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        name, value = name.strip(), value.strip()
        if name in HIDING and KEYWORD.fullmatch(value) and bool(mark) >= last.get(name, (False,))[0]:
            last[name] = (bool(mark), value)
    return any(value in HIDING[name] for name, (_, value) in last.items())


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN or node.foreign and node.tag in ASIDE:
        return True
    if node.tag == "dialog" and "open" not in attributes(node.attrs):
        return True
    if not node.attrs:
        return False
    low = node.attrs.lower()
    if "hidden" not in low and "none" not in low and "collapse" not in low:
        return False
    attrs = attributes(node.attrs)
    return "hidden" in attrs or hiding(attrs.get("style", ""))


class Page:
    """Lines under construction: text of the open line, and the breaks that are due before more."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap = False
        self.due = 0
        self.prefix: list[str] = []
        self.mark = ""

    def write(self, piece: str, keep: bool) -> None:
        if keep:
            for i, line in enumerate(piece.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if i:
                    self.end_line(True)
                if line:
                    self.begin()
                    self.words.append(line)
            return
        body = SPACE.sub(" ", piece)
        if body == " ":
            self.gap = self.gap or bool(self.words)
            return
        if not body:
            return
        lead, trail = body[0] == " ", body[-1] == " "
        self.begin()
        if self.words and (self.gap or lead):
            self.words.append(" ")
        self.words.append(body.strip(" "))
        self.gap = trail

    def begin(self) -> None:
        if not self.words and self.due > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.due = 0

    def end_line(self, even_empty: bool = False) -> None:
        if self.words or even_empty:
            line = "".join(self.words)
            indent = "".join(self.prefix)
            if self.mark and line:
                indent = indent[:len(indent) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append((indent + line).rstrip(" ") if line else "")
            self.words.clear()
        self.gap = False

    def block(self, breaks: int) -> None:
        self.end_line()
        self.due = max(self.due, breaks)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _span(node: Node, name: str, most: int) -> int:
    if name not in node.attrs.lower():
        return 1
    value = attributes(node.attrs).get(name, "1").strip()
    return min(max(int(value), 1), most) if value.isdecimal() and len(value) < 6 else 1


class Filled(NamedTuple):
    """A table cell: its text, and the columns and rows that it spans."""
    text: str
    columns: int
    rows: int


def placed(rows: list[list[Filled]]) -> list[list[tuple[int, Filled]]]:
    """Each row's cells with their first column; cells that reach down from earlier rows keep their columns."""
    out, busy = [], {}
    for row in rows:
        line, column = [], 0
        for cell in row:
            while busy.get(column, 0) > 0:
                column += 1
            line.append((column, cell))
            column += cell.columns
        busy = {c: n - 1 for c, n in busy.items() if n > 1}
        for column, cell in line:
            if cell.rows > 1:
                busy.update((c, cell.rows - 1) for c in range(column, column + min(cell.columns, ROWSPAN)))
        out.append(line)
    return out


def table_lines(rows: list[list[Filled]]) -> list[str]:
    """A line per row of cells, in columns two spaces apart; the columns of cells from above stay blank."""
    cells = placed([[c._replace(text=SPACE.sub(" ", c.text.replace("\n", " ")).strip(" ")) for c in row] for row in rows])
    widths: dict[int, int] = {}
    for row in cells:
        for column, cell in row:
            if cell.columns == 1 and len(cell.text) <= WIDEST:
                widths[column] = max(widths.get(column, 0), len(cell.text))
    last, begins = max(widths, default=-1), [0]
    for column in range(last + 1):
        begins.append(begins[-1] + widths.get(column, 0) + 2)
    out = []
    for row in cells:
        line, at = [], 0
        for column, cell in row:
            begin = begins[column] if column <= last else begins[-1] + 2 * (column - last - 1)
            line += [" " * max(min(begin - at, WIDEST_SPAN), 2 if line else 0), cell.text]
            at += len(line[-2]) + len(cell.text)
        out.append("".join(line).rstrip(" "))
    return [line for line in out if line.strip()]


def render(source: str | None) -> str:
    """All visible text of a page; empty for null."""
    if not source:
        return ""
    page = Page()
    tables: list[list[list[Filled]]] = []
    lists: list[list] = []
    keep = 0
    stack: list[tuple[Node | str, bool]] = [(tree(source.replace("\x00", "")), False)]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            page.write(node, keep > 0)
            continue
        tag = node.tag
        in_table = bool(tables)
        if leaving:
            if tag in ("td", "th") and in_table:
                cell, page = page.text(), node.page
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append(Filled(cell, _span(node, "colspan", 1000), _span(node, "rowspan", ROWSPAN)))
                continue
            if tag == "table":
                page.block(2)
                for line in table_lines(tables.pop()):
                    page.begin()
                    page.words.append(line)
                    page.end_line()
                page.block(2)
                continue
            if tag in ("pre", "textarea"):
                keep -= 1
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                page.block(1 if lists else 2)
            elif tag == "li":
                page.end_line()
                page.prefix.pop()
                page.mark = ""
                page.block(1)
            elif tag in ("dd", "blockquote"):
                page.end_line()
                page.prefix.pop()
                page.block(1 if tag == "dd" else 2)
            elif tag in PARAGRAPH:
                page.block(1 if lists and tag == "p" else 2)
            elif tag in LINE:
                page.block(1)
            continue
        if hidden(node):
            continue
        if tag == "br":
            page.begin()
            page.end_line(True)
            continue
        if tag == "hr":
            page.block(2)
            continue
        if tag == "tr" and in_table:
            tables[-1].append([])
        elif tag in ("td", "th") and in_table:
            holder = Cell(tag, node.attrs, node.parent)
            holder.page = page
            page = Page()
            stack.append((holder, True))
            stack.extend((c, False) for c in reversed(node.children))
            continue
        elif tag == "table":
            page.block(2)
            tables.append([])
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(1 if lists else 2)
            start = attributes(node.attrs).get("start", "") if tag == "ol" and "start" in node.attrs.lower() else ""
            number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            lists.append([tag, number])
        elif tag == "li":
            page.block(1)
            if lists and lists[-1][0] == "ol":
                page.mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                page.mark = "- "
            page.prefix.append(" " * len(page.mark))
        elif tag in ("dd", "blockquote"):
            page.block(1 if tag == "dd" else 2)
            page.prefix.append("  ")
        elif tag in PARAGRAPH:
            page.block(1 if page.mark else 2)
        elif tag in LINE:
            page.block(1)
        if tag in ("pre", "textarea"):
            keep += 1
        stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
    return page.text()


class Cell(Node):
    """A table cell that is being rendered, with the page that it interrupts."""
    __slots__ = ("page",)


def extract(pages: DataFrame, markup: str = "html", out: str = "text") -> DataFrame:
    """All columns but the markup, and its visible text; an input column ``out`` is replaced."""
    carried = [c for c in base.beside(pages, [out]) if c != markup]
    narrow = pages.select(F.struct(*[base.named(c) for c in carried]).alias("_row"), base.named(markup).cast("string").alias("_markup"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([render(t.as_py()) for t in batch.column("_markup")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), texts], ["_row", "_rendered"])

    schema = narrow.drop("_markup").schema.add("_rendered", T.StringType())
    return narrow.mapInArrow(run, schema).select("_row.*", F.col("_rendered").alias(out))
