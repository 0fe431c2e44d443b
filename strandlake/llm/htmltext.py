"""Operator 4: layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags make the element tree; a renderer walks it with
visibility rules and writes what a reader would see: blocks on lines of their own with blank lines
where the default style has margins, list items with bullets or numbers, preformatted text as it is,
and table cells aligned in columns. Pages are independent, so this is one map over the table; tree
and walk use explicit stacks, so depth is bounded by memory only.

Not visible: scripts, styles, templates and other raw elements, the head, comments, elements with
`hidden` or `display: none`, text under `visibility: hidden` up to a `visibility: visible` inside,
closed details except their summary, hidden inputs. Everything else counts as visible, navigation and advertisements included.

Edge cases: null html gives empty text; text without any tag is a paragraph; unclosed and stray tags
follow the implied-tag rules; very long pages are read whole, and indents stop at 400 places;
repeated rows stay repeated; an empty table gives no rows; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template head title noscript iframe noembed noframes object audio video canvas svg math datalist".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote figure pre fieldset table".split())
BLOCK = CLOSES_P | frozenset("body html caption legend option optgroup select tr td th thead tbody tfoot textarea".split())
SCOPE = frozenset("table caption td th html body button template".split())
#: For each start tag, open elements that it closes, up to the first of its bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_HEAD_ONLY = frozenset("title meta link base style script noscript template head html".split())
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Builder:
    """Builds the element tree from tokens."""

    def __init__(self):
        self.root = Node("#root", {})
        self.open = [self.root]
        #: How many of each tag are open, so that an end tag that matches none costs nothing.
        self.held: dict[str, int] = {}

    def text(self, data: str) -> None:
        if data:
            if self.open[-1].tag == "head" and data.strip():
                self._pop_to(len(self.open) - 1)
            self.open[-1].children.append(data)

    def _pop_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.held[node.tag] -= 1
        del self.open[depth:]

    def _close(self, tags: set | frozenset, bounds: set | frozenset) -> None:
        """Close the outermost open element of tags inside the nearest bound."""
        if not any(self.held.get(t) for t in tags):
            return
        depth = None
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in bounds:
                break
            if self.open[at].tag in tags:
                depth = at
        if depth is not None:
            self._pop_to(depth)

    def start(self, tag: str, source: str, closed: bool) -> None:
        if self.held.get("head") and tag not in _HEAD_ONLY:
            self._close({"head"}, {"html"})
        if tag in ("html", "body") and self.held.get(tag):
            return
        if tag in CLOSES_P:
            self._close({"p"}, SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self.held.get("table") and not self._inside("tr", "table"):
            self._push(Node("tr", {}))
        node = Node(tag, attributes(source) if source.strip(" /\n\t") else {})
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _inside(self, tag: str, bound: str) -> bool:
        if not self.held.get(tag):
            return False
        for node in reversed(self.open):
            if node.tag == tag:
                return True
            if node.tag == bound:
                return False
        return False

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.held[node.tag] = self.held.get(node.tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif tag == "p" and not self.held.get("p"):
            self.open[-1].children.append(Node("p", {}))
        elif self.held.get(tag):
            walls = frozenset() if tag in ("table", "body", "html") else frozenset({"table"}) if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else frozenset({"td", "th", "table"})
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == tag:
                    return self._pop_to(at)
                if self.open[at].tag in walls:
                    return None
        return None


def parse(source: str) -> Node:
    """The element tree of a page."""
    builder, at = Builder(), 0
    low = None
    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            builder.text(entities.unescape(source[at:]))
            return builder.root
        if m.start() > at:
            builder.text(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[1]:
            builder.end(m[1].lower())
        elif m[2]:
            tag = m[2].lower()
            builder.start(tag, m[3] or "", (m[3] or "").rstrip().endswith("/"))
            if tag in RAW:
                low = low if low is not None else source.lower() if len(source.lower()) == len(source) else re.sub("[A-Z]", lambda c: c[0].lower(), source)
                end = low.find(f"</{tag}", at)
                end = len(source) if end < 0 else end
                raw = source[at:end]
                builder.text(entities.unescape(raw) if tag in ("textarea", "title") else raw)
                at = end


class Flow:
    """Lines of one text column; blank lines, indents and item markers are kept pending."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indents: list[int] = [0]
        self.marker = ""

    def _begin(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            indent = self.indents[-1]
            self.line.append((" " * max(0, indent - len(self.marker)) + self.marker).rjust(indent) if self.marker else " " * indent)
            self.marker = ""

    def text(self, data: str) -> None:
        words = re.split(r"[ \t\n\r\f]+", data)
        for i, word in enumerate(words):
            if i:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self._begin()
                self.line.append(word)
                self.space = False

    def verbatim(self, data: str) -> None:
        for i, part in enumerate(data.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                self._begin()
                self.line.append(part)

    def newline(self) -> None:
        self._begin()
        self.end()

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, margin: bool) -> None:
        self.end()
        if margin:
            self.gap = 1

    def result(self) -> list[str]:
        self.end()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Grid:
    """A table: cells by row and column, with spans."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}

    def row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.rows.append([])

    def cell(self, lines: list[str], colspan: int, rowspan: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        at = row[-1][0] + row[-1][1] if row else 0
        while self.taken.get(at):
            at += 1
        row.append((at, colspan, lines))
        if rowspan > 1:
            for c in range(at, at + colspan):
                self.taken[c] = rowspan

    def layout(self) -> list[str]:
        """The rows as lines; a column starts two places after every cell that ends before it, spanning ones too."""
        cells: dict[int, list[tuple[int, int]]] = {}
        for row in self.rows:
            for at, span, lines in row:
                cells.setdefault(at, []).append((span, max(map(len, lines), default=0)))
        columns = sorted(cells)
        starts, x = dict.fromkeys(columns, 0), 0
        for c in columns:
            x = starts[c] = max(starts[c], x)
            for span, width in cells[c]:
                if (j := bisect_left(columns, c + span)) < len(columns):
                    starts[columns[j]] = max(starts[columns[j]], x + width + 2)
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for at, _, lines in row:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(starts[at]) if len(line) <= starts[at] else line + "  "
                        line += lines[k]
                out.append(line.rstrip())
        return out


def _span(node: Node, name: str, most: int) -> int:
    value = re.match(r"\s*(\d{1,6})", node.attrs.get(name, ""))
    return min(most, max(1, int(value[1]))) if value else 1


def visible(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return False
    style = node.attrs.get("style")
    return not (style and _HIDING.search(style))


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows, grids, lists = [Flow()], [], []
    pre = 0
    todo: list = [(root, False, True)]
    while todo:
        node, leaving, shown = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if shown:
                flow.verbatim(node) if pre else flow.text(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th"):
                lines = flows.pop().result()
                if grids:
                    grids[-1].cell(lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534))
                else:
                    for line in lines:
                        flows[-1].newline() if not line else flows[-1].verbatim(line)
                        flows[-1].end()
                continue
            if tag == "table":
                laid = grids.pop().layout()
                flow.block(True)
                for line in laid:
                    flow.verbatim(line) if line else flow.newline()
                    flow.end()
                flow.block(True)
                continue
            if tag in ("pre", "textarea", "xmp"):
                pre -= 1
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag == "li" or tag in ("blockquote", "dd"):
                flow.block(False)
                flow.indents.pop()
                flow.marker = ""
            flow.block(tag in MARGIN and not (tag in ("ul", "ol", "menu", "dir") and lists))
            continue
        if not visible(node) and node is not root:
            continue
        # visibility is inherited, and a child may be visible again
        if (style := node.attrs.get("style")) and (said := _VISIBILITY.findall(style)):
            shown = said[-1].lower() == "visible"
        if not shown and tag in VOID:
            continue
        if tag == "br":
            flow.newline()
            continue
        if tag == "hr":
            flow.block(False)
            flow.text("---")
            flow.block(False)
            continue
        if tag == "input":
            if node.attrs.get("type", "").lower() in ("button", "submit", "reset", "") and node.attrs.get("value"):
                flow.text(node.attrs["value"])
            continue
        if tag in VOID:
            continue
        if tag == "table":
            flow.block(True)
            grids.append(Grid())
        elif tag == "tr" and grids:
            grids[-1].row()
        elif tag in ("td", "th"):
            flows.append(Flow())
        elif tag == "caption":
            flow.block(False)
        if tag in BLOCK and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot"):
            flow.block(tag in MARGIN and not (tag in ("ul", "ol", "menu", "dir") and lists))
        if tag in ("ul", "ol", "menu", "dir"):
            start = re.match(r"\s*(-?\d{1,9})", node.attrs.get("start", ""))
            lists.append([tag == "ol", int(start[1]) if start else 1])
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0]:
                value = re.match(r"\s*(-?\d{1,9})", node.attrs.get("value", ""))
                lists[-1][1] = int(value[1]) if value else lists[-1][1]
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            flow.indents.append(min(flow.indents[-1] + len(marker), 400))
            flow.marker = marker if shown else ""
        elif tag in ("blockquote", "dd"):
            flow.indents.append(min(flow.indents[-1] + 2, 400))
        elif tag in ("pre", "textarea", "xmp"):
            pre += 1
        keep = node.children
        if tag == "details" and "open" not in node.attrs:
            keep = [c for c in keep if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in BLOCK or tag == "#root":
            todo.append((node, True, shown))
        if tag in ("table", "thead", "tbody", "tfoot", "tr"):  # stray text between rows is white space
            keep = [c for c in keep if isinstance(c, Node) or c.strip()]
        todo.extend((c, False, shown) for c in reversed(keep))
    return "\n".join(flows[0].result())


def extract(source: str | None) -> str:
    """The visible text of one page."""
    return render(parse(source)) if source else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id and the visible text of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "text": [extract(h) for h in batch["html"]]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInPandas(run, "page_id long, text string")
