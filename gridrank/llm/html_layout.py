"""Visible text of HTML pages, laid out.

A tree builder adds the tags that HTML implies: a paragraph ends at the next
block, list items, rows, cells, options and terms end at the next of their kind
or with what holds them, and end tags without a start are ignored. Elements that
a browser doesn't show are left out: head matter, scripts, styles, templates,
hidden inputs, and whatever is `hidden`, `display: none` or, unless a descendant
is made visible, `visibility: hidden`.

The renderer emits all visible text. White space within lines collapses, outside
`pre`; paragraphs and headings stand between blank lines, other blocks on lines
of their own; list items are indented by depth and have bullets or numbers;
table cells are padded to the width of their columns, and a cell that spans
columns takes their widths. Alternative texts of images are shown in brackets.

A null page gives a null text, an empty page an empty one. Pages are read whole,
however deep: nothing here recurses. Repeated rows each get a row and ids may be
null. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head title script style template noscript noframes datalist object iframe audio video canvas svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table textarea ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: A start tag ends these, up to the elements that hold them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: What an end tag can't reach beyond.
SCOPES = frozenset("table td th caption html template".split())

_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


class Builder(HTMLParser):
    """The tree of a page, below one root."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def _end(self, tags: set[str], holders: set[str]) -> None:
        """Close the outermost open element among tags that lies within the innermost of holders."""
        at = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in holders:
                break
            if self.open[i].tag in tags:
                at = i
        if at is not None:
            del self.open[at:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "html":
            self.root.attrs |= dict(attrs)
            return
        if tag in ENDS_P:
            self._end({"p"}, SCOPES | {"button"})
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self._push("tbody", {})
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if self.open[-1].tag == "table":
                self._push("tbody", {})
            self._push("tr", {})
        if self.open[-1].tag == "head" and tag not in UNSEEN and tag not in ("meta", "link", "base"):
            self.open.pop()
        self._push(tag, dict(attrs))
        if tag in VOID:
            self.open.pop()

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML but what is void anyway

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self._push("p", {})
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPES and tag not in ("table", "thead", "tbody", "tfoot", "tr", "body"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the element takes part at all, and whether its own text is visible."""
    style = node.attrs.get("style") or ""
    if node.tag in UNSEEN or "hidden" in node.attrs or _NONE.search(style) or (node.tag == "input" and (node.attrs.get("type") or "").lower() == "hidden"):
        return False, False
    found = _VISIBILITY.findall(style)
    return True, found[-1].lower() not in ("hidden", "collapse") if found else visible


class Lines:
    """Text as it is laid out: words collapse into lines, lines keep an indent, blank lines are asked for and given once."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.indent: list[str] = []
        self.mark: str | None = None

    def words(self, text: str) -> None:
        parts = _SPACE.split(text)
        for k, part in enumerate(parts):
            if k:
                self.space = bool(self.now)
            if part:
                if self.space:
                    self.now.append(" ")
                self.now.append(part)
                self.space = False

    def raw(self, text: str) -> None:
        first, *more = text.replace("\r\n", "\n").split("\n")
        self.now.append(first)
        for line in more:
            self.end(keep=True)
            self.now.append(line)

    def end(self, blank: bool = False, keep: bool = False) -> None:
        line = "".join(self.now)
        if line or keep or self.mark is not None:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.done.append(("".join(self.indent) + (self.mark or "") + line).rstrip())
            if self.mark is not None:
                self.indent.append(" " * len(self.mark))
                self.mark = None
        self.now, self.space = [], False
        self.blank |= blank

    def text(self) -> str:
        self.end()
        return "\n".join(self.done).strip("\n")


def _span(node: Node, name: str = "colspan", most: int = 1000) -> int:
    value = (node.attrs.get(name) or "1").strip()
    if not re.fullmatch(r"[0-9]{1,9}", value):
        return 1
    if name == "rowspan" and not int(value):  # to the end of the table
        return most
    return min(most, max(1, int(value)))


def _spread(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int]]]:
    """Rows of (text, columns, rows) as rows of (text, columns), with an empty cell wherever one from above reaches down."""
    held: dict[int, int] = {}
    out = []
    for row in rows:
        at, cells, begun = 0, [], {}
        for text, span, down in row:
            while at in held:
                cells.append(("", 1))
                at += 1
            cells.append((text, span))
            if down > 1:
                begun |= dict.fromkeys(range(at, at + span), down)
            at += span
        held = {c: n - 1 for c, n in (held | begun).items() if n > 1}
        out.append(cells)
    return out


def _aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Lines of a table: one line for each line of a row's tallest cell, columns as wide as their widest cell that spans no other."""
    width: dict[int, int] = {}
    for row in rows:
        at = 0
        for text, span in row:
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(len, text.split("\n"))))
            at += span
    for row in rows:  # what is too wide for its columns widens the last of them
        at = 0
        for text, span in row:
            if span > 1:
                have = sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                width[at + span - 1] = width.get(at + span - 1, 0) + max(0, max(map(len, text.split("\n"))) - have)
            at += span
    out = []
    for row in rows:
        cells = [(text.split("\n"), span) for text, span in row]
        for k in range(max((len(c) for c, _ in cells), default=0)):
            at, line = 0, []
            for lines, span in cells:
                room = sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(room))
                at += span
            out.append("  ".join(line).rstrip())
    return out


def render(html: str | None) -> str | None:
    if html is None:
        return None
    builder = Builder()
    builder.feed(html)
    builder.close()
    # Steps are taken from a stack: a node to open, or a call for its end.
    out = [Lines()]
    tables: list[list[list[tuple[str, int, int]]]] = []
    lists: list[list] = []
    pre = [False]
    todo: list = [(builder.root, True)]
    while todo:
        step = todo.pop()
        if callable(step):
            step()
            continue
        node, visible = step
        if isinstance(node, str):
            if visible:
                (out[-1].raw if pre[-1] else out[-1].words)(node)
            continue
        takes_part, visible = _shown(node, visible)
        if not takes_part:
            continue
        tag, lines = node.tag, out[-1]
        after: list = []
        if tag == "br":
            lines.end(keep=True)
            continue
        if tag == "hr":
            lines.end(blank=True)
            if visible:
                lines.now.append("---")
            lines.end(blank=True)
            continue
        if tag == "img":
            if visible and (alt := (node.attrs.get("alt") or "").strip()):
                lines.words(f" [{_SPACE.sub(' ', alt)}] ")
            continue
        if tag == "input":
            if visible and (value := node.attrs.get("value")):
                lines.words(f" {value} ")
            continue
        if tag == "table":
            lines.end(blank=True)
            tables.append([])

            def close_table(lines=lines):
                lines.end()  # what a caption or text straight within the table left open
                for line in _aligned(_spread(tables.pop())):
                    lines.now.append(line)
                    lines.end(keep=True)
                lines.end(blank=True)

            after.append(close_table)
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables and tables[-1]:
            out.append(Lines())

            def close_cell(node=node):
                tables[-1][-1].append((out.pop().text(), _span(node), _span(node, "rowspan", 65_534)))

            after.append(close_cell)
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = bool(lists)
            lines.end(blank=not nested)
            start = (node.attrs.get("start") or "1").strip()
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])

            def close_list(lines=lines, nested=nested):
                lists.pop()
                lines.end(blank=not nested)

            after.append(close_list)
        elif tag == "li":
            lines.end()
            lists_now = lists[-1] if lists else [False, 1]
            depth = len(lines.indent)
            lines.mark = f"{lists_now[1]}. " if lists_now[0] else "- "
            lists_now[1] += 1

            def close_item(lines=lines, depth=depth):
                lines.end()
                lines.mark = None
                del lines.indent[depth:]

            after.append(close_item)
        elif tag in ("blockquote", "dd"):
            lines.end(blank=tag in SPACED)
            lines.indent.append("  ")

            def close_indent(lines=lines, tag=tag):
                lines.end(blank=tag in SPACED)
                lines.indent.pop()

            after.append(close_indent)
        elif tag in BLOCKS:
            # The mark of a list item stays for the first line within.
            if lines.now or lines.mark is None:
                lines.end(blank=tag in SPACED)
            if tag in ("pre", "textarea"):
                pre.append(True)

            def close_block(lines=lines, tag=tag):
                if tag in ("pre", "textarea"):
                    pre.pop()
                if lines.now or lines.mark is None:
                    lines.end(blank=tag in SPACED)

            after.append(close_block)
        children = node.children
        if tag in ("pre", "textarea") and children and isinstance(children[0], str):  # a line end right after the tag is not shown
            children = [re.sub(r"^(\r\n|\n|\r)", "", children[0]), *children[1:]]
        elif tag == "details" and "open" not in node.attrs:  # only the first summary is shown
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        todo += reversed(after)
        todo += [(child, visible) for child in reversed(children)]
    return out[0].text()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, len(batch), 500):
            part = batch.slice(s, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(render, part.column(1).to_pylist()), pa.string())], ["id", "text"])


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and visible text of each row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
