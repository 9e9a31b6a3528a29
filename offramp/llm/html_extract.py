"""Layout-aware text of HTML pages.

A small tree builder (implied end tags, void elements, raw text) turns the markup into a tree, and a
renderer walks it: invisible elements say nothing, blocks stand on lines of their own with
a blank line around paragraphs and headings, list items carry their bullet or number at the depth
of their list, tables are laid out in aligned columns, preformatted text keeps its spacing.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that show no text of their own.
HIDDEN = frozenset("head script style template noscript title meta link iframe object svg math select datalist "
                   "textarea canvas audio video dialog".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Blocks with a blank line around them, and blocks that only start and end a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
BLOCK = SPACED | frozenset("html body div section article main header footer nav aside address li dt dd tr caption thead "
                           "tbody tfoot form fieldset legend details summary figcaption center hgroup search menu".split())
#: An opening tag that ends an open element, unless one of the last column lies between.
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th caption", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "thead": ("thead tbody tfoot tr td th caption", ("table",)), "tbody": ("thead tbody tfoot tr td th caption", ("table",)),
    "tfoot": ("thead tbody tfoot tr td th caption", ("table",)), "option": ("option", ("select",)), "body": ("head", ()),
}
#: Elements that an end tag from inside cannot close.
_FENCE = frozenset("table td th caption button".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Depth beyond which elements are flattened into their ancestor.
MAX_DEPTH = 200


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def build_tree(html: str) -> Node:
    """The page as a tree of nodes and strings, with tags implied where they were left out."""
    root = Node("#root", {})
    stack = [root]

    def close(names: frozenset | tuple, stop: frozenset | tuple = ()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                del stack[depth:]
                return
            if stack[depth].tag in stop:
                return

    at = 0
    while at < len(html):
        found = _TOKEN.search(html, at)
        text = html[at:found.start()] if found else html[at:]
        if text:
            stack[-1].children.append(unescape(text))
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            close((tag,), _FENCE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else ("table",) if tag != "table" else ())
            continue
        if tag in BLOCK and tag != "html":
            close(("p",), _FENCE | {"li"} if tag != "li" else _FENCE)
        if tag in _CLOSES:
            names, stop = _CLOSES[tag]
            for _ in range(3):  # a row ends its cell, then the row before it
                close(tuple(names.split()), stop)
        attributes = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(found[3])}
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            stop_at = end.start() if end else len(html)
            node.children.append(html[at:stop_at])
            at = stop_at
            if end:
                closing = html.find(">", at)
                at = closing + 1 if closing >= 0 else len(html)
        elif tag not in VOID and len(stack) < MAX_DEPTH and not (found[3].rstrip().endswith("/") and tag not in BLOCK):
            stack.append(node)
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    return not (node.tag in HIDDEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(a.get("style", ""))
                or node.tag == "input")


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines of text with the blank lines that blocks ask for."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.blank = False
        self.prefix = self.first = ""

    def text(self, text: str) -> None:
        if self.words or text.strip(" \t\n\r\f\v"):
            self.words.append(text)

    def end_line(self, blank: bool = False) -> None:
        line = _SPACE.sub(" ", "".join(self.words)).strip(" ")
        self.words = []
        if line:
            self.put(line)
        self.blank = self.blank or blank

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append((self.first or self.prefix) + line)
        self.first = ""


def _render(node: Node, page: _Page, depth: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
        elif visible(child):
            _render_element(child, page, depth)


def _render_element(node: Node, page: _Page, depth: int) -> None:
    tag = node.tag
    if tag == "br":
        page.end_line()
    elif tag == "img":
        if node.attributes.get("alt"):
            page.text(f" {unescape(node.attributes['alt'])} ")
    elif tag == "pre":
        page.end_line(True)
        lines = _plain(node).strip("\n").split("\n")
        for line in lines:
            page.put(line.rstrip())
        page.end_line(True)
    elif tag == "table":
        page.end_line(True)
        _render_table(node, page, depth)
        page.end_line(True)
    elif tag in ("ul", "ol", "menu"):
        nested = depth > 0
        page.end_line(not nested)
        number = int(node.attributes["start"]) if node.attributes.get("start", "").isdigit() else 1
        for child in node.children:
            if isinstance(child, str):
                page.text(child)
            elif visible(child):
                if child.tag == "li":
                    page.end_line()
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    outer, before = page.prefix, page.first
                    page.first, page.prefix = page.prefix + mark, page.prefix + " " * len(mark)
                    _render(child, page, depth + 1)
                    page.end_line()
                    page.prefix, page.first = outer, before if page.first else ""
                else:
                    _render_element(child, page, depth)
        page.end_line(not nested)
    elif tag in ("td", "th"):
        page.text(" ")
        _render(node, page, depth)
        page.text(" ")
    elif tag in BLOCK:
        page.end_line(tag in SPACED)
        _render(node, page, depth)
        page.end_line(tag in SPACED)
    else:
        _render(node, page, depth)


def _plain(node: Node) -> str:
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(child)
        elif child.tag == "br":
            out.append("\n")
        elif visible(child):
            out.append(_plain(child))
    return "".join(out)


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and visible(child):
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _render_table(node: Node, page: _Page, depth: int) -> None:
    """Captions and stray text first, then rows with their cells padded to the column's width."""
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
        elif visible(child) and child.tag not in ("tr", "thead", "tbody", "tfoot"):
            page.end_line()
            _render_element(child, page, depth)
            page.end_line()
    page.end_line()
    table = []
    for row in _rows(node):
        cells = []
        for cell in row.children:
            if isinstance(cell, Node) and not visible(cell):
                continue
            inner = _Page()
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                inner.text(cell)
            elif cell.tag in ("td", "th"):
                _render(cell, inner, 0)
            else:
                _render_element(cell, inner, 0)
            inner.end_line()
            cells.append([line for line in inner.lines if line] or [""])
            span = cell.attributes.get("colspan", "") if isinstance(cell, Node) else ""
            cells += [[""]] * (min(int(span), 100) - 1 if span.isdigit() and int(span) > 1 else 0)
        table.append(cells)
    columns = max((len(r) for r in table), default=0)
    widths = [max((_width(line) for r in table if c < len(r) for line in r[c]), default=0) for c in range(columns)]
    wide = sum(widths) > 2000  # padding would outgrow the text: rows keep their cells, unaligned
    for row in table:
        for i in range(max((len(c) for c in row), default=0)):
            line = [c[i] if i < len(c) else "" for c in row]
            if not wide and columns > 1:
                line = [x + " " * (widths[k] - _width(x)) for k, x in enumerate(line)]
            joined = (" | " if wide else "  ").join(line).rstrip()
            if joined.strip():
                page.put(joined)


def html_text(html: str | None) -> str | None:
    """All visible text of a page, laid out; null stays null."""
    if html is None:
        return None
    page = _Page()
    _render(build_tree(html.replace("\r\n", "\n")), page, 0)
    page.end_line()
    return "\n".join(page.lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [html_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        lines = [None if t is None else sum(bool(x) for x in t.split("\n")) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(lines, pa.int64())],
                                         names=[*batch.schema.names[:-1], "text", "n_lines"])


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key, *keep, text, n_lines`` per row. Pages are rendered where they are read, without a shuffle.

    Null html gives null text and lines; an empty page, or one without visible text, gives ''. Broken
    markup is repaired, never refused. Null or repeated keys and repeated rows are rendered one by
    one; an empty table gives an empty result; columns not named are not read.
    """
    kept = [k for k in keep if k in pages.columns]
    given = pages.select(pages[key].alias("_key"), *[pages[k].alias(f"_keep_{k}") for k in kept], pages[html].alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    out = given.mapInArrow(_extract, f"{schema}, text string, n_lines bigint")
    return out.select(F.col("_key").alias(key), *[F.col(f"_keep_{k}").alias(k) for k in kept], "text", "n_lines")
