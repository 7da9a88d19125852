"""Layout-aware rendering of HTML pages as plain text.

A tree builder reads tags and text, closes what HTML lets pages leave open (paragraphs, list items,
table parts, the head), and ignores stray end tags. The renderer walks the tree: hidden elements are
left out, blocks stand on lines of their own, paragraphs and headings are set off by blank lines, list
items get bullets or numbers and an indent, table cells are padded to columns, and ``pre`` keeps its
white space. All other white space collapses.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element groups of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INVISIBLE = frozenset("head script style template iframe noembed noframes datalist object audio video canvas svg math title link meta base".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table caption thead tbody tfoot tr td th ul xmp textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure xmp".split())
HEAD_PARTS = frozenset("base basefont bgsound head html link meta noframes script style template title".split())
#: What a start tag closes, up to the elements that hold it in.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: Elements that an end tag or an implied end inside them does not reach out of.
WALLS = frozenset("table td th caption html template button".split())
#: Elements below this depth give their contents to the last one above it, so that no page is too deep to
#: walk; a hidden one among them still hides its own.
MAX_DEPTH = 200
#: Table columns are padded to at most so many characters.
MAX_PAD = 48

# possessive throughout: a token is read once from left to right, or not at all
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>]+)))?")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_START, _SPAN = re.compile(r"start\s*=\s*[\"']?(-?\d{1,9})", re.I), re.compile(r"colspan\s*=\s*[\"']?(\d{1,3})", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]{2,}|[\t\n\r\f]")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def hidden(node: Node) -> bool:
    """Whether an attribute of the element hides it: hidden, a style, or the type of an input."""
    if not node.attrs or not _MAY_HIDE.search(node.attrs):
        return False
    attrs: dict[str, str] = {}
    for m in _ATTR.finditer(node.attrs):
        attrs.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    if "hidden" in attrs or node.tag == "input" and attrs.get("type", "").strip().lower() == "hidden":
        return True
    style: dict[str, str] = {}
    for part in html.unescape(attrs.get("style", "")).lower().split(";"):
        name, _, value = part.partition(":")
        style[name.strip()] = value.split("!")[0].strip()
    return style.get("display") == "none" or style.get("visibility") in ("hidden", "collapse")


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings with entities decoded."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    places: dict[str, list[int]] = {}  # of the open elements of each tag, in the stack

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def last(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def pop_to(tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        k = last(tags)
        if k and k >= last(walls):
            cut(k)

    def text(a: int, b: int) -> None:
        body = page[a:b]
        if len(stack) > 1 and stack[-1].tag == "head" and not body.isspace():
            cut(len(stack) - 1)
        if body:
            stack[-1].children.append(html.unescape(body) if "&" in body else body)

    loose = -1  # from here on some quote never ends
    closing = page.rfind(">")  # behind it there are no more tags, only an open comment
    while at < n:
        start = page.find("<", at)
        if start > closing:
            start = page.find("<!--", at)
        if start < 0:
            break
        m = _TOKEN.match(page, start) if loose < 0 or start < loose or page.startswith("<!--", start) else _LOOSE.match(page, start)
        if m is None and loose < 0:
            m = _LOOSE.match(page, start)
            loose = start if m else loose
        if m is None:  # a lone <
            text(at, start + 1)
            at = start + 1
            continue
        if start > at:
            text(at, start)
        at = m.end()
        name = m.group(2) if m.lastindex and m.lastindex >= 2 else None
        if name is None:
            continue
        tag, attrs = name.lower(), m.group(3)
        if m.group(1):
            if tag not in VOID:
                pop_to({tag}, WALLS - {tag} if tag != "table" else frozenset({"html"}))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if stack[-1].tag == "head" and tag not in HEAD_PARTS:
            cut(len(stack) - 1)
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in CLOSES:
            closed, walls = CLOSES[tag]
            for _ in range(4 if tag in ("tr", "thead", "tbody", "tfoot") else 1):
                pop_to(closed, walls)
        if tag in BLOCK and tag not in ("html", "body", "option"):
            pop_to({"p"}, WALLS)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            body, at = page[at : end.start() if end else n], end.start() if end else n
            node.children.append(html.unescape(body) if tag in ("textarea", "title") and "&" in body else body)
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else n
        elif tag not in VOID and not attrs.endswith("/") or tag in BLOCK and tag != "hr":
            if len(stack) >= MAX_DEPTH:
                if tag not in INVISIBLE and not hidden(node):
                    node.children = stack[-1].children
                stack[-1].children[-1] = Node(tag)  # marks the place
            push(node)
    if at < n:
        text(at, n)
    return root


class Lines:
    """Text set line by line, with pending blank lines, an indent and a mark for the next line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.indent, self.mark = False, "", ""

    def end(self) -> None:
        if self.now:
            body = _SPACE.sub(" ", "".join(self.now)).strip(" ")
            self.now = []
            if body:
                self.put(body)

    def put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        if self.mark:
            self.lines.append(self.indent[: -len(self.mark)] + self.mark + line)
            self.mark = ""
        else:
            self.lines.append(self.indent + line)


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    out = Lines()
    _walk(parse(page), out, 0)
    out.end()
    return "\n".join(out.lines)


def _walk(node: Node, out: Lines, depth: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.now.append(child)
            continue
        tag = child.tag
        if tag in INVISIBLE or hidden(child):
            continue
        if tag == "br":
            out.end() if "".join(out.now).strip() else out.put("") if out.lines and out.lines[-1] and not out.gap else None
            out.now = []
            continue
        if tag not in BLOCK:
            _walk(child, out, depth)
            continue
        out.end()
        out.gap = out.gap or tag in SPACED and not (depth and tag in ("ul", "ol", "dl"))
        if tag in ("pre", "xmp", "textarea"):
            body: list[str] = []
            _raw(child, body)
            for line in "".join(body).removeprefix("\n").rstrip().split("\n") if body else ():
                out.put(line.rstrip())
        elif tag == "hr":
            out.put("---")
        elif tag in ("ul", "ol", "menu", "dir"):
            _list(child, out, depth)
        elif tag == "table":
            for line in _table(child, depth):
                out.put(line)
        elif tag in ("blockquote", "dd"):
            kept, out.indent = out.indent, out.indent + "  "
            _walk(child, out, depth)
            out.end()
            out.indent = kept
        else:
            _walk(child, out, depth)
            out.end()
        out.gap = out.gap or tag in SPACED and not (depth and tag in ("ul", "ol", "dl"))


def _raw(node: Node, body: list[str]) -> None:
    for child in node.children:
        if isinstance(child, str):
            body.append(child)
        elif child.tag == "br":
            body.append("\n")
        elif child.tag not in INVISIBLE and not hidden(child):
            _raw(child, body)


def _list(node: Node, out: Lines, depth: int) -> None:
    begin = _START.search(node.attrs)
    number = int(begin.group(1)) if begin else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if hidden(child):
                continue
            kept = out.indent
            mark = f"{number}. " if node.tag == "ol" else "- "
            out.indent, out.mark, number = kept + " " * len(mark), mark, number + 1
            _walk(child, out, depth + 1)
            out.end()
            out.indent, out.mark = kept, ""
        else:
            holder = Node("#part")
            holder.children = [child]
            _walk(holder, out, depth + 1)
            out.end()


def _gathered(node: Node) -> Iterator[Node]:
    """The children of a table part; each run of stray text and inline elements is one '#part'."""
    part = Node("#part")
    for child in node.children:
        if isinstance(child, str) or child.tag not in BLOCK and child.tag not in INVISIBLE:
            part.children.append(child)
            continue
        if part.children:
            yield part
            part = Node("#part")
        yield child
    if part.children:
        yield part


def _rows(node: Node) -> Iterator[Node]:
    """Rows, captions and stray contents of a table, hidden ones left out."""
    for child in _gathered(node):
        if child.tag in INVISIBLE or hidden(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child)
        else:
            yield child


def _table(node: Node, depth: int) -> list[str]:
    grid: list[list[list[str]]] = []
    wide: set[int] = set()  # cells over several columns set no column's width
    for row in _rows(node):
        cells: list[list[str]] = []
        parts = _gathered(row) if row.tag == "tr" else [row]
        for cell in parts:
            if cell.tag in INVISIBLE or hidden(cell):
                continue
            inner = Lines()
            holder = cell
            if cell.tag not in ("td", "th", "caption"):
                holder = Node("#part")
                holder.children = [cell]
            _walk(holder, inner, depth)
            inner.end()
            if cell.tag == "#part" and not inner.lines:  # white space between cells
                continue
            cells.append(inner.lines)
            span = int(m.group(1)) if (m := _SPAN.search(cell.attrs)) else 1
            if span > 1:
                wide.add(id(inner.lines))
                cells += [[] for _ in range(span - 1)]
        if any(cells):
            grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for k, lines in enumerate(cells[:-1]):
            if id(lines) in wide:
                continue
            widths[k] = max(widths.get(k, 0), max((len(x) for x in lines if len(x) <= MAX_PAD), default=0))
    done = []
    for cells in grid:
        for y in range(max(map(len, cells))):
            line = "".join((lines[y] if y < len(lines) else "").ljust(widths.get(k, 0) if k < len(cells) - 1 else 0) + "  " for k, lines in enumerate(cells))
            done.append(line.rstrip())
    return done


def extract_text(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, text) for every page row.

    Null and empty pages have empty text; broken markup never fails, what is no tag is text; repeated rows
    come out once each; an empty table gives no rows.
    """
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x) for x in batch.column("page").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return pages.select(pages[key].alias("key"), pages[page].alias("page")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
