"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a text renderer.

Blocks are set apart by blank lines, list items get markers and indents, and table cells stand in aligned columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set("head script style template noscript title meta link datalist iframe noembed noframes object audio video canvas svg param source track".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCKS = SPACED | set("html body div section article aside header footer nav main address li dt dd tr caption thead tbody tfoot td th form figcaption details summary dialog center dir menu legend option search hgroup".split())
#: What a head may hold; any other tag, and text, ends it.
HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
#: What an opening tag closes first, and what hides elements further up from it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th", "caption"}, "th": {"td", "th", "caption"}}
CLOSES |= {t: {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"} for t in ("thead", "tbody", "tfoot")}
LIMITS = {"li": {"ul", "ol", "menu", "dir", "table", "td", "th"}, "dt": {"dl", "table", "td", "th"}, "dd": {"dl", "table", "td", "th"}, "option": {"select", "datalist"}}
#: Where a part of a table goes; a table, section or row takes these children, and others stand in front of the table.
HOLDERS = {t: {"table"} for t in ("caption", "colgroup", "thead", "tbody", "tfoot")}
HOLDERS |= {"col": {"table", "colgroup"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"table", "thead", "tbody", "tfoot", "tr"}}
HOLDERS["th"] = HOLDERS["td"]
TAKEN = {*HOLDERS, "form", "script", "style", "template"}
#: Elements nested deeper become siblings; a column is at most padded to so many characters.
DEPTH, COLUMN = 200, 60

#: A quote opens a value directly after the equals sign of an attribute; elsewhere it is a character like others.
NAME, VALUE = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+", r"[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"{0}[^\"]*+{1}(?:\"|\Z)|'{0}[^']*+{1}(?:'|\Z)|{0}[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+{1}|(?=>|\Z))"
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|" + NAME + "(?:" + VALUE.format("", "") + r")?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(f"({NAME})(?:{VALUE.format('(', ')')})?+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def tree(html: str) -> Node:
    root = Node("body", {})
    stack, at = [root], 0

    def close(tags: set[str], limits: set[str]) -> None:
        """Close the outermost open element of `tags` that no element of `limits` hides."""
        last = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in limits:
                break
            if stack[i].tag in tags:
                last = i
        if last:
            del stack[last:]

    def table_at() -> int:
        """Where the table is whose cell, caption or template is not open; 0 without one."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ("td", "th", "caption", "template"):
                return 0
            if stack[i].tag == "table":
                return i
        return 0

    def put(item: Node | str) -> None:
        """Append to the open element, or in front of the table where that takes no such child."""
        if stack[-1].tag in HOLDERS["td"] or stack[-1].tag == "colgroup":
            taken = item.isspace() if isinstance(item, str) else item.tag in TAKEN
            if not taken and (at := table_at()):
                stack[at - 1].children.insert(-1, item)  # an open table is the last child
                return
        stack[-1].children.append(item)

    def leave_head(body: bool = False) -> None:
        """Close an open head and what is open in it; a template stays open, and a noscript does until the <body> tag."""
        for i, node in enumerate(stack):
            if node.tag == "head":
                if not any(n.tag == "template" or n.tag == "noscript" and not body for n in stack[i:]):
                    del stack[i:]
                return

    def say(text: str) -> None:
        if text:
            if text.strip(" \t\n\f\r"):
                leave_head()
            put(unescape(text) if "&" in text else text)

    while found := TOKEN.search(html, at):
        say(html[at:found.start()])
        at = found.end()
        end, tag = found[1], (found[2] or "").lower()
        if not tag:
            continue
        if end:
            if any(n.tag == tag for n in stack[1:]):
                close_from = max(i for i, n in enumerate(stack) if n.tag == tag)
                if tag in ("table", "body", "html") or not any(n.tag == "table" for n in stack[close_from:]):
                    del stack[max(1, close_from):]
            elif tag == "p":
                put(Node("p", {}))
            elif tag == "br":
                put(Node("br", {}))
            continue
        if tag == "body":
            leave_head(True)
        if tag in ("html", "body") or tag == "head" and any(n.tag == "head" for n in stack):
            continue
        if tag not in HEAD:
            leave_head()
        if tag in CLOSES:
            close(CLOSES[tag], LIMITS.get(tag, {"table", "template"}))
        if tag in BLOCKS:
            close({"p"}, {"td", "th", "table", "li", "dd", "button", "caption"})
        if tag == "table" and (at_table := table_at()):
            del stack[at_table:]
        if tag in HOLDERS and (at_table := table_at()):
            del stack[max(i for i in range(at_table, len(stack)) if stack[i].tag in HOLDERS[tag]) + 1:]
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(found[3])} if found[3] else {}
        node = Node(tag, attributes)
        in_table = tag == "form" and table_at()
        put(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            inner, at = html[at:stop.start() if stop else len(html)], stop.end() if stop else len(html)
            if tag in ("textarea", "title", "xmp"):
                node.children.append(unescape(inner) if tag != "xmp" else inner)
        elif tag not in VOID and len(stack) < DEPTH and not in_table:
            stack.append(node)
    say(html[at:])
    return root


class Page:
    """Lines of text: inline runs are joined with single blanks, and blocks ask for the breaks before them."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.blank, self.gap, self.indent, self.marker = "", False, 0, "", ""

    def put(self) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        lead = self.indent[:len(self.indent) - len(self.marker)] + self.marker
        self.lines.append((lead + self.line).rstrip())
        self.line, self.marker, self.gap = "", "", 0

    def end_line(self) -> None:
        if self.line.strip():
            self.put()
        self.line, self.blank = "", False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def text(self, value: str) -> None:
        words = value.split()
        if not words:
            self.blank = self.blank or bool(value)
            return
        lead = " " if self.line and (self.blank or value[0].isspace()) else ""
        self.line += lead + " ".join(words)
        self.blank = value[-1].isspace()

    def exact(self, value: str) -> None:
        head, *more = value.expandtabs().split("\n")
        self.line += head
        for line in more:
            self.put()
            self.line = line

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """(whether the element is laid out, whether its own text is visible)."""
    style = re.sub(r"\s+", "", node.attributes.get("style", "")).lower()
    laid_out = not (node.tag in NEVER or "hidden" in node.attributes or "display:none" in style or node.tag == "dialog" and "open" not in node.attributes
                    or node.tag == "input")
    if "visibility:hidden" in style or "visibility:collapse" in style:
        visible = False
    elif "visibility:visible" in style:
        visible = True
    return laid_out, visible


def rows_of(table: Node) -> Iterator[Node]:
    for child in table.children:
        if isinstance(child, Node) and shown(child, True)[0]:
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from rows_of(child)


def render_table(node: Node, page: Page, visible: bool) -> None:
    grid: list[list[list[str]]] = []
    for row in rows_of(node):
        seen, cells = shown(row, visible)[1], []
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and shown(cell, seen)[0]:
                inner = Page()
                render(cell.children, inner, shown(cell, seen)[1], False)
                span = cell.attributes.get("colspan", "1").strip()
                cells += [inner.result().split("\n"), *[[""]] * (min(int(span), 100) - 1 if re.fullmatch(r"[0-9]{1,3}", span) and int(span) else 0)]
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for i, lines in enumerate(cells):
            widths[i] = max(widths.get(i, 0), max((len(x) for x in lines if len(x) <= COLUMN), default=0))
    for cells in grid:
        for k in range(max(map(len, cells), default=0)):
            page.end_line()
            page.line = "  ".join((c[k] if k < len(c) else "").ljust(widths[i]) for i, c in enumerate(cells)).rstrip()
        page.end_line()


def render(children: list, page: Page, visible: bool, pre: bool) -> None:
    number = 0
    for child in children:
        if isinstance(child, str):
            if visible:
                page.exact(child) if pre else page.text(child)
            continue
        tag, (laid_out, seen) = child.tag, shown(child, visible)
        if not laid_out:
            continue
        if tag == "br":
            page.lines.append("") if not page.line.strip() and page.lines and not page.gap else page.end_line()
            continue
        if tag not in BLOCKS:
            render(child.children, page, seen, pre or tag in ("textarea", "xmp"))
            continue
        page.block(1 if tag in SPACED and not (tag in ("ul", "ol") and page.indent) else 0)
        before = page.indent
        if tag == "table":
            for part in child.children:
                if isinstance(part, str) or part.tag not in ("thead", "tbody", "tfoot", "tr", "colgroup"):
                    render([part], page, seen, False)
            page.block(0)
            render_table(child, page, seen)
        else:
            if tag == "li":
                number += 1
                page.marker = "- " if child.attributes.get("_list") != "ol" else f"{child.attributes['_at'] + number}. "
                page.indent += " " * len(page.marker)
            elif tag in ("dd", "blockquote"):
                page.indent += "  "
            if tag in ("ol", "ul", "menu", "dir"):
                start = child.attributes.get("start", "1").strip()
                first = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
                for item in child.children:
                    if isinstance(item, Node) and item.tag == "li":
                        item.attributes["_list"], item.attributes["_at"] = tag, first - 1
            inner = child.children
            if tag == "details" and "open" not in child.attributes:
                inner = [x for x in inner if isinstance(x, Node) and x.tag == "summary"]
            render(inner, page, seen, pre or tag == "pre")
        page.block(1 if tag in SPACED and not (tag in ("ul", "ol") and before) else 0)
        page.indent, page.marker = before, ""


def visible_text(html: str | None) -> str:
    page = Page()
    render(tree(html or "").children, page, True, False)
    return page.result()


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """`pages` with the visible text of `html` as `into`, and without the html.

    Defined results: null and empty pages have an empty text; broken markup is read as far as it goes; elements nested
    deeper than DEPTH are siblings; a column of that name is replaced, others pass; repeated rows are read each.
    """
    kept = [c for c in pages.columns if c not in (html, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = pa.array([visible_text(x.as_py()) for x in part.column(part.num_columns - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*kept, into])

    rows = pages.select(*kept, F.col(html).alias(into))
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))
