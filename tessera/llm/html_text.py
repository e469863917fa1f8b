"""Visible text of HTML pages by layout-aware rendering.

A tokenizer reads tags, text and comments; a tree builder opens and closes elements with the tags that HTML
implies (a paragraph ends before a block, an item before the next item, the head before anything it may not
contain, a row comes before its cells, and so on) and moves what may not stand in a table before it; a renderer
walks the tree. Hidden is what layout hides: elements that are never shown (script, style, template and the
like), closed details and dialogs, ``hidden``, and the inline styles display, visibility, opacity and font-size;
visibility and font-size are inherited and can be taken back by a child. Style sheets are not read. Blocks begin
on their own line, paragraphs and headings stand between blank lines, list items carry a bullet or number with
indentation by depth (to ``DEEPEST`` levels; deeper ones stand there too), ``br`` breaks a line, ``pre`` and ``textarea``
keep white space, and other white space collapses. Numbers honour ``start``, ``reversed`` and an item's ``value``.

A table is a grid that honours ``colspan`` and ``rowspan``. A cell keeps its own lines: its blocks, lists and inner
tables are laid out like a page's, and stand beside those of the other cells of its row, line by line, every column
as wide as its widest cell and two spaces apart. A cell over several columns widens the last of them if need be, one
over several rows runs down beside them. Columns without text take no room. A line of more than ``WIDEST`` characters
does not widen its column, and no cell is moved further to the right than that, since each row of the table would be
padded so far; what does not fit comes two spaces behind what stands before it.

Reading takes time in proportion to the page: an end tag looks up the places of its name and of the fences in the
open elements, and nothing scans for what is not there twice.

A null page gives null text and 0 blocks; an empty page the empty text. Rows with equal or null ids each keep
their own row; an empty table gives an empty result; further columns are ignored. Trees and tables of any depth
are built and walked without recursion.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

VOID = frozenset("area base br col colgroup embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title iframe object canvas audio video datalist rp param noembed noframes annotation annotation-xml".split())
#: not shown inside svg
UNSEEN_SVG = frozenset("defs desc metadata symbol clippath mask pattern lineargradient radialgradient".split())
#: their content is characters up to the end tag; those of the second set may hold character references
RAW, ESCAPED = frozenset("script style textarea title noscript iframe xmp noembed noframes".split()), frozenset("textarea title".split())
#: what the head may contain; anything else ends it
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
SECTIONS, TABLE_PARTS = frozenset("thead tbody tfoot".split()), frozenset("table thead tbody tfoot tr".split())
#: what may stand directly in a table or its sections and rows
IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th style script template".split())
BLOCK = frozenset("option optgroup address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
LISTS, KEPT = frozenset("ul ol menu dir".split()), frozenset("pre textarea xmp listing".split())
#: an opening tag closes the nearest open element of these names, not looking beyond the fences
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select", "datalist"}),
}
#: the elements of a table that a part of it goes into
PARENTS = {"caption": {"table"}, "colgroup": {"table"}, "col": {"table", "colgroup"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "tr": SECTIONS | {"table"}, "td": {"tr"}, "th": {"tr"}}
FENCES = frozenset("table td th caption button".split())
#: a longer line of a cell does not widen its column; lists are indented to so many levels
WIDEST, DEEPEST = 1_000, 32
#: what the standard allows at most
SPAN = {"colspan": 1_000, "rowspan": 65_534}
CLOSES_P = BLOCK - {"option", "optgroup", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

_token = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z]|\Z)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>=]++|=)*+)>?", re.S)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_zero = re.compile(r"\+?0*(?:\.0*)?(?:px|pt|em|rem|ex|ch|vw|vh|%|cm|mm|in|pc)?")
_space = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element with its children: nodes and strings.

    ``hidden``: nothing below it is shown. ``unseen``, ``tiny``: its own text is not, by visibility or font size.
    ``start``: the first number of a list or the number of an item, if given; ``step``: of a list's numbers.
    ``colspan``, ``rowspan``: of a cell; a row span of 0 goes to the end of its section.
    """

    __slots__ = ("children", "closed", "colspan", "hidden", "name", "rowspan", "start", "step", "tiny", "unseen")

    def __init__(self, name: str, within: "Node | None" = None):
        self.name, self.hidden, self.closed, self.start, self.step, self.children = name, False, False, None, 1, []
        self.colspan = self.rowspan = 1
        self.unseen, self.tiny = (within.unseen, within.tiny) if within else (False, False)


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for k, v in _attribute.findall(raw):
        found.setdefault(k.lower(), html.unescape(v.strip("\"'")))
    return found


def declarations(style: str) -> dict[str, str]:
    """The properties of an inline style; the last of a name counts."""
    pairs = (d.partition(":") for d in style.lower().split(";"))
    return {k.strip(): v.replace("!important", "").strip() for k, _, v in pairs}


def element(name: str, raw: str, within: Node, in_svg: bool) -> Node:
    """A node with what its attributes say of its visibility."""
    node = Node(name, within)
    node.hidden = name in UNSEEN or (in_svg and name in UNSEEN_SVG)
    a = attributes(raw) if raw and not raw.isspace() else {}
    node.closed = name == "details" and "open" not in a
    if name == "dialog" and "open" not in a:
        node.hidden = True
    if not a or node.hidden:
        return node
    number = a.get("start" if name == "ol" else "value", "").strip() if name in ("ol", "li") else ""
    if re.fullmatch(r"[+-]?[0-9]{1,9}", number):
        node.start = int(number)
    if name == "ol" and "reversed" in a:
        node.step = -1
    elif name in ("td", "th"):
        for k, most in SPAN.items():
            if m := re.match(r"\s*\+?([0-9]+)", a.get(k, "")):
                setattr(node, k, max(0 if k == "rowspan" else 1, min(int(m[1][:9]), most)))
    elif name == "input":
        kind = a.get("type", "").lower()
        if kind not in ("hidden", "checkbox", "radio", "password", "file", "image", "range", "color") and a.get("value"):
            node.children.append(a["value"])
    style = declarations(a["style"]) if "style" in a else {}
    opacity = style.get("opacity", "")
    node.hidden = "hidden" in a or style.get("display") == "none" or (bool(opacity) and _zero.fullmatch(opacity) is not None)
    if "visibility" in style:
        node.unseen = style["visibility"] in ("hidden", "collapse") or (node.unseen and style["visibility"] == "inherit")
    size = style.get("font-size", "")
    if size and not (node.tiny and size.endswith(("%", "em")) and not size.endswith("rem")):  # a share of nothing is nothing
        node.tiny = _zero.fullmatch(size) is not None
    return node


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = [root]
    open_names: dict[str, list[int]] = {"html": [0]}  # the places of open elements by name

    def pop_to(index: int) -> None:
        while len(stack) > index:
            open_names[stack.pop().name].pop()

    def push(node: Node) -> None:
        open_names.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def last(names: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of these names, 0 without one."""
        return max((at[-1] for n in names if (at := open_names.get(n))), default=0)

    def close(names: set[str] | frozenset[str], fences: set[str] | frozenset[str]) -> None:
        i = last(names)
        if i and i >= last(fences):
            pop_to(i)

    def put(child: Node | str, stray: bool) -> None:
        """Append to the open element; what is stray in a table goes before it."""
        if not stray:
            stack[-1].children.append(child)
            return
        at = open_names["table"][-1]
        beside = stack[at - 1].children
        beside.insert(next(i for i in range(len(beside) - 1, -1, -1) if beside[i] is stack[at]), child)

    def text(s: str) -> None:
        blank = not s or s.isspace()
        if stack[-1].name == "head" and not blank:
            pop_to(len(stack) - 1)
        stray = stack[-1].name in TABLE_PARTS and not blank and bool(open_names.get("table"))
        shown = next(x for x in reversed(stack) if x.name not in TABLE_PARTS) if stray else stack[-1]
        if not shown.unseen and not shown.tiny:
            put(s, stray)

    at, n = 0, len(page)
    while at < n:
        m = _token.search(page, at)
        if not m:
            text(html.unescape(page[at:]))
            break
        if m.start() > at:
            text(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "p" and not open_names.get("p"):
                put(Node("p"), stack[-1].name in TABLE_PARTS and bool(open_names.get("table")))
            elif name == "br":
                put(Node("br"), stack[-1].name in TABLE_PARTS and bool(open_names.get("table")))
            elif name not in ("html", "body"):
                close({name}, FENCES - {name} if name not in TABLE_PARTS else frozenset({"table"} - {name}))
            continue
        if name in ("html", "frameset"):
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            pop_to(len(stack) - 1)
        if name == "body" and open_names.get("body"):
            continue
        if name in CLOSES_P and open_names.get("p"):
            close({"p"}, FENCES)
        if name in IMPLIED:
            close(*IMPLIED[name])
        in_table = bool(open_names.get("table"))
        if in_table and name in PARENTS:  # end what is open inside the part's parent
            wanted = PARENTS[name]
            i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name in wanted or stack[i].name in SECTIONS or stack[i].name == "table")
            if stack[i].name not in wanted and stack[i].name in SECTIONS and name not in ("td", "th"):
                i = next(k for k in range(i, -1, -1) if stack[k].name == "table")
            pop_to(i + 1)
            if name in ("td", "th") and stack[-1].name != "tr":
                row = Node("tr", stack[-1])
                put(row, False)
                push(row)
        elif name == "table" and stack[-1].name in TABLE_PARTS and in_table:  # a table directly in a table ends it
            close({"table"}, frozenset())
        within = stack[-1]
        stray = within.name in TABLE_PARTS and bool(open_names.get("table")) and name not in IN_TABLE and name != "form"
        if stray:
            within = next(x for x in reversed(stack) if x.name not in TABLE_PARTS)
        node = element(name, m[3], within, bool(open_names.get("svg")))
        put(node, stray)
        if node.unseen or node.tiny:
            node.children.clear()  # an input's value
        if name == "form" and within.name in TABLE_PARTS:
            continue  # a form between the parts of a table holds nothing
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            inner = page[at : end.start() if end else n]
            if not node.unseen and not node.tiny:
                node.children.append(html.unescape(inner) if name in ESCAPED else inner)
            at = (page.find(">", end.start()) + 1 or n) if end else n
        elif name not in VOID and not (m[3].endswith("/") and open_names.get("svg")):
            push(node)
    return root


def indentation(level: int) -> str:
    return "  " * min(level, DEEPEST)


class Lines:
    """Text laid out line by line: open line, pending space and blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False  # a blank line is due before the next text
        self.lead = ""  # what the next line begins with (a bullet)
        self.indent = 0

    def text(self, s: str) -> None:
        parts = _space.sub(" ", s)
        if not parts.strip(" "):
            self.space = self.space or bool(parts)
            return
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            if self.lead:
                self.line.append(self.lead)
                self.lead = ""
            else:
                self.line.append(indentation(self.indent))
        elif self.space or parts[0] == " ":
            self.line.append(" ")
        self.space = parts[-1] == " "
        self.line.append(parts.strip(" "))

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def whole(self, lines: list[str]) -> None:
        """Lines kept as they are, at the indentation of the list around them."""
        self.end()
        if not lines:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        before = indentation(self.indent)
        first, self.lead = self.lead or before, ""
        self.lines += [(first if i == 0 else before) + x if x or (i == 0 and first.strip()) else "" for i, x in enumerate(lines)]

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines)


def children(node: Node) -> list:
    """What is shown of an element's children."""
    if node.hidden:
        return []
    if node.closed:
        return [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
    return node.children


def plain(node: Node) -> str:
    """The characters of a node as they stand, without what is hidden; for pre. Blocks inside begin on their own line, cells after a space."""
    out: list[str] = []
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x is not None and x.name in ("td", "th"):
            out.append(" ")
        elif x is None or (x is not node and x.name in BLOCK) or (x is not node and x.name == "br"):
            if out and (not out[-1].endswith("\n") or (x is not None and x.name == "br")):
                out.append("\n")
            if x is not None and x.name != "br":
                stack.append(None)
        if x is not None:
            stack.extend(reversed(children(x)))
    return "".join(out)


def rows_of(node: Node, texts: dict[int, str]) -> tuple[list[str], list[list[list[Node]]]]:
    """Captions, and the rows of cells of each section of a table."""
    captions, sections, stack = [], [[]], [(x, False) for x in reversed(node.children)]
    while stack:
        x, inside = stack.pop()
        if x is None:  # the end of a section
            sections.append([])
            continue
        if isinstance(x, str) or x.hidden:
            continue
        if x.name == "caption":
            captions.append(texts[id(x)])
        elif x.name == "tr":
            sections[-1].append([c for c in x.children if isinstance(c, Node) and not c.hidden and c.name in ("td", "th")])
        elif x.name in SECTIONS and not inside:
            sections.append([])
            stack.append((None, False))
            stack.extend((c, True) for c in reversed(x.children))
    return captions, sections


def placed(sections: list[list[list[Node]]]) -> list[tuple[int, int, int, int, Node]]:
    """(row, rows, column, columns, cell) of every cell of the grid; rows are counted through all sections, and no cell leaves its own.

    A cell goes to the next column of its row that no cell from above takes. Free columns below the widest row so
    far lie in a heap; a row span frees its columns again at its end. So a cell costs its own spans and a logarithm.
    """
    out, top = [], 0
    for rows in sections:
        until: dict[int, int] = {}  # column: the row from which it is free again
        ends: dict[int, list[int]] = {}
        free: list[int] = []
        frontier = live = 0  # live: the row from which no cell from above is left
        for r, row in enumerate(rows):
            if live <= r:
                until, ends, free, frontier = {}, {}, [], 0
            for c in ends.pop(r, ()):
                if until[c] == r:
                    heappush(free, c)
            column, again = 0, []
            for cell in row:
                while free and (free[0] < column or until.get(free[0], 0) > r):
                    again.append(heappop(free))  # passed over in this row, or taken meanwhile
                start = heappop(free) if free else frontier
                column, known = start + cell.colspan, frontier
                frontier = max(frontier, column)
                down = min(cell.rowspan or len(rows), len(rows) - r)
                out.append((top + r, down, start, cell.colspan, cell))
                again.append(start)
                again.extend(range(max(start + 1, known), column))
                if down > 1:
                    live = max(live, r + down)
                    for c in range(start, column):
                        if until.get(c, 0) < r + down:
                            until[c] = r + down
                            ends.setdefault(r + down, []).append(c)
            for c in again if live > r + 1 else ():
                if until.get(c, 0) <= r:
                    heappush(free, c)
        top += len(rows)
    return out


def table_lines(node: Node, texts: dict[int, str]) -> list[str]:
    """The lines of a table: those of its cells beside each other, row after row."""
    captions, sections = rows_of(node, texts)
    cells = [(row, down, column, across, text.split("\n")) for row, down, column, across, cell in placed(sections) if (text := texts[id(cell)])]
    widths: dict[int, int] = {}  # of columns with text
    columns: list[int] = []  # these, in order
    for _, _, column, across, lines in sorted(cells, key=lambda c: c[3]):
        wide = max((len(x) for x in lines if len(x) <= WIDEST), default=1)
        own = columns[bisect_left(columns, column) : bisect_left(columns, column + across)]
        at = own[-1] if own else column
        if not own:
            insort(columns, at)
        widths[at] = widths.get(at, 0) + max(0, wide - sum(widths[c] + 2 for c in own) + 2 * bool(own))
    offset, left = {}, 0
    for c in columns:
        offset[c], left = min(left, WIDEST), left + widths[c] + 2
    heights = [0] * sum(map(len, sections))
    for row, down, _, _, lines in cells:
        if down == 1:
            heights[row] = max(heights[row], len(lines))
    sums = [0]  # of the heights of the first rows; an end is never before the last one
    for row, down, _, _, lines in sorted((c for c in cells if c[1] > 1), key=lambda c: c[0] + c[1]):
        for r in range(len(sums), row + down + 1):
            sums.append(sums[-1] + heights[r - 1])
        missing = max(0, len(lines) - (sums[row + down] - sums[row]))
        heights[row + down - 1] += missing
        sums[row + down] += missing
    tops = [0]
    for h in heights:
        tops.append(tops[-1] + h)
    canvas: list[list[tuple[int, int, str]]] = [[] for _ in range(tops[-1])]
    for row, _, column, _, lines in cells:
        at = offset[columns[bisect_left(columns, column)]]
        for i, x in enumerate(lines, tops[row]):
            if x:
                canvas[i].append((at, column, x))
    out = []
    for parts in canvas:
        line, n = [], 0
        for at, _, x in sorted(parts, key=lambda p: p[:2]):
            gap = at - n if at >= n else 2
            line += [" " * gap, x]
            n += gap + len(x)
        out.append("".join(line).rstrip(" "))
    return [*(x for c in captions if c for x in c.split("\n")), *out]


def render(root: Node) -> str:
    """The visible text below a node: that of its tables' cells first, innermost tables before the others."""
    parts, stack = [], [(root, False)]
    while stack:  # cells and captions, outer ones first
        x, in_table = stack.pop()
        if in_table and x.name in ("td", "th", "caption"):
            parts.append(x)
        stack.extend((c, in_table or x.name == "table") for c in children(x) if isinstance(c, Node))
    texts: dict[int, str] = {}
    for x in reversed(parts):
        texts[id(x)] = laid_out(x, texts)
    return laid_out(root, texts)


def laid_out(node: Node, texts: dict[int, str]) -> str:
    """The visible text below a node, given the texts of the cells and captions below it."""
    out = Lines()
    counters: list[list] = []  # open lists: kind and next number
    stack: list = [(c, True) for c in reversed(node.children)]
    while stack:
        x, opening = stack.pop()
        if isinstance(x, str):
            out.text(x)
            continue
        name = x.name
        if opening:
            if x.hidden:
                continue
            if name == "br":
                if out.line:
                    out.end()
                else:
                    out.blank = bool(out.lines)
                continue
            if name == "img":
                continue
            if name in KEPT:
                out.blank = True
                out.whole(plain(x).strip("\n").split("\n"))
                out.blank = True
                continue
            if name == "table":
                out.blank = out.blank or bool(out.lines or out.line)
                out.whole(table_lines(x, texts))
                out.blank = True
                continue
            if name in BLOCK:
                out.end()
                if name in SPACED and not (name in LISTS and counters):
                    out.blank = True
            if name == "hr":
                out.blank = True
                continue
            if name in LISTS:
                first = x.start
                if first is None:
                    first = sum(isinstance(c, Node) and c.name == "li" and not c.hidden for c in x.children) if x.step < 0 else 1
                counters.append([name, first, x.step])
                out.indent = len(counters)
            elif name == "li":
                level = max(1, len(counters))
                if counters and counters[-1][0] == "ol":
                    if x.start is not None:
                        counters[-1][1] = x.start
                    mark = f"{counters[-1][1]}. "
                    counters[-1][1] += counters[-1][2]
                else:
                    mark = "- "
                out.lead = indentation(level - 1) + mark
            elif name == "dd":
                out.indent += 1
            stack.append((x, False))
            stack.extend((c, True) for c in reversed(children(x)))
            continue
        if name in BLOCK:
            out.end()
            if name in SPACED and not (name in LISTS and len(counters) > 1):
                out.blank = True
        if name in LISTS:
            counters.pop()
            out.indent = len(counters)
        elif name == "li":
            out.lead = ""
        elif name == "dd":
            out.indent -= 1
    return out.result()


def extract(page: str) -> str:
    return render(parse(page))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, and n_blocks (runs of lines between blank lines) of every whole page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if p is None else extract(p) for p in batch.column(1).to_pylist()]
            blocks = [t.count("\n\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(blocks, pa.int64())], ["page_id", "text", "n_blocks"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string, n_blocks long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))
