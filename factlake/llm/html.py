"""HTML extraction: a tree builder with implied tags, then layout-aware rendering of all visible text.

The builder closes and opens what HTML leaves out (p, li, dt, dd, option, rows, cells, table bodies), keeps scripts and
styles as raw text and closes what is still open at the end. The renderer walks the tree: head, script, style, template,
comments and elements with ``hidden``, ``aria-hidden=true``, ``display:none`` or ``visibility:hidden`` are not visible;
everything else is, navigation and advertisements included. Blocks stand on lines of their own, paragraphs and headings
have a blank line between them, list items a bullet or their number, indented by depth; ``pre`` keeps its spacing; cells
of a table are padded so that columns line up, colspan and rowspan included (a spanned cell's text stands in its first row).
Elements of a row that hold cells are looked through; what else stands in a row is a cell of its own. Text of charts and
formulas is visible, as are the values of text inputs or else their placeholders. Indents grow up to ``DEEPEST`` levels,
and up to ``REACHING`` cells reach down into a row: a cell above that many stands in its first row only. What a row gets
depends on the rows above it, not on the size of the table.

Time is linear in a page's length, whatever it holds: once a tag's quotes don't close, all tags end at the next ">".

Defined results: null html gives null text, empty html gives ""; pages of any length are rendered whole; text outside
all tags is visible; a page of only markup gives "". Repeated rows each give their row. Nesting may be of any depth: the
walk doesn't recurse. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factlake.llm._common import lean, no_clash

_OPEN = re.compile(r"<(?=[!?A-Za-z]|/[A-Za-z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>", re.S)
_SIMPLE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[ \t\r\n\f]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title meta link base noframes noembed iframe object audio video canvas datalist desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary text table tbody tfoot thead tr td th caption ul".split())
#: Types of input that show no text.
_MUTE = frozenset("hidden checkbox radio file range color image password".split())
DEEPEST = 50
#: Cells of rows above that leave a blank in a row. Of all, blanks would grow with the square of a page.
REACHING = 128
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table dl ul ol figure hr".split())
#: An opening tag ends these open ones, up to the boundary that follows.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ()), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
}
_ENDS["thead"] = _ENDS["tfoot"] = _ENDS["tbody"]
_SCOPE = frozenset("table td th caption html body button object".split())
_IN_HEAD = frozenset("base link meta noscript script style template title head html".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(raw):
        v = v[1:-1] if v[:1] in "\"'" and v else v
        out.setdefault(k.lower(), entities.unescape(v) if "&" in v else v)
    return out


def parse(page: str) -> Node:
    """The page's tree; never fails."""
    root = Node("html")
    stack = [root]
    opened: dict[str, int] = {}  # how many of each tag are on the stack, so that deep pages aren't searched in vain

    def cut(d: int) -> None:
        for x in stack[d:]:
            opened[x.tag] -= 1
        del stack[d:]

    def close(tags: tuple[str, ...], stop: frozenset | tuple) -> None:
        left = sum(opened.get(t, 0) for t in tags)
        for d in range(len(stack) - 1, 0, -1):
            if not left:
                return
            t = stack[d].tag
            if t in tags:
                cut(d)
                left = sum(opened.get(t, 0) for t in tags)
            elif t in stop:
                return

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                cut(len(stack) - 1)
            if stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and s.strip():
                open_cell()
            stack[-1].kids.append(entities.unescape(s) if "&" in s else s)

    def push(node: Node) -> None:
        stack[-1].kids.append(node)
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1

    def open_cell() -> None:
        if stack[-1].tag != "tr":
            push(Node("tr"))
        push(Node("td"))

    at, n, last = 0, len(page), page.rfind(">")
    loose = False  # a tag's quotes didn't close
    while at < n:
        o = _OPEN.search(page, at)
        if not o:
            text(page[at:])
            break
        lt = o.start()
        if lt > last and not page.startswith(("<!--", "<![CDATA["), lt):
            text(page[at:])
            break
        m = None if loose else _TOKEN.match(page, lt)
        if m is None and page[lt + 1] not in "!?":
            loose = True
            m = _SIMPLE.match(page, lt)
        elif m is None:
            m = _TOKEN.match(page, lt)
        if m is None:  # a sign that opens nothing
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag = m[2] if m.re is _SIMPLE or m.lastindex else None
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if not opened.get(tag):
                if tag == "p":
                    stack[-1].kids.append(Node("p"))
                continue
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == tag:
                    cut(d)
                    break
                if stack[d].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag == "html":
            root.attrs |= _attrs(m[3])
            continue
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            cut(len(stack) - 1)
        if tag == "body" and opened.get("body"):
            continue
        if tag in _ENDS_P and opened.get("p"):
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == "p":
                    cut(d)
                    break
                if stack[d].tag in _SCOPE:
                    break
        if tag[0] == "h" and len(tag) == 2 and tag[1] in "123456" and re.fullmatch("h[1-6]", stack[-1].tag):
            cut(len(stack) - 1)
        if tag in _ENDS:
            close(*_ENDS[tag])
        if tag == "tr" and stack[-1].tag == "table":
            push(Node("tbody"))
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr"))
        node = Node(tag, _attrs(m[3]) if m[3].strip(" /\n\t") else None)
        if tag not in VOID and tag not in RAW:
            push(node)
            continue
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            node.kids.append(entities.unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else n
    return root


def _hidden(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return True
    return bool(a) and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or "style" in a and bool(_NONE.search(a["style"])))


class _Out:
    """Lines as they are made."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a space is due before more text
        self.blank = False  # a blank line is due before more text
        self.mark = ""  # a bullet waiting for its item's text
        self.indent = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self._put(first)
            for r in rest:
                self.end(keep=True)
                self._put(r)
            return
        s2 = _SPACE.sub(" ", s)
        if s2[:1] == " ":
            self.gap = self.gap or bool(self.line)
        body = s2.strip(" ")
        if body:
            self._put(" " + body if self.gap and self.line else body)
            self.gap = s2[-1:] == " "

    def _put(self, s: str) -> None:
        if not self.line:
            if not s:
                return
            if self.blank and self.done and self.done[-1]:
                self.done.append("")
            self.blank = False
            self.line.append("  " * min(self.indent, DEEPEST) + self.mark)
            self.mark = ""
        self.gap = False
        self.line.append(s)

    def end(self, keep: bool = False) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip())
            self.line = []
        elif keep:
            self.done.append("")
        self.gap = False

    def space(self) -> None:
        self.end()
        self.blank = True


def _cells(row: Node) -> list[Node]:
    """A row's cells, also those inside other elements; what stands beside cells is gathered in cells of tag ``loose``."""
    parent: dict[int, Node] = {}
    holds: set[int] = set()  # elements with a cell inside
    todo = [row]
    while todo:
        k = todo.pop()
        for c in k.kids:
            if not isinstance(c, Node) or _hidden(c):
                continue
            if c.tag not in ("td", "th"):
                if c.tag != "table":
                    parent[id(c)] = k
                    todo.append(c)
                continue
            up = k
            while up is not row and id(up) not in holds:
                holds.add(id(up))
                up = parent[id(up)]
    out: list[Node] = []
    loose = None
    steps: list = list(reversed(row.kids))
    while steps:
        c = steps.pop()
        if c is None:
            loose = None
        elif isinstance(c, Node) and _hidden(c):
            continue
        elif isinstance(c, Node) and (c.tag in ("td", "th") or id(c) in holds):
            loose = None
            if c.tag in ("td", "th"):
                out.append(c)
            else:
                steps += [None, *reversed(c.kids)]
        else:
            if loose is None:
                out.append(loose := Node("loose"))
            loose.kids.append(c)
    return out


def _table(node: Node) -> tuple[list[Node], list[list[Node]]]:
    """A table's captions and rows of cells, without those of tables inside."""
    captions, rows, todo = [], [], list(reversed([k for k in node.kids if isinstance(k, Node)]))
    while todo:
        k = todo.pop()
        if _hidden(k):
            continue
        if k.tag == "tr":
            rows.append(_cells(k))
        elif k.tag == "caption" or k.tag not in ("tbody", "thead", "tfoot"):
            captions.append(k)
        else:
            todo += reversed([x for x in k.kids if isinstance(x, Node)])
    return captions, rows


def _span(cell: Node, name: str, most: int) -> int:
    """Columns or rows of a cell, as far as HTML itself goes."""
    raw = cell.attrs.get(name, "").strip()
    n = int(raw) if re.fullmatch(r"[0-9]{1,9}", raw) else 1
    return min(n, most) if n else most if name == "rowspan" else 1


def _placed(rows: list[list[tuple[str, int, int]]]) -> Iterator[list[tuple[int, int, str | None, int]]]:
    """Each row's pieces (first column, columns, text, end row); the text of those that reach down from rows above is None."""
    active: list[tuple[int, int, None, int]] = []
    for number, r in enumerate(rows):
        own: list[tuple[int, int, str | None, int]] = []
        down, active = active, [p for p in active if p[3] > number + 1]
        at = k = 0
        some = len(active)
        for text, span, deep in r:
            first = k
            while k < len(down) and down[k][0] < at + span:  # a cell stands beside what reaches down, never over it
                at = max(at, down[k][0] + down[k][1])
                k += 1
            own += down[first:k]
            own.append((at, span, text, number + deep))
            if deep > 1 and len(active) < REACHING:
                active.append((at, span, None, number + deep))
            at += span
        own += down[k:]
        if len(active) > some:
            active.sort(key=lambda p: p[0])
        yield own


def _grid(rows: list[list[tuple[str, int, int]]]) -> str:
    """Cells, each with its columns and rows, as lines with aligned columns; rows without text are left out."""
    width: dict[int, int] = {}
    for r in _placed(rows):
        for c, s, text, _ in r:
            if s == 1 and text is not None:
                width[c] = max(width.get(c, 0), *map(len, text.split("\n")))
    known = sorted(width)
    sums = [0]
    for c in known:
        sums.append(sums[-1] + width[c])
    end = known[-1] + 1 if known else 0

    def room(c: int, s: int) -> int:
        return sums[bisect_left(known, c + s)] - sums[bisect_left(known, c)] + 3 * (max(1, min(s, end - c)) - 1)

    out = []
    blank: dict[tuple, str] = {}
    for r in _placed(rows):
        if not any(p[2] for p in r):
            continue
        line, cells = [], []
        for p in r:
            if p[2] is None:
                if p not in blank:
                    blank[p] = " " * room(p[0], p[1])
                line.append(blank[p])
            else:
                cells.append((len(line), p[2].split("\n"), room(p[0], p[1])))
                line.append("")
        for i in range(max(len(lines) for _, lines, _ in cells)):
            for k, lines, n in cells:
                line[k] = (lines[i] if i < len(lines) else "").ljust(n)
            out.append(" | ".join(line).rstrip())
    return "\n".join(out)


def render(page: str) -> str:
    """The page's visible text."""
    root = parse(page)
    out = _Out()
    # a step is (node or text, state) or a function to call; state: (inside pre, list kind stack)
    todo: list = [("open", root, False)]
    outs = [out]
    numbers: list[list] = []
    while todo:
        step = todo.pop()
        kind = step[0]
        o = outs[-1]
        if kind == "text":
            o.text(step[1], step[2])
        elif kind == "call":
            step[1]()
        else:
            node, pre = step[1], step[2]
            if _hidden(node):
                continue
            tag = node.tag
            if tag == "br":
                o.end(keep=True)
                continue
            if tag == "hr":
                o.space()
                o.text("---", False)
                o.space()
                continue
            if tag == "img":
                if node.attrs.get("alt"):
                    o.text(f" {node.attrs['alt']} ", False)
                continue
            if tag == "input":
                shown = node.attrs.get("value") or node.attrs.get("placeholder")
                if shown and node.attrs.get("type", "").lower() not in _MUTE:
                    o.text(f" {shown} ", False)
                continue
            if tag == "table":
                captions, rows = _table(node)
                o.space()
                texts: list[list[tuple[str, int, int]]] = [[] for _ in rows]

                def finish(texts=texts) -> None:
                    grid = _grid(texts)
                    if grid:
                        outs[-1].text(grid, True)
                    outs[-1].space()

                todo.append(("call", finish))
                for r, cells in reversed(list(enumerate(rows))):
                    for c in reversed(cells):
                        span, deep = _span(c, "colspan", 1000), _span(c, "rowspan", 65534)

                        def store(r=r, span=span, deep=deep, texts=texts, loose=c.tag == "loose") -> None:
                            own = outs.pop()
                            own.end()
                            cell = "\n".join(own.done).strip("\n")
                            if cell or not loose:
                                texts[r].append((cell, span, deep))

                        todo.append(("call", store))
                        todo += [("text", k, pre) if isinstance(k, str) else ("open", k, pre) for k in reversed(c.kids)]
                        todo.append(("call", lambda: outs.append(_Out())))
                for c in reversed(captions):
                    todo.append(("call", lambda: outs[-1].end()))
                    todo.append(("open", c, pre))
                continue
            pre = pre or tag in ("pre", "textarea", "xmp")
            if tag in ("td", "th"):
                o.text(" ", False)
            if tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and numbers
                o.space() if tag in SPACED and not nested else o.end()
            after = []
            if tag in ("ul", "menu", "dir", "ol"):
                start = node.attrs.get("start", "1")
                numbers.append([int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if tag == "ol" else ["*"])
                o.indent = len(numbers) - 1
                after.append(lambda: (numbers.pop(), setattr(outs[-1], "indent", max(0, len(numbers) - 1))))
            elif tag == "li":
                if numbers and numbers[-1][0] != "*":
                    own = node.attrs.get("value", "")
                    if re.fullmatch(r"-?\d{1,9}", own):
                        numbers[-1][0] = int(own)
                    o.mark = f"{numbers[-1][0]}. "
                    numbers[-1][0] += 1
                else:
                    o.mark = "* "
                after.append(lambda: setattr(outs[-1], "mark", ""))
            elif tag == "dd" or tag == "blockquote":
                o.indent += 1
                after.append(lambda: setattr(outs[-1], "indent", outs[-1].indent - 1))
            if tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and len(numbers) > 1
                spaced = tag in SPACED and not nested
                todo.append(("call", lambda after=after, spaced=spaced: (outs[-1].space() if spaced else outs[-1].end(), [f() for f in after])))
            kids = node.kids
            if pre and tag == "pre" and kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
                kids = [kids[0][1:], *kids[1:]]
            todo += [("text", k, pre) if isinstance(k, str) else ("open", k, pre) for k in reversed(kids)]
    out.end()
    lines = out.done
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def extract(df: DataFrame) -> DataFrame:
    """(page_id, url, text) of (page_id, url, html): one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if h is None else render(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return no_clash(df, "page_id", "url", "html").mapInArrow(lean(run), "page_id long, url string, text string")
