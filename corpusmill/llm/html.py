"""Layout-aware text of HTML pages.

A tree builder with implied tags (a block closes a paragraph, an item an item, a cell a
cell; void and raw-text elements) makes a tree; visibility rules skip what a browser
doesn't show; the renderer emits all visible text: blocks on lines of their own, blank
lines around paragraphs, headings, lists and tables, list markers with indentation,
preformatted text as it is, and table cells padded to aligned columns. One narrow
pass over the pages; pages are parsed whole, and depth isn't bounded by recursion.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm import words as W

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
PLAIN = frozenset(("title", "textarea"))  # only character references inside
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object canvas video audio svg datalist area base link meta param source track".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SPACED = frozenset(("p", "ul", "ol", "dl", "menu", "table", "blockquote", "pre", "figure", *HEADINGS))
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary tbody td tfoot th thead tr caption".split())
CLOSES_P = SPACED | frozenset("address article aside center details dialog dir div fieldset figcaption footer form header hgroup hr main nav search section summary li dd dt".split())
#: An opening tag ends the nearest open element of the first set, unless one of the second stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("optgroup", "option"), ("select",)),
    "body": (("head",), ()), "caption": (("caption",), ("table",)),
}
#: End tags that reach no further out than these.
SCOPE = frozenset(("table", "td", "th", "caption", "template", "html", "button"))

#: A tag; then the same where some quote is never closed, so that quotes mean nothing from there on.
_STRICT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_OTHER = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
_MARK = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Stack(list):
    """Open elements and how many there are of each tag."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: dict[str, int] = {}

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def cut(self, at: int) -> None:
        while len(self) > at:
            self.open[self.pop().tag] -= 1


def build(html: str) -> Node:
    """The tree of a page; children are nodes and strings (character references decoded). Time is linear in the page."""
    html = html.replace("\x00", "\ufffd")
    root = Node("#root", {})
    stack, at, size, last, tags = Stack(root), 0, len(html), html.rfind(">"), _STRICT

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(unescape(part) if "&" in part else part)

    held = 0  # where text that isn't emitted yet begins
    while at < size:
        found = _MARK.search(html, at)
        if found is None or found.start() > last:
            break
        m = _OTHER.match(html, found.start())
        if m:
            text(html[held : m.start()])
            at = held = m.end()
            continue
        m = tags.match(html, found.start())
        if m is None and tags is _STRICT:
            tags = _LOOSE
            m = tags.match(html, found.start())
        if m is None:
            at = found.start() + 1
            continue
        text(html[held : m.start()])
        at = held = m.end()
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        attrs = {}
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW or tag in PLAIN:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            part = html[at : end.start() if end else size]
            at = held = end.end() if end else size
            if part:
                node.children.append(unescape(part) if tag in PLAIN else part)
            continue
        stack.push(node)
    text(html[held:])
    return root


def _close(stack: Stack, tag: str) -> None:
    if not stack.open.get(tag) and not (tag in HEADINGS and any(stack.open.get(h) for h in HEADINGS)):
        if tag in ("p", "br"):  # </p> without a paragraph makes an empty one, </br> is a break
            stack[-1].children.append(Node(tag, {}))
        return
    for i in range(len(stack) - 1, 0, -1):
        now = stack[i].tag
        if now == tag or tag in HEADINGS and now in HEADINGS:
            stack.cut(i)
            return
        if now in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or now == "table":
            return


def _imply(stack: Stack, tag: str) -> None:
    if tag in CLOSES_P and stack.open.get("p"):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                stack.cut(i)
                break
            if stack[i].tag in SCOPE or stack[i].tag in BLOCKS:
                break
    if tag not in HIDDEN and stack[-1].tag == "head":
        stack.cut(len(stack) - 1)
    if tag in IMPLIED:
        ends, walls = IMPLIED[tag]
        if any(stack.open.get(e) for e in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    stack.cut(i)
                    break
                if stack[i].tag in walls:
                    break
    if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
        row = Node("tr", {})
        stack[-1].children.append(row)
        stack.push(row)


def hidden(node: Node) -> bool:
    """Whether a browser shows nothing of the element: by its kind, its attribute hidden or its inline style."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return True
    return "style" in a and _UNSEEN.search(a["style"]) is not None


class Out:
    """Lines of text with collapsed blanks; ``gap`` is how many line ends are due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.marker = 0, False, ""

    def end(self, gap: int = 1) -> None:
        self.gap = max(self.gap, gap)
        self.space = False

    def _start(self, indent: int) -> None:
        if self.gap:
            if self.line:
                self.lines.append("".join(self.line).rstrip(" "))
                self.line = []
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
        if not self.line:
            pad = " " * indent
            if self.marker:
                pad = pad[: max(0, indent - len(self.marker))] + self.marker
                self.marker = ""
            if pad:
                self.line.append(pad)

    def put(self, text: str, indent: int) -> None:
        """Text with collapsible white space."""
        body = _SPACES.sub(" ", text)
        if body[:1] == " ":
            self.space = True
            body = body[1:]
        if not body:
            return
        if self.space and self.line and not self.gap:
            self.line.append(" ")
        self.space = body[-1] == " "
        self._start(indent)
        self.line.append(body[:-1] if self.space else body)

    def put_lines(self, lines: list[str], indent: int) -> None:
        """Ready lines, kept as they are."""
        for k, x in enumerate(lines):
            if k:
                self.lines.append("".join(self.line))
                self.line = []
                if x:
                    self.line.append(" " * indent)
            else:
                self._start(indent)
            self.line.append(x)

    def done(self) -> list[str]:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows spanned) as aligned lines, two blanks between columns."""
    placed: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}  # column -> rows that a cell above still takes
    for row in rows:
        line: dict[int, tuple[list[str], int]] = {}
        c = 0
        taken = {k for k, v in held.items() if v > 0}
        held = {k: v - 1 for k, v in held.items() if v > 1}
        for lines, wide, high in row:
            while c in taken:
                c += 1
            line[c] = (lines, wide)
            if high > 1:
                for k in range(c, c + wide):
                    held[k] = high - 1
            c += wide
        placed.append(line)
    width: dict[int, int] = {}
    for line in placed:
        for c, (lines, wide) in line.items():
            if wide == 1:
                width[c] = max(width.get(c, 0), *(len(x) for x in lines), 0) if lines else width.get(c, 0)
    for line in placed:  # what a spanning cell needs beyond its columns goes to the last of them
        for c, (lines, wide) in line.items():
            if wide > 1 and lines:
                need = max(map(len, lines)) - sum(width.get(k, 0) for k in range(c, c + wide)) - 2 * (wide - 1)
                width[c + wide - 1] = width.get(c + wide - 1, 0) + max(0, need)
    starts, x = {}, 0
    for c in range(max(width, default=-1) + 1):
        starts[c] = x
        if width.get(c, 0):
            x += width[c] + 2
    out = []
    for line in placed:
        cells = [(starts.get(c, x), lines) for c, (lines, _) in sorted(line.items()) if lines]
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            s = ""
            for at, lines in cells:
                if k < len(lines) and lines[k]:
                    s = s.ljust(at) + lines[k]
            out.append(s.rstrip(" "))
    return out


def _span(node: Node, name: str, most: int) -> int:
    v = node.attrs.get(name, "1").strip()
    return min(most, int(v)) if v.isascii() and v.isdigit() and 0 < len(v) < 6 and int(v) else 1


def render(root: Node) -> str:
    """All visible text of a tree."""
    out, outs, tables, lists, pre, indent = Out(), [], [], [], 0, 0
    work: list = [(root, False)]
    while work:
        node, leaving = work.pop()
        if isinstance(node, str):
            if pre:
                out.put_lines(node.expandtabs(8).replace("\r\n", "\n").split("\n"), indent)
            else:
                out.put(node, indent)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node):
                continue
            if tag == "br":
                if out.line and not out.gap:
                    out.end()
                else:  # a further break is an empty line
                    out.end(2)
                continue
            if tag == "wbr":
                continue
            if tag in VOID:
                if tag == "hr":
                    out.end()
                elif tag == "input" and node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                    out.put(node.attrs["value"], indent)
                continue
            if tag in BLOCKS:
                out.end(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
            if tag == "pre" or tag == "textarea" or tag == "xmp":
                pre += 1
                if node.children and isinstance(node.children[0], str):  # the first line end isn't shown
                    node.children[0] = re.sub(r"\A\r?\n", "", node.children[0])
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                indent += 2 if tag != "ol" else 3
            elif tag == "li":
                if lists and lists[-1][0] == "ol":
                    out.marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    out.marker = "- "
            elif tag in ("dd", "blockquote"):
                indent += 2
            elif tag == "table":
                tables.append([])
                outs.append((out, indent, lists, pre))
                out, indent, lists, pre = Out(), 0, [], 0
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                outs.append((out, indent, lists, pre))
                out, indent, lists, pre = Out(), 0, [], 0
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children))
            continue
        if tag == "pre" or tag == "textarea" or tag == "xmp":
            pre -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            indent -= 2 if tag != "ol" else 3
        elif tag == "li":
            out.marker = ""
        elif tag in ("dd", "blockquote"):
            indent -= 2
        elif tag in ("td", "th") and tables:
            lines = out.done()
            out, indent, lists, pre = outs.pop()
            tables[-1][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag == "table":
            # text beside the cells (captions, strays) stands above them
            lines = out.done()
            lines = lines + _grid(tables.pop())
            out, indent, lists, pre = outs.pop()
            if lines:
                out.put_lines(lines, indent)
        if tag in BLOCKS:
            out.end(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
    return "\n".join(out.done())


def extract(html: str | None) -> str | None:
    return None if html is None else render(build(html))


def texts(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per page: key, the columns ``keep`` and ``text``.

    A null page gives null, an empty one empty text; repeated rows stay repeated; an empty
    table gives an empty table; other columns of any name are left alone. Pages are parsed
    whole, however long or deep. Malformed markup never fails: what isn't a tag is text.
    Widths in tables count code points.
    """

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            done = pa.array([extract(x) for x in b.column(0).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([*b.columns[1:], done], names=[*(f"c{i}" for i in range(1, b.num_columns)), "text"])

        return one

    kinds = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate([key, *keep], 1))
    return W.per_text(pages, [html, key, *keep], make, f"{kinds}, text string").toDF(key, *keep, "text")
