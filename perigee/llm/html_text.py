"""Visible text of HTML pages, laid out as it is read.

A tree builder closes what authors leave open (paragraphs, list items, table cells, rows, options),
ignores stray end tags and knows elements without content.  The tree is walked once: what is not shown
is skipped, blocks start on lines of their own with blank lines around paragraphs and headings, list items carry their bullet or
number and an indent, preformatted text keeps its blanks, and the cells of a table are aligned in
columns.  Formulas (MathML) are text; in drawings (SVG) each text element has a line of its own, and definitions, titles,
descriptions and annotations of both are not shown.  Pages are independent, so this is a function of one column without any shuffle.

Of style attributes ``display`` and ``visibility`` count, the last declaration of each and an important one before others: no display cuts off all
below, while text of invisible elements is left out and that of visible elements in them is not.  Stylesheets of the page are not read.

Defined results: NULL stays NULL, an empty page has empty text.  Broken or cut markup is text where it is
no tag; open elements end with the page.  No recursion, so depth is bounded by memory alone.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A quote opens a string only directly after "="; anywhere else, or if it never closes, it is an ordinary character.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+))?+)*+)(?:>|\Z)", re.S
)
BLANKS = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset(
    "script style head title template noscript noembed noframes iframe object audio video canvas datalist".split()
)
# Lines of space a block asks for before and after itself.
SPACE = dict.fromkeys(
    "address article aside body center details dialog dd div dt fieldset figcaption figure footer form header hgroup html legend li "
    "main nav option search section summary select table caption tr #label".split(), 1
) | dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre hr".split(), 2)
# Not shown inside svg and math, where elements may close themselves; elements that show HTML there, and those that end it.
FOREIGN_UNSEEN = frozenset(
    "annotation annotation-xml clippath defs desc filter lineargradient marker mask metadata pattern radialgradient symbol".split()
)
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
CLOSES_P = frozenset(SPACE) - {"body", "html", "legend", "option", "caption", "tr", "select", "#label"}
# A start tag ends an open element of the second set, but looks no further up than the third.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("table td th caption button object template html foreignobject".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
IMPORTANT = re.compile(r"\s*!\s*important$")


class Node:
    __slots__ = ("tag", "attributes", "children", "unseen")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children, self.unseen = tag, attributes, [], False


def _attributes(source: str) -> dict:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


class _Builder:
    def __init__(self):
        self.root = Node("#page", {})
        self.open = [self.root]
        # Places in ``open`` of svg, math and the elements in them that hold HTML.
        self.islands = []

    def _end_up_to(self, at: int) -> None:
        del self.open[at:]
        while self.islands and self.islands[-1] >= at:
            self.islands.pop()

    def _foreign(self) -> bool:
        return bool(self.islands) and self.open[self.islands[-1]].tag in ("svg", "math")

    def _find(self, tags, barrier) -> int:
        """Index of the innermost open element of ``tags`` inside the barrier, or 0."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in barrier:
                return 0
        return 0

    def text(self, value: str) -> None:
        top = self.open[-1]
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and not value.strip(" \t\n\f\r"):
            return
        if top.tag == "head" and value.strip(" \t\n\f\r"):
            self._end_up_to(len(self.open) - 1)
            top = self.open[-1]
        top.children.append(value)

    def start(self, tag: str, source: str) -> bool:
        """Opens an element; whether it is closed by its own tag, as in svg and math."""
        while tag in BREAKS_OUT and self._foreign():
            self._end_up_to(self.islands[-1])
        if self._foreign() or tag in ("svg", "math"):
            return self._start_foreign(tag, source)
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._end_up_to(len(self.open) - 1)
        if tag in CLOSES_P and (at := self._find({"p"}, SCOPE)):
            self._end_up_to(at)
        if tag in IMPLIED_ENDS:
            ends, barrier = IMPLIED_ENDS[tag]
            at = self._find(ends, barrier)
            if at:
                self._end_up_to(at)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", "")
        node = Node(tag, _attributes(source) if source and not source.isspace() else {})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
        return False

    def _start_foreign(self, tag: str, source: str) -> bool:
        if self.open[-1].tag == "head":
            self._end_up_to(len(self.open) - 1)
        inside = self._foreign()
        node = Node("#label" if inside and tag == "text" else tag, _attributes(source))
        if inside and tag in FOREIGN_UNSEEN:
            node.attributes["hidden"] = ""
        self.open[-1].children.append(node)
        if source.endswith("/") and not any(m.end() == len(source) for m in ATTRIBUTE.finditer(source)):
            return True
        if tag in ("svg", "math") or tag in HTML_INSIDE:
            self.islands.append(len(self.open))
        self.open.append(node)
        return False

    def end(self, tag: str) -> None:
        if tag == "p" and not self._find({"p"}, SCOPE):
            self.start("p", "")
        if tag == "br":
            self.start("br", "")
            return
        # Cells and rows end at their table; others do not reach out of a cell.
        barrier = {"table"} - {tag} if tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption") else SCOPE - {tag}
        at = self._find({"#label", tag} if tag == "text" else {tag}, barrier)
        if at:
            self._end_up_to(at)


def parse(page: str) -> Node:
    """The tree of a page."""
    builder, at, low = _Builder(), 0, None
    for_raw = None
    while True:
        token = TOKEN.search(page, at)
        if not token:
            break
        if token.start() > at:
            builder.text(unescape(page[at : token.start()]))
        at = token.end()
        tag = token.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if token.group(1):
            builder.end(tag)
            continue
        if builder.start(tag, token.group(3)):
            continue
        if tag in RAW:
            low = low if low is not None else page.lower()
            for_raw = f"</{tag}"
            end = low.find(for_raw, at)
            end = len(page) if end < 0 else end
            if tag in ("textarea", "xmp"):
                builder.open[-1].children.append(unescape(page[at:end]) if tag == "textarea" else page[at:end])
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            builder.end(tag)
    if at < len(page):
        builder.text(unescape(page[at:]))
    return builder.root


def _declared(style: str, name: str) -> str:
    """The value of a property in a style attribute, or an empty text: the last declaration counts, an important one before others."""
    plain = important = ""
    for part in STYLE_COMMENT.sub("", style).lower().split(";"):
        key, _, value = part.partition(":")
        if key.strip() == name and (value := value.strip()):
            if IMPORTANT.search(value):
                important = IMPORTANT.sub("", value)
            else:
                plain = value
    return important or plain


def _unseen(node: Node, parent: Node | None) -> bool:
    """Whether text directly in the node is invisible: as declared, else as in its parent."""
    declared = _declared(node.attributes["style"], "visibility") if "style" in node.attributes else ""
    if declared in ("hidden", "collapse"):
        return True
    return parent is not None and parent.unseen and declared not in ("visible", "initial")


def _shown(node: Node, parent: Node | None) -> bool:
    if node.tag in UNSEEN:
        return False
    if parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return False
    a = node.attributes
    if not a:
        return node.tag != "dialog"
    if "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False
    return not ("style" in a and _declared(a["style"], "display") == "none")


class _Page:
    """Lines under construction: collapsed blanks, wanted line breaks, indents and marks of list items."""

    def __init__(self):
        self.parts, self.breaks, self.blank, self.indent, self.mark = [], 0, False, "", None
        self.started = False

    def space(self, lines: int) -> None:
        self.breaks = max(self.breaks, lines)
        self.blank = False

    def line(self) -> None:
        self.breaks = self.breaks + 1 if self.started else 0
        self.blank = False

    def _open(self) -> None:
        if self.breaks or not self.started:
            if self.started:
                self.parts.append("\n" * self.breaks)
            lead = self.indent
            if self.mark is not None:
                lead, self.mark = self.mark, None
            self.parts.append(lead)
            self.breaks, self.blank, self.started = 0, False, True
        elif self.blank:
            self.parts.append(" ")
        self.blank = False

    def text(self, value: str) -> None:
        words = BLANKS.sub(" ", value)
        inner = words.strip(" ")
        if not inner:
            self.blank = self.blank or bool(words)
            return
        if words[0] == " ":
            self.blank = True
        self._open()
        self.parts.append(inner)
        self.blank = words[-1] == " "

    def kept(self, value: str) -> None:
        for i, row in enumerate(value.replace("\r\n", "\n").split("\n")):
            if i:
                self.line()
            if row:
                self._open()
                self.parts.append(row)

    def result(self) -> str:
        return "".join(self.parts)


def _number(value: str | None, otherwise: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return otherwise


class _Table:
    def __init__(self):
        self.rows, self.over = [], {}

    def add(self, text: str, attributes: dict) -> None:
        if not self.rows:
            self.rows.append([])
        row, at = len(self.rows) - 1, 0
        taken = {c for c, _, _ in self.rows[row]}
        held = self.over.get(row, set())
        while at in held or at in taken:
            at += 1
        width = min(max(_number(attributes.get("colspan"), 1), 1), 1000)
        down = min(max(_number(attributes.get("rowspan"), 1), 1), 1000)
        self.rows[row].append((at, width, text.split("\n")))
        for c in range(at + 1, at + width):
            self.rows[row].append((c, 0, []))
        for r in range(row + 1, row + down):
            self.over.setdefault(r, set()).update(range(at, at + width))

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for at, span, cell in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), max(map(len, cell)))
        for row in self.rows:
            for at, span, cell in row:
                if span > 1:
                    room = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                    widths[at + span - 1] = widths.get(at + span - 1, 0) + max(0, max(map(len, cell)) - room)
        out = []
        for row in self.rows:
            height = max((len(cell) for _, _, cell in row), default=0)
            for i in range(height):
                pieces, at = [], 0
                for column, span, cell in sorted(row, key=lambda c: c[0]):
                    if not span:
                        continue
                    while at < column:
                        pieces.append(" " * widths.get(at, 0))
                        at += 1
                    room = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                    pieces.append((cell[i] if i < len(cell) else "").ljust(room))
                    at = column + span
                out.append("  ".join(pieces).rstrip())
        return [line for line in out if line]


def render(page: str) -> str:
    """All visible text of a page."""
    root = parse(page)
    out, tables, lists, pages = _Page(), [], [], []
    keep = 0
    stack: list = [(root, None, False)]
    while stack:
        item, parent, leaving = stack.pop()
        if isinstance(item, str):
            if parent.unseen or (parent.tag == "details" and "open" not in parent.attributes):
                continue
            if keep:
                out.kept(item)
            else:
                out.text(item)
            continue
        tag = item.tag
        if leaving:
            if tag in ("pre", "textarea"):
                keep -= 1
            if tag in ("td", "th") and pages and pages[-1][0] is item:
                text = out.result()
                out = pages.pop()[1]
                tables[-1].add(text, item.attributes)
                continue
            if tag == "table" and tables:
                grid = tables.pop()
                out.space(1)
                for line in grid.lines():
                    out.kept(line)
                    out.space(1)
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                out.indent = out.indent[:-2]
            elif tag == "dd" or tag == "blockquote":
                out.indent = out.indent[:-2]
            elif tag == "li":
                out.mark = None
                out.indent = out.indent[:-2]
            if tag in SPACE:
                out.space(1 if tag in ("ul", "ol", "menu") and lists else SPACE[tag])
            continue
        if not _shown(item, parent):
            continue
        item.unseen = _unseen(item, parent)
        if tag == "br":
            out.line()
            continue
        if tag == "wbr" or (tag in VOID and tag != "hr"):
            continue
        if tag in SPACE and not (tag in ("tr", "caption") and tables and tag == "tr"):
            out.space(1 if tag in ("ul", "ol", "menu") and lists else SPACE[tag])
        if tag in ("pre", "textarea"):
            keep += 1
        elif tag == "table":
            tables.append(_Table())
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th") and tables:
            pages.append((item, out))
            out = _Page()
        elif tag in ("ul", "ol", "menu"):
            lists.append([tag, _number(item.attributes.get("start"), 1)])
            out.indent += "  "
        elif tag == "li":
            bullet = "* "
            if lists and lists[-1][0] == "ol":
                number = _number(item.attributes.get("value"), lists[-1][1])
                lists[-1][1] = number + 1
                bullet = f"{number}. "
            out.mark = None if item.unseen else out.indent + bullet
            out.indent += "  "
        elif tag == "dd" or tag == "blockquote":
            out.indent += "  "
        stack.append((item, parent, True))
        stack.extend((child, item, False) for child in reversed(item.children))
    return out.result()


def visible_text(html: Column) -> Column:
    """The rendered text of a column of pages."""

    def of(column: pa.Array) -> pa.Array:
        return pa.array([None if page is None else render(page) for page in column.to_pylist()], pa.string())

    return F.arrow_udf(of, "string")(html)
