"""Layout-aware text of HTML: a tree with implied tags, visibility rules, and a renderer that keeps the layout.

* Scanner: tags, comments, declarations and raw-text elements, each character looked at a bounded number of times.
* Tree: void elements, implied ends (a block ends a paragraph, an item an item, a row a row …), ends that match no
  open element are ignored, all that is open at the end is closed.
* Visibility: elements that browsers do not show, ``hidden``, and inline styles that hide. Formulas are shown, of
  SVG the text elements and foreign objects; what stands in definitions, also if ``use`` draws it, is not.
* Rendering: paragraphs and headings stand between blank lines, other blocks on lines of their own, list items
  carry marks and indents, ``pre`` keeps its space, cells of a table are padded to columns line by line, and keep
  the columns and rows that they span. Only where padding would be far more than the text, lines run over.
Trees are walked with a stack of their own, so depth is bounded by memory alone.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame

from splitlab.llm.frames import pick, with_ids

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style title template noscript iframe object embed audio video canvas datalist "
    "noembed noframes link meta base param source track area".split()
)
#: Of SVG and MathML.
FOREIGN_UNSEEN = frozenset(
    "title desc metadata defs style script symbol marker pattern clippath mask lineargradient radialgradient filter "
    "annotation annotation-xml mphantom".split()
)
#: Foreign elements that hold HTML, HTML elements that end foreign ones, and formulas whose parts stand apart.
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
APART = frozenset("mfrac mroot msub msup msubsup munder mover munderover mtr mtable".split())
#: Block elements and the blank lines around them.
BLOCKS = dict.fromkeys(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html "
    "legend li main nav optgroup option search section summary tbody td tfoot th thead tr caption select".split(), 0
) | dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split(), 1)
#: An open element that a starting one ends, up to an element that shuts it in.
_ENDS_P = frozenset(BLOCKS) - frozenset("body html td th tr tbody thead tfoot caption option optgroup select legend".split())
CLOSES = {name: (frozenset(["p"]), frozenset(["td", "th", "caption", "button", "table"])) for name in _ENDS_P} | {
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu", "td", "th", "table"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl", "td", "th", "table"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl", "td", "th", "table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    **{
        name: (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), frozenset(["table"]))
        for name in ("thead", "tbody", "tfoot")
    },
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
#: An end tag does not reach beyond these, unless it names one of them.
_WALLS = frozenset(["table", "td", "th", "caption"])
_TABLE_ENDS = _WALLS | {"tr", "tbody", "thead", "tfoot"}
GROUPS = frozenset(["thead", "tbody", "tfoot"])
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: HTML white space.
_BLANK = " \t\n\f\r"
_BLANKS = re.compile(r"[ \t\n\f\r]+")
MAX_SPAN, MAX_ROWS = 1000, 65534
#: Blanks that may pad a table, by its characters and besides; beyond them columns are padded to MAX_CELL, or not at all.
PADDING, PADDING_FREE, MAX_CELL = 16, 1_000_000, 60


def scan(page: str):
    """("text", value), ("open", name, attributes text, self-closed) and ("close", name) in order."""
    at, n = 0, len(page)
    lost = set()  # quotes that do not occur any more
    foreign = 0  # open svg and math elements
    low = None
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:]
            return
        if mark > at:
            yield "text", page[at:mark]
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if foreign and page.startswith("<![CDATA[", mark):
            end = page.find("]]>", mark + 9)
            end = n if end < 0 else end
            yield "text", html.escape(page[mark + 9 : end], quote=False)
            at = end + 3
            continue
        if page[mark + 1 : mark + 2] in ("!", "?"):
            end = page.find(">", mark)
            if end < 0:
                return
            at = end + 1
            continue
        closing = page.startswith("/", mark + 1)
        name = _NAME.match(page, mark + 1 + closing)
        if not name:
            if closing:
                end = page.find(">", mark)
                if end < 0:
                    return
                at = end + 1
            else:
                yield "text", "<"
                at = mark + 1
            continue
        start = at = name.end()
        while True:  # the end of the tag, not within quotes
            end = page.find(">", at)
            if end < 0:
                return
            quote = None
            for q in ('"', "'"):
                if q not in lost:
                    place = page.find(q, at, end)
                    if place >= 0 and (quote is None or place < quote):
                        quote = place
            if quote is None:
                break
            after = page.find(page[quote], quote + 1)
            if after < 0:
                lost.add(page[quote])
                break
            at = after + 1
        tag, attributes = name.group().lower(), page[start:end]
        at = end + 1
        if closing:
            foreign = max(foreign - (tag in ("svg", "math")), 0)
            yield "close", tag
            continue
        alone = attributes.endswith("/")
        foreign += tag in ("svg", "math") and not alone
        yield "open", tag, attributes, alone
        if tag in RAW and not (alone and foreign):
            low = page.lower() if low is None else low
            if len(low) != n:  # lower case may change the length of rare letters; then look for the tag as written
                low = page
            end = low.find(f"</{tag}", at)
            if end < 0:
                end = n
            if end > at:
                yield "text", page[at:end]
            at = end


class Element:
    """``foreign``: of SVG or MathML; ``inner``: its children are; ``shown``: its own texts are."""

    __slots__ = ("tag", "attributes", "children", "foreign", "inner", "shown")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None = None):
        self.tag, self.attributes, self.children = tag, attributes, []
        held = parent is not None and parent.inner
        self.foreign = held or tag in ("svg", "math")
        self.inner = self.foreign and not (held and tag in HOLDS_HTML)
        self.shown = tag != "svg" and (parent is None or parent.shown or held and tag in ("text", "foreignobject"))


def _attributes(text: str) -> dict[str, str]:
    if not text or text == "/":
        return {}
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def build(page: str) -> Element:
    """The tree of a page; children are elements and decoded texts."""
    root = Element("html", {})
    stack = [root]
    places: dict[str, list[int]] = {"html": [0]}  # where each tag stands in the stack, so that no search walks it

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    for event in scan(page):
        if event[0] == "text":
            raw = event[1]
            top = stack[-1]
            if top.tag in RAW and top.tag not in ("textarea", "title"):
                top.children.append(raw)
            else:
                top.children.append(html.unescape(raw) if "&" in raw else raw)
        elif event[0] == "open":
            _, tag, attributes, alone = event
            if tag in ("html", "body"):
                root.attributes.update(_attributes(attributes))
                continue
            if stack[-1].inner and tag in ENDS_FOREIGN:
                while stack[-1].inner:
                    cut(len(stack) - 1)
            ends, walls = CLOSES.get(tag, (None, None))
            while ends and (i := last(ends)) and last(walls - ends) < i:
                cut(i)
                if tag not in ("tr", "thead", "tbody", "tfoot", "optgroup", "li", "dt", "dd"):
                    break
            element = Element(tag, _attributes(attributes), stack[-1])
            stack[-1].children.append(element)
            if tag not in VOID and not (alone and (element.foreign or tag == "path")):
                places.setdefault(tag, []).append(len(stack))
                stack.append(element)
        else:
            tag = event[1]
            if tag == "br":
                stack[-1].children.append(Element("br", {}))
            elif tag == "p" and not places.get("p"):
                stack[-1].children.append(Element("p", {}))
            elif tag not in ("html", "body") and places.get(tag):
                i = places[tag][-1]
                if tag in _TABLE_ENDS or last(_WALLS - {tag}) < i:
                    cut(i)
    return root


def visible(element: Element) -> bool:
    attributes = element.attributes
    if element.tag in UNSEEN or "hidden" in attributes:
        return False
    if element.tag == "input":
        return False
    if element.foreign and (
        element.tag in FOREIGN_UNSEEN
        or attributes.get("display") == "none"
        or attributes.get("visibility") in ("hidden", "collapse")
    ):
        return False
    if "style" not in attributes:
        return True
    style = {name.lower(): value.lower() for name, value in _SHOWS.findall(attributes["style"])}  # the last one holds
    return style.get("display") != "none" and style.get("visibility") not in ("hidden", "collapse")


class Lines:
    """Lines of one flow of blocks: the page, or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space, self.gap, self.indent, self.mark = False, 0, "", ""

    def add(self, text: str) -> None:
        words = _BLANKS.sub(" ", text)
        if words[0] == " ":
            self.space = True
        core = words.strip(" ")
        if core:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(core)
            self.space = words[-1] == " "

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = self.indent
        if self.mark:
            lead = self.indent[: len(self.indent) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append(lead + line)

    def end(self) -> None:
        if self.parts:
            self.put("".join(self.parts))
            self.parts = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)


class Table:
    """Rows of cells (lines, columns and rows spanned), and the rows at which row groups begin."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.cuts: list[int] = []

    def places(self) -> list[tuple[int, int, int, int, list[str]]]:
        """(row, end row, column, end column, lines) of each cell; cells stand right of those that reach down to them."""
        out, busy = [], []  # (column, end column, end row)
        ends = [*self.cuts, len(self.rows)]
        at = 0
        for r, row in enumerate(self.rows):
            while ends[at] <= r:
                at += 1
            busy = [b for b in busy if b[2] > r]
            column = k = 0
            added = []
            for lines, across, down in row:
                while k < len(busy) and busy[k][0] <= column:
                    column = max(column, busy[k][1])
                    k += 1
                end = min(r + down, ends[at]) if down else ends[at]
                out.append((r, end, column, column + across, lines))
                if end > r + 1:
                    if added and added[-1][1:] == (column, end):
                        added[-1] = (added[-1][0], column + across, end)
                    else:
                        added.append((column, column + across, end))
                column += across
            if added:
                busy = sorted(busy + added)
        return out


def _starts(spans: list[tuple[int, int, int]]) -> dict[int, int]:
    """Least place of each edge, so that every (edge, later edge, size) has room between its edges."""
    due: dict[int, list[tuple[int, int]]] = {}
    for low, high, size in spans:
        due.setdefault(low, [])
        due.setdefault(high, []).append((low, size))
    place, last = {}, 0
    for edge in sorted(due):
        place[edge] = last = max([last, *(place[low] + size for low, size in due[edge])])
    return place


def table_lines(table: Table) -> list[str]:
    """The cells as padded columns; a row is as high as its cells, and rows without text have no line."""
    cells = [c for c in table.places() if c[4]]
    tops = _starts([(row, end, len(lines)) for row, end, _, _, lines in cells])
    grid: dict[int, list[tuple[int, str]]] = {}
    for row, _, column, _, lines in cells:
        for i, line in enumerate(lines):
            if line:
                grid.setdefault(tops[row] + i, []).append((column, line))
    text = sum(len(line) for *_, lines in cells for line in lines)
    for most in (text, MAX_CELL, 0):
        wide = [(low, end, min(max(map(len, lines)), most) + 2 * (most > 0)) for _, _, low, end, lines in cells]
        left = _starts(wide)
        if sum(max(left[c] for c, _ in parts) for parts in grid.values()) <= PADDING * text + PADDING_FREE:
            break
    out = []
    for y in range(max(grid, default=-1) + 1):
        line = ""
        for column, part in sorted(grid.get(y, []), key=lambda x: x[0]):
            line = line.ljust(max(left[column], len(line) + 2 if line else 0)) + part
        out.append(line.rstrip())
    return out


def _span(text: str, least: int, most: int) -> int:
    return min(max(int(text), least), most) if text.isascii() and text.isdigit() and len(text) < 6 else 1


def render(root: Element) -> str:
    """All visible text of a tree, by one walk with a stack of (element, next child)."""
    flow = Lines()
    flows, tables, lists = [flow], [], []
    pre = 0
    stack = [(root, iter(root.children), None)]
    while stack:
        element, children, leave = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if leave == "cell":
                flow.end()
                lines = flows.pop().lines
                flow = flows[-1]
                if tables:
                    across = _span(element.attributes.get("colspan", ""), 1, MAX_SPAN)
                    down = _span(element.attributes.get("rowspan", ""), 0, MAX_ROWS)  # 0: to the end of the group
                    if not tables[-1].rows:
                        tables[-1].rows.append([])
                    tables[-1].rows[-1].append((lines, across, down))
            elif leave == "table":
                table = tables.pop()
                flow.end()  # text that stood outside cells
                for line in table_lines(table):
                    flow.put(line) if line else flow.block(1)
                flow.block(1)
            elif leave == "item":
                flow.end()
                flow.indent, flow.mark = lists[-1][2].pop(), ""
            elif leave == "list":
                lists.pop()
                flow.block(0 if lists else 1)
            elif leave == "quote":
                flow.end()
                flow.indent = flow.indent[:-2]
                flow.block(1)
            elif leave == "apart":
                flow.space = True
            elif leave is not None:
                if element.tag == "pre":
                    pre -= 1
                elif element.tag in GROUPS and tables:
                    tables[-1].cuts.append(len(tables[-1].rows))
                flow.block(leave)
            continue
        if isinstance(child, str):
            if child and element.shown:
                if pre:
                    first, *rest = child.replace("\r\n", "\n").split("\n")
                    flow.parts.append(first)
                    for line in rest:
                        flow.put("".join(flow.parts))
                        flow.parts = [line]
                else:
                    flow.add(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        leave = None
        if child.foreign:
            if tag in ("text", "foreignobject") or tag in APART or element.tag in APART:
                flow.space = True  # labels, and the parts of a formula
                leave = "apart"
            elif tag == "math" and child.attributes.get("display") == "block":
                flow.block(0)
                leave = 0
            stack.append((child, iter(child.children), leave))
            continue
        if tag == "br":
            if flow.parts:
                flow.end()
            else:
                flow.gap = max(flow.gap, 1)
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag == "table":
            flow.block(1)
            tables.append(Table())
            leave = "table"
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th") and tables:
            flow = Lines()
            flows.append(flow)
            leave = "cell"
        elif tag in ("ul", "ol", "menu"):
            flow.block(0 if lists else 1)
            first = child.attributes.get("start", "")
            lists.append([tag, int(first) if first.isascii() and first.isdigit() and len(first) < 10 else 1, []])
            leave = "list"
        elif tag == "li":
            if not lists:
                lists.append(["ul", 1, []])
            flow.block(0)
            kind = lists[-1]
            mark = "- " if kind[0] != "ol" else f"{kind[1]}. "
            kind[1] += 1
            kind[2].append(flow.indent)
            flow.indent += " " * len(mark)
            flow.mark = mark
            leave = "item"
        elif tag in ("blockquote", "dd"):
            flow.block(1 if tag == "blockquote" else 0)
            flow.indent += "  "
            leave = "quote"
        elif tag in BLOCKS:
            leave = BLOCKS[tag]
            flow.block(leave)
            if tag == "pre":
                pre += 1
            elif tag in GROUPS and tables:
                tables[-1].cuts.append(len(tables[-1].rows))
        if tag == "details" and "open" not in child.attributes:
            shown = [c for c in child.children if isinstance(c, Element) and c.tag == "summary"][:1]
            stack.append((child, iter(shown), leave))
        else:
            stack.append((child, iter(child.children), leave))
    flow.end()
    return "\n".join(flow.lines)


def page_text(page: str | None) -> str:
    return render(build(page or ""))


def extract(pages: DataFrame, page_id="page_id", page="html") -> DataFrame:
    """(page_id, text) of every whole page.

    Null and empty pages have an empty text. Repeated rows are rendered each by itself; an empty table gives no
    rows; other columns are left behind.
    """

    def work(batches):
        for batch in batches:
            yield pd.DataFrame({"page_id": batch[page_id], "text": [page_text(p) for p in batch[page]]})

    return with_ids(pick(pages, page_id, page), page_id, work, "page_id", "text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
