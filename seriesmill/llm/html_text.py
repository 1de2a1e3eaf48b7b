"""Layout-aware text of HTML pages.

One pass over tags and texts drives a tree builder with implied tags, whose open and close events drive
a renderer: blocks are set apart, list items get bullets or numbers and indents, cells of a table are
aligned in columns, preformatted text keeps its spaces, and what is not displayed is left out. Nothing
recurses, so depth of nesting is bounded by memory only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .css import Cascade, applies
from .scratch import text_chunks

#: Columns of a table are padded up to this width; longer cells run on.
PAD = 60
#: Columns from this one on are not aligned.
COLUMNS = 100
#: Levels of indents that are shown, and of tables in tables whose columns are aligned: text grows with its page.
INDENTS, TABLES = 24, 6
# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist".split())
#: Within svg only text elements show their text; these never do. In math, notes on the formula.
FOREIGN_UNSEEN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter script style".split()),
    "math": frozenset("annotation annotation-xml script style".split()),
}
#: Where html starts again inside of svg and math, and tags that end svg and math elsewhere.
INTEGRATION = {"svg": frozenset(("foreignobject", "desc", "title")), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCKS = {
    **dict.fromkeys("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option search section summary ul".split(), 0),
    **dict.fromkeys("blockquote h1 h2 h3 h4 h5 h6 hr listing p plaintext pre table xmp".split(), 1),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section table ul".split())
BOUNDARY = frozenset("table td th caption button html template object marquee applet foreignobject select".split())
TABLED = frozenset("table caption tbody tfoot thead tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes these, up to the nearest of the second set.
IMPLIED = {
    "li": (("li",), {"ul", "ol", "menu", "dir"}),
    "dt": (("dt", "dd"), {"dl"}),
    "dd": (("dt", "dd"), {"dl"}),
    "option": (("option",), {"select", "datalist", "optgroup"}),
    "optgroup": (("optgroup", "option"), {"select"}),
    "tr": (("tr", "td", "th", "caption"), {"table"}),
    "td": (("td", "th", "caption"), {"tr", "table"}),
    "th": (("td", "th", "caption"), {"tr", "table"}),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}),
    "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}),
}
#: Attributes as in the HTML tokenizer: a quote opens a value only after =, other values run to a blank or >.
#: Possessive, so that a tag is read in one go whatever its quotes.
VALUE = r"(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)|(?=>|\Z))"
ATTRIBUTE = re.compile(rf"(=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+{VALUE})?+")
REST = ATTRIBUTE.pattern.replace("(\"", "(?:\"").replace("([^", "(?:[^").replace("(=", "(?:=", 1)
TAG = re.compile(rf"<(?:!--(?:>|->|(?P<comment>.*?)(?:--!?>|\Z))|(?P<close>/)?(?P<name>[A-Za-z][^ \t\n\f\r/>]*+)(?P<rest>(?:[ \t\n\f\r/]++|{REST})*+)(?P<end>>|\Z)|(?P<bogus>[!?/][^>]*(?:>|\Z)))", re.S)
BLANKS = re.compile(r"[ \t\n\f\r]+")


class Canvas:
    """Lines of text with pending white space, margins and indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.margin = 0
        self.indents: list[str] = []
        self.bullet = ""

    def _begin(self) -> None:
        if not self.line:
            if self.lines and self.margin:
                have = 0
                while have < self.margin and have < len(self.lines) and self.lines[-1 - have] == "":
                    have += 1
                self.lines += [""] * (self.margin - have)
            self.margin = 0
            indent = "".join(self.indents[:INDENTS])
            if self.bullet:
                indent = indent[: max(0, len(indent) - len(self.bullet))] + self.bullet
                self.bullet = ""
            self.line.append(indent)
            self.space = False

    def words(self, text: str) -> None:
        parts = BLANKS.split(text)
        body = [p for p in parts if p]
        if not body:
            self.space = self.space or bool(self.line)
            return
        if parts[0] == "" and self.line:
            self.space = True
        self._begin()
        if self.space:
            self.line.append(" ")
        self.line.append(" ".join(body))
        self.space = parts[-1] == ""

    def kept(self, text: str) -> None:
        """Preformatted text."""
        for k, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.broken()
            if part:
                self._begin()
                self.line.append(part)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def broken(self) -> None:
        if not self.line:
            self._begin()
        self.end_line()

    def block(self, margin: int) -> None:
        self.end_line()
        self.margin = max(self.margin, margin)

    def whole(self, lines: list[str], margin: int) -> None:
        """Lines laid out already."""
        self.block(margin)
        for line in lines:
            self._begin()
            self.line.append(line)
            self.end_line()
        self.block(margin)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and self.lines[-1] == "":
            self.lines.pop()
        return self.lines


@dataclass
class Table:
    rows: list[list[tuple[int, list[str]]]] = field(default_factory=list)
    spans: dict[int, int] = field(default_factory=dict)  # column: rows that a cell above still covers
    column: int = 0
    plain: bool = False  # too deep in other tables: rows are blocks

    def row(self) -> None:
        self.rows.append([])
        self.column = 0

    def place(self, across: int, down: int) -> int:
        if not self.rows:
            self.row()
        while self.spans.get(self.column, 0) > 0:
            self.spans[self.column] -= 1
            self.column += 1
        at = self.column
        self.column += across
        for c in range(at, at + across if down > 1 else at):
            self.spans[c] = down - 1
        return at

    def finish_row(self) -> None:
        for c in [c for c in self.spans if c >= self.column]:
            self.spans[c] -= 1
            if self.spans[c] <= 0:
                del self.spans[c]

    def laid_out(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for at, lines in row:
                width[at] = max(width.get(at, 0), min(PAD, max(map(len, lines), default=0)))
        out = []
        aligned = [c for c in sorted(width) if c < COLUMNS]
        for row in self.rows:
            for k in range(max((len(lines) for _, lines in row), default=0)):
                cells = {at: lines[k] for at, lines in row if k < len(lines)}
                last = max(cells)
                line = [cells.get(c, "").ljust(width[c]) for c in aligned if c <= last]
                out.append("  ".join(line + [text for c, text in sorted(cells.items()) if c >= COLUMNS]).rstrip(" "))
        return out


@dataclass
class Node:
    name: str
    seen: bool
    visible: bool
    pre: bool
    margin: int = -1
    indent: bool = False
    number: int = 0
    cell: tuple[int, Canvas] | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    foreign: str = ""  # svg or math
    label: bool = False  # whether text shows inside of svg
    picks: list[tuple[bool, bool, str]] | None = None  # a drop-down's options: whether selected, whether disabled, text
    option: Canvas | None = None
    judged: dict = field(default_factory=dict)  # what stylesheets say of children, by name and attributes


class Page:
    def __init__(self, css: Cascade | None = None) -> None:
        self.canvases = [Canvas()]
        self.tables: list[Table] = []
        self.stack = [Node("#root", True, True, False)]
        self.scopes: list[Counter] = [Counter()]
        self.names: Counter = Counter()  # of all open elements
        self.css = css or Cascade()
        self.styled = css is not None  # whether all stylesheets are in already
        self.drawn = False  # whether an element that may show text was opened
        self.late = False  # whether one came after elements of the body

    # Tree builder

    def _push(self, node: Node) -> None:
        self.stack.append(node)
        self.names[node.name] += 1
        if node.name in BOUNDARY:
            self.scopes.append(Counter())
        self.scopes[-1][node.name] += 1

    def _pop(self) -> None:
        node = self.stack.pop()
        self.names[node.name] -= 1
        self.scopes[-1][node.name] -= 1
        if node.name in BOUNDARY and len(self.scopes) > 1:
            self.scopes.pop()
        self._closed(node)

    def _pop_to(self, name: str) -> None:
        while len(self.stack) > 1:
            last = self.stack[-1].name
            self._pop()
            if last == name:
                return

    def open(self, name: str, rest: str) -> None:
        if name in ("html", "body") and any(n.name == name for n in self.stack[:4]):
            return
        if self.scopes[-1]["select"] > 0 and (name in ("select", "input", "textarea") or (name in TABLED and self.tables)):
            self._pop_to("select")
            if name == "select":
                return
        if name in BREAKOUT and self.stack[-1].foreign and self.stack[-1].name not in INTEGRATION[self.stack[-1].foreign]:
            while self.stack[-1].foreign and self.stack[-1].name not in INTEGRATION[self.stack[-1].foreign]:
                self._pop()
        if self.stack[-1].name == "head" and name not in ("title", "style", "script", "meta", "link", "base", "template", "noscript"):
            self._pop()
        if name in CLOSES_P and self.scopes[-1]["p"] > 0:
            self._pop_to("p")
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self._pop()
        if name in IMPLIED:
            ends, stop = IMPLIED[name]
            for k in range(len(self.stack) - 1, 0, -1):
                n = self.stack[k].name
                if n in stop or (n in BOUNDARY and n not in ends) or len(self.stack) - k > 200:
                    break
                if n in ends:
                    while len(self.stack) > k:
                        self._pop()
            if name in ("td", "th") and self.stack[-1].name != "tr" and self.tables:
                self._push(self._node("tr", ""))
        node = self._node(name, rest)
        if name in VOID:
            self._void(node)
        elif node.foreign and rest.endswith("/") and ATTRIBUTE.sub("", rest).endswith("/"):
            if node.seen and node.option is None:
                self._closed(node)
        else:
            self._push(node)

    def close(self, name: str) -> None:
        if name == "p" and not self.scopes[-1]["p"]:
            self.open("p", "")
        if name == "br":
            self.open("br", "")
            return
        if self.scopes[-1][name] > 0:
            self._pop_to(name)
        elif name in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption", "button") or name in BOUNDARY:
            if self.names[name] > 0 and (name != "tr" or self.tables):
                self._pop_to(name)
        elif name in ("div", "ul", "ol", "article", "section", "main", "nav", "aside", "header", "footer", "form", "body") and self.stack[-1].name not in BOUNDARY:
            pass  # its opening tag is outside of a cell or missing

    def _select(self) -> Node | None:
        """The select that is open in this cell, button or page."""
        if self.scopes[-1]["select"] <= 0:
            return None
        for node in reversed(self.stack):
            if node.name == "select":
                return node
            if node.name in BOUNDARY:
                return None
        return None

    # Visibility

    def _node(self, name: str, rest: str) -> Node:
        parent = self.stack[-1]
        node = Node(name, parent.seen and name not in UNSEEN, parent.visible, parent.pre or name in ("pre", "listing", "xmp", "textarea", "plaintext"))
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in reversed(ATTRIBUTE.findall(rest))} if rest and not rest.isspace() else {}
        node.attributes = attributes
        within = "" if parent.foreign and parent.name in INTEGRATION[parent.foreign] else parent.foreign
        node.foreign = name if name in ("svg", "math") else within
        if node.foreign:
            node.seen = node.seen and name not in FOREIGN_UNSEEN[node.foreign]
            node.label = node.foreign == "svg" and name != "svg" and (parent.label or name in ("text", "foreignobject"))
            if name == "mphantom":
                node.visible = False
        switched = self.css.switched(self.stack, name, attributes) if node.seen and (self.css.rules or "style" in attributes) else {}
        hint = attributes if node.foreign == "svg" else {}
        display, visibility = switched.get("display", hint.get("display", "revert")), switched.get("visibility", hint.get("visibility", "inherit"))
        if name in ("option", "optgroup") and (owner := self._select()) is not None and owner.picks is not None:
            display, visibility = "inline", "inherit"  # a drop-down shows its choice even if that is hidden in the list
        if display == "none" or name == "input":
            node.seen = False
        elif display in ("revert", "revert-layer") and ("hidden" in attributes or (name == "dialog" and "open" not in attributes)):
            node.seen = False
        if parent.name == "details" and name != "summary" and parent.number == 1:
            node.seen = False
        if visibility in ("hidden", "collapse"):
            node.visible = False
        elif visibility in ("visible", "initial"):
            node.visible = True
        if node.seen:
            self.drawn = self.drawn or name not in ("html", "body")
            self._opened(node, attributes)
        return node

    def stylesheet(self, text: str) -> None:
        """Text of the style element that is open."""
        attributes = self.stack[-1].attributes
        if self.styled or not applies(attributes.get("media", "")) or attributes.get("type", "").strip().lower() not in ("", "text/css"):
            return
        if any(n.name in ("noscript", "template") for n in self.stack):
            return
        before = self.css.order
        self.css.read(text)
        self.late = self.late or (self.css.order > before and not any(n.name == "head" for n in self.stack[:4]) and self.drawn)

    # Renderer

    def _opened(self, node: Node, attributes: dict[str, str]) -> None:
        canvas, name = self.canvases[-1], node.name
        number = lambda key, least, most: min(most, max(least, int(v))) if (v := attributes.get(key, "")).isdecimal() and len(v) < 6 else least
        if name in ("ul", "ol", "menu", "dir", "dl"):
            nested = any(n.name in ("ul", "ol", "menu", "dir", "dl") for n in self.stack[-40:])
            node.margin = 0 if nested else 1
            canvas.block(node.margin)
            node.number = number("start", 1, 99_999) - 1 if name == "ol" else -1
        elif name == "li":
            canvas.block(0)
            owner = next((n for n in reversed(self.stack) if n.name in ("ul", "ol", "menu", "dir")), None)
            mark = "* "
            if owner is not None and owner.name == "ol":
                owner.number += 1
                mark = f"{owner.number}. "
            canvas.indents.append(" " * (2 if owner is None else 0) + " " * len(mark) if owner is None else "  " + " " * len(mark))
            canvas.bullet = mark
            node.margin, node.indent = 0, True
        elif name in ("dd", "blockquote"):
            node.margin = BLOCKS[name]
            canvas.block(node.margin)
            canvas.indents.append("    ")
            node.indent = True
        elif name == "table":
            canvas.block(1)
            self.tables.append(Table(plain=len(self.tables) >= TABLES))
        elif name == "tr" and self.tables:
            if self.tables[-1].plain:
                canvas.block(0)
            else:
                self.tables[-1].row()
        elif name in ("td", "th") and self.tables and self.tables[-1].plain:
            canvas.words(" ")
        elif name in ("td", "th") and self.tables:
            at = self.tables[-1].place(number("colspan", 1, 1000), number("rowspan", 1, 1000))
            node.cell = (at, Canvas())
            self.canvases.append(node.cell[1])
        elif name == "caption" and self.tables:
            node.margin = 0
        elif name == "details":
            node.number = 0 if "open" in attributes else 1
            node.margin = 0
            canvas.block(0)
        elif name == "q":
            if node.visible:
                canvas.words('"')
        elif name == "select":
            canvas.words(" ")
            if "multiple" not in attributes and number("size", 1, 99_999) == 1:
                node.picks = []
        elif name in ("option", "optgroup") and (owner := self._select()) is not None and owner.picks is not None:
            if name == "option":
                node.option = Canvas()
                self.canvases.append(node.option)
        elif name == "optgroup" and attributes.get("label") and node.visible:
            canvas.block(0)
            canvas.words(unescape(attributes["label"]))
            canvas.block(0)
        elif name in ("mtr", "mlabeledtr", "mtd") or (node.label and (name == "text" or (name == "tspan" and attributes.keys() & {"x", "y", "dy"}))):
            canvas.words(" ")
        elif name in BLOCKS:
            node.margin = BLOCKS[name]
            canvas.block(node.margin)

    def _closed(self, node: Node) -> None:
        if not node.seen:
            return
        if node.cell is not None:
            self.canvases.pop()
            self.tables[-1].rows[-1].append((node.cell[0], node.cell[1].done()))
            return
        if node.option is not None:
            self.canvases.pop()
            owner = self._select()
            text = unescape(node.attributes.get("label", "")) or " ".join(filter(None, node.option.done()))
            disabled = "disabled" in node.attributes or any(n.name == "optgroup" and "disabled" in n.attributes for n in self.stack[-1:])
            if owner is not None and owner.picks is not None:
                owner.picks.append(("selected" in node.attributes, disabled, text))
            return
        canvas = self.canvases[-1]
        if node.picks is not None:
            chosen = [t for selected, _, t in node.picks if selected][-1:] or [t for _, disabled, t in node.picks if not disabled][:1]
            if chosen and node.visible:
                canvas.words(chosen[0])
            canvas.words(" ")
        elif node.name == "select" or (node.label and node.name == "text"):
            canvas.words(" ")
        if node.name == "table" and self.tables:
            table = self.tables.pop()
            if table.plain:
                canvas.block(1)
            else:
                canvas.whole(table.laid_out(), 1)
        elif node.name == "tr" and self.tables:
            if self.tables[-1].plain:
                canvas.block(0)
            else:
                self.tables[-1].finish_row()
        elif node.name == "q":
            if node.visible:
                canvas.words('"')
        if node.margin >= 0:
            canvas.block(node.margin)
        if node.indent:
            canvas.indents.pop()
            canvas.bullet = ""

    def _void(self, node: Node) -> None:
        if node.seen and node.visible:
            if node.name == "br":
                self.canvases[-1].broken()
            elif node.name == "wbr":
                pass
            elif node.name == "hr":
                self.canvases[-1].whole(["---"], 1)

    def text(self, text: str) -> None:
        node = self.stack[-1]
        if node.name == "head" and not text.isspace():
            self._pop()
            node = self.stack[-1]
        if node.name == "details" and node.number == 1:
            return
        if (node.foreign == "svg" and not node.label) or node.picks is not None:
            return
        if node.seen and node.visible:
            text = unescape(text) if "&" in text else text
            if node.pre:
                self.canvases[-1].kept(text)
            elif node.name not in ("table", "tr", "tbody", "thead", "tfoot", "colgroup") or not text.isspace():
                self.canvases[-1].words(text)

    def finish(self) -> str:
        while len(self.stack) > 1:
            self._pop()
        return "\n".join(self.canvases[0].done())


def visible_text(html: str | None) -> str:
    """The text that a browser would show, laid out with blank lines, bullets and columns."""
    if not html:
        return ""
    page = _read(html, Page())
    if page.late:  # rules reach elements before them, too
        page = _read(html, Page(page.css))
    return page.finish()


def _read(html: str, page: Page) -> Page:
    at, n = 0, len(html)
    while at < n:
        low = html.find("<", at)
        if low < 0:
            page.text(html[at:])
            break
        m = TAG.match(html, low)
        if m is None:  # a bare <
            end = html.find("<", low + 1)
            end = n if end < 0 else end
            page.text(html[at:end])
            at = end
            continue
        if low > at:
            page.text(html[at:low])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            page.close(name)
            continue
        page.open(name, m["rest"])
        if name in RAW and page.stack[-1].name == name:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            body = html[at:stop]
            if name == "style":
                page.stylesheet(body)
            elif page.stack[-1].seen:
                page.text(body[1:] if name == "textarea" and body.startswith("\n") else body)
            at = stop
            if not end:
                page.close(name)
        elif name == "pre" and html.startswith("\n", at):
            at += 1
    return page


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text), a row for each row of pages(page_id, html).

    Null and empty html give an empty text. Unclosed and misnested tags are repaired as a browser would
    do in the common cases; a tag that never ends is dropped with what is in it. Pages are read whole.
    Cells wider than PAD characters shift what follows them in their row out of line; indents beyond
    INDENTS levels are not shown; a table inside of TABLES others, and a column from the COLUMNS-th on, is not aligned. So a
    text is not much longer than its page, and time grows with the page, whatever it holds.
    """

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "html"):
            texts = [visible_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    source = pages.select("page_id", F.col("html").cast("string").alias("html"))
    return source.mapInArrow(rendered, f"page_id {source.schema['page_id'].dataType.simpleString()}, text string")
