"""Layout-aware rendering of HTML to its visible text.

A tree builder follows the open elements, ends those that HTML implies (a new
paragraph, list item, row or cell ends the one before) and ignores end tags
without a start inside the cell, caption or object that they stand in.
Visibility rules drop what a browser wouldn't show: scripts, styles,
templates, closed dialogs, ``hidden`` and ``aria-hidden`` elements, and styles
of ``display: none`` or ``visibility: hidden``, inline or by a rule of an
earlier ``style`` element whose selector names one element by tag, classes and
id. All other text is emitted: white space collapses outside ``pre``, blocks
keep their spacing, list items their bullets, numbers and depth, and table
cells line up in columns, with ``colspan`` and ``rowspan``. A cell of more than
``ALIGN`` characters is emitted whole but doesn't widen its columns, so that
the padding of a table grows with its cells alone.

The builder and the renderer are one pass over the tags without recursion, so
that depth costs no stack; open elements are found by their positions, not by
a walk. Attributes count only where they hide or span.

Defined results. A null or empty page has empty text, a null title and zero
counts. Text without tags is one block. An unfinished tag or comment at the
end is dropped. Repeated rows are rendered each; other input columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.DOTALL
)
MAY_HIDE = re.compile("hidden|style", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']\S*)))?""")
#: An end of attributes whose slash belongs to an unquoted value.
VALUE_SLASH = re.compile(r"""=\s*[^\s"'>]+/\Z""")
BLANK = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template noembed noframes iframe head datalist audio video canvas noscript".split())
#: What SVG and MathML don't draw; SVG draws character data in these only.
UNDRAWN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask marker pattern".split()),
    "math": frozenset(["annotation", "annotation-xml"]),
}
SVG_TEXT = ("text", "foreignobject")
IN_HEAD = frozenset("title meta style script link base template noscript basefont bgsound".split())
#: Block elements: with a blank line around them, and with a line break only.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BROKEN = frozenset(
    "div section article header footer nav aside main address form li dt dd tr caption figcaption details summary "
    "body html legend option hgroup search menu center thead tbody tfoot dialog".split()
)
ENDS_PARAGRAPH = (SPACED | BROKEN) - frozenset("tr caption thead tbody tfoot option body html legend".split())
#: Element -> (elements it ends, elements that stop the search).
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
PARAGRAPH = (frozenset(["p"]), frozenset(["td", "th", "table", "button", "caption"]))
#: End tags of these find their start up to the table, others up to a bound.
IN_TABLE = frozenset("tr td th thead tbody tfoot caption".split())
BOUNDS = frozenset("table td th caption object template".split())
CELL_GAP = "  "
#: Characters of a cell that widens its columns, and the spans that HTML allows.
ALIGN, MOST_COLUMNS, MOST_ROWS = 200, 1000, 65534
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.IGNORECASE)
BRACE = re.compile(r"[{};]")

Declaration = tuple[str, bool, str]


def attributes_of(attributes: str) -> dict[str, str]:
    """Values by lower-case name; the first of a repeated name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or "").strip())
    return found


def declarations(style: str) -> list[Declaration]:
    """(name, whether important, value) of what decides visibility."""
    found = []
    for part in COMMENT.sub("", style).lower().split(";"):
        name, _, value = (x.strip() for x in part.partition(":"))
        if name in ("display", "visibility"):
            strong = value.endswith("!important")
            found.append((name, strong, value.removesuffix("!important").strip()))
    return found


class Sheet:
    """Rules that decide visibility, found by one part of their selector."""

    def __init__(self):
        self.rules: dict[str, list[tuple[tuple, str, frozenset, list[Declaration]]]] = {}
        self.n = 0

    def read(self, css: str) -> None:
        """Top-level rules; blocks of at-rules, such as ``@media``, don't count."""
        css, at, depth, start = COMMENT.sub("", css), 0, 0, 0
        head = ""
        for m in BRACE.finditer(css):
            if m[0] == "{":
                if depth == 0:
                    head, start = css[at : m.start()].strip(), m.end()
                depth += 1
            elif m[0] == "}":
                depth = max(0, depth - 1)
                if depth == 0:
                    if head and head[0] != "@":
                        self._add(head, declarations(css[start : m.start()]))
                    head, at = "", m.end()
            elif depth == 0:
                at = m.end()

    def _add(self, head: str, said: list[Declaration]) -> None:
        for one in head.split(",") if said else ():
            m = SELECTOR.fullmatch(one.strip())
            if not m or not m[0]:
                continue
            tag, parts = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
            self.n += 1
            rank = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), tag != "*", self.n)
            self.rules.setdefault(parts[0] if parts else tag, []).append((rank, tag, frozenset(parts), said))

    def said(self, tag: str, found: dict[str, str]) -> list[Declaration]:
        """Declarations for an element, the weakest first."""
        own = {f".{x}" for x in found.get("class", "").split()} | ({f"#{found['id']}"} if found.get("id") else set())
        met = [r for key in (*own, tag, "*") for r in self.rules.get(key, ()) if r[1] in ("*", tag) and r[2] <= own]
        return [x for r in sorted(met, key=lambda r: r[0]) for x in r[3]]


def hidden_by(tag: str, attributes: str, sheet: Sheet) -> bool:
    """Whether attributes, inline style or a rule hides an element."""
    if not (sheet.rules or tag == "dialog" or MAY_HIDE.search(attributes)):
        return False
    found = attributes_of(attributes)
    if found.get("hidden", "until-found").lower() != "until-found" or found.get("aria-hidden", "").lower() == "true":
        return True
    style: dict[str, tuple[bool, str]] = {"display": (False, "none")} if tag == "dialog" and "open" not in found else {}
    for name, strong, value in sheet.said(tag, found) + declarations(found.get("style", "")):
        if strong or not style.get(name, (False, ""))[0]:
            style[name] = (strong, value)
    return style.get("display", (False, ""))[1] == "none" or style.get("visibility", (False, ""))[1] == "hidden"


def spans_of(attributes: str) -> tuple[int, int]:
    """(columns, rows) that a cell covers; 0 rows: all that follow."""
    if "span" not in attributes.lower():
        return 1, 1
    found = attributes_of(attributes)
    columns, rows = (re.match(r"\+?([0-9]{1,9})", found.get(x, "")) for x in ("colspan", "rowspan"))
    across = int(columns[1]) if columns else 1
    return min(across, MOST_COLUMNS) or 1, min(int(rows[1]), MOST_ROWS) if rows else 1


class Flow:
    """Lines of text with collapsed white space and block margins."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.margin = 0
        self.lead = ""
        self.indent = ""
        self.blocks = 0
        self.fresh = True

    def put(self, text: str, keep: bool = False) -> None:
        if keep:
            for i, line in enumerate(text.split("\n")):
                if i:
                    self.cut(1)
                    self.end_line()
                if line:
                    self._begin()
                    self.now.append(line)
            return
        words = BLANK.sub(" ", text)
        if words == " ":
            self.space = self.space or bool(self.now)
            return
        if not words:
            return
        self._begin()
        if self.now and (self.space or words[0] == " "):
            self.now.append(" ")
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def _begin(self) -> None:
        if self.now:
            return
        if self.lines and self.margin > 1 and self.lines[-1]:
            self.lines.append("")
        self.margin, self.space = 0, False
        if self.fresh:
            self.blocks += 1
            self.fresh = False
        self.now.append(self.indent + self.lead)
        if self.lead:
            self.lead = ""

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def cut(self, margin: int) -> None:
        self.end_line()
        self.margin = max(self.margin, margin)

    def block(self, margin: int) -> None:
        self.cut(margin)
        self.fresh = True

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


class Table:
    def __init__(self, outer: Flow):
        self.outer = outer
        #: Rows of (text, columns, rows) of each cell.
        self.rows: list[list[tuple[str, int, int]]] = []
        self.spans: list[tuple[int, int]] = []

    def _placed(self) -> list[list[tuple[int, int, str]]]:
        """(first column, columns, text) of the cells of each row."""
        placed, busy = [], []
        for i, row in enumerate(self.rows):
            # columns that cells of earlier rows still cover, in order
            busy = [x for x in busy if x[2] > i]
            out, new, at, b = [], [], 0, 0
            for text, columns, rows in row:
                while b < len(busy) and busy[b][0] <= at:
                    at, b = max(at, busy[b][1]), b + 1
                out.append((at, columns, text))
                until = i + rows if rows else len(self.rows)
                if until > i + 1:
                    new.append((at, at + columns, min(until, len(self.rows))))
                at += columns
            busy = sorted(busy + new) if new else busy
            placed.append(out)
        return placed

    def lines(self) -> list[str]:
        placed = [row for row in self._placed() if any(text for _, _, text in row)]
        # columns in which no cell starts take no room
        starts = sorted({at for row in placed for at, _, _ in row})
        name = {at: c for c, at in enumerate(starts)}
        width = [0] * len(starts)
        wide = []
        for row in placed:
            for at, columns, text in row:
                c, last = name[at], bisect_right(starts, at + columns - 1) - 1
                if len(text) > ALIGN:
                    continue
                if c == last:
                    width[c] = max(width[c], len(text))
                else:
                    wide.append((c, last, len(text)))
        for c, last, need in sorted(set(wide), key=lambda x: (x[1] - x[0], x)):
            room = sum(width[c : last + 1]) + len(CELL_GAP) * (last - c)
            width[last] += max(0, need - room)
        left = [0]
        for w in width:
            left.append(left[-1] + w + len(CELL_GAP))
        lines = []
        for row in placed:
            line, used = [], 0
            for at, _, text in row:
                gap = max(left[name[at]] - used, len(CELL_GAP) if line else 0)
                line.append(" " * gap + text)
                used += gap + len(text)
            lines.append("".join(line).rstrip())
        return lines


class Page:
    """One pass over a page: open elements, visibility and layout."""

    def __init__(self):
        self.flow = Flow()
        self.stack: list[tuple[str, bool]] = []
        #: Positions in the stack of the open elements of a name, and of bounds.
        self.open: dict[str, list[int]] = {}
        self.bounds: list[int] = []
        self.sheet = Sheet()
        self.hidden = 0
        self.pre = 0
        self.tables: list[Table] = []
        self.cells = 0
        self.lists: list[list] = []
        self.title: str | None = None
        self.n_tables = self.n_items = 0

    # elements

    def start(self, tag: str, attributes: str) -> None:
        if tag in IMPLIED:
            self._imply(*IMPLIED[tag])
        if tag in ENDS_PARAGRAPH and self.open.get("p"):
            self._imply(*PARAGRAPH)
        hides = tag in UNSEEN or hidden_by(tag, attributes, self.sheet)
        hides = hides or any(self.open.get(x) and tag in names for x, names in UNDRAWN.items())
        if self.open.get("head") and tag not in IN_HEAD:
            self.end("head")
        if tag in VOID:
            if not hides and not self.hidden:
                if tag == "br":
                    self.flow.cut(1)
                elif tag == "hr":
                    self.flow.block(2)
            return
        if (tag in UNDRAWN or self.foreign()) and attributes.endswith("/") and not VALUE_SLASH.search(attributes):
            return
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BOUNDS:
            self.bounds.append(len(self.stack))
        self.stack.append((tag, hides))
        self.hidden += hides
        if not self.hidden:
            self._layout(tag, attributes)

    def foreign(self) -> bool:
        """Inside SVG or MathML, where a slash closes an element."""
        return bool(self.open.get("math") or (self.open.get("svg") and not self.open.get("foreignobject")))

    def _layout(self, tag: str, attributes: str) -> None:
        flow = self.flow
        if tag == "text" and self.open.get("svg"):
            flow.put(" ")
        if tag == "table":
            flow.block(2)
            self.tables.append(Table(flow))
            self.n_tables += 1
            return
        if tag in ("td", "th") and self.tables:
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].spans.append(spans_of(attributes))
            self.flow = Flow()
            return
        if tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
            return
        if tag in SPACED:
            flow.block(1 if tag in ("ul", "ol") and self.lists else 2)
        elif tag in BROKEN:
            flow.block(1)
        if tag in ("ul", "ol", "menu"):
            self.lists.append([tag, 0, flow.indent])
            flow.indent = "  " * (len(self.lists) - 1)
        elif tag == "li":
            self.n_items += 1
            if self.lists:
                self.lists[-1][1] += 1
                flow.indent = "  " * (len(self.lists) - 1)
                flow.lead = f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- "
            else:
                flow.lead = "- "
        elif tag == "pre":
            self.pre += 1

    def end(self, tag: str) -> None:
        places = self.open.get(tag)
        if not places:
            return
        if tag in IN_TABLE:
            floor = (self.open.get("table") or [-1])[-1]
        else:
            floor = -1 if tag in ("table", "template") or not self.bounds else self.bounds[-1] - (tag == "object")
        if places[-1] > floor:
            self._close(places[-1])

    def _close(self, place: int) -> None:
        while len(self.stack) > place:
            self._pop()

    def _imply(self, ended: frozenset, stops: frozenset) -> None:
        """Ends the outermost of ``ended`` above the nearest of ``stops``."""
        floor = max((self.open[x][-1] for x in stops if self.open.get(x)), default=-1)
        found = []
        for x in ended:
            places = self.open.get(x, [])
            i = bisect_right(places, floor)
            if i < len(places):
                found.append(places[i])
        if found:
            self._close(min(found))

    def _pop(self) -> None:
        tag, hides = self.stack.pop()
        self.open[tag].pop()
        if tag in BOUNDS:
            self.bounds.pop()
        if self.hidden:
            self.hidden -= hides
            return
        if tag == "table" and self.tables:
            table = self.tables.pop()
            self.flow = table.outer
            for line in table.lines():
                self.flow.cut(1)
                self.flow.put(line, keep=True)
            self.flow.block(2)
            return
        if tag in ("td", "th") and self.tables:
            text = " ".join(x for x in self.flow.text().split("\n") if x).strip()
            self.tables[-1].rows[-1].append((text, *self.tables[-1].spans.pop()))
            self.flow = self.tables[-1].outer
            return
        if tag == "tr" and self.tables:
            return
        if tag in ("ul", "ol", "menu") and self.lists:
            self.flow.indent = self.lists.pop()[2]
        elif tag == "li":
            self.flow.lead = ""
        elif tag == "pre" and self.pre:
            self.pre -= 1
        if tag in SPACED:
            self.flow.block(1 if tag in ("ul", "ol") and self.lists else 2)
        elif tag in BROKEN:
            self.flow.block(1)

    def text(self, raw: str) -> None:
        if self.open.get("svg") and not any(self.open.get(x) for x in SVG_TEXT):
            return
        if not self.hidden and raw:
            # text between cells, which a browser moves out, goes before the table
            flow = self.flow
            flow.put(unescape(raw) if "&" in raw else raw, keep=bool(self.pre))


def render(html: str) -> dict:
    """title, text and counts of a page."""
    page, at = Page(), 0
    while found := TAG.search(html, at):
        if found.start() > at:
            page.text(html[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            page.end(tag)
            continue
        applies = tag == "style" and not (page.open.get("noscript") or page.open.get("template"))
        page.start(tag, found[3])
        if tag in RAW and not found[3].endswith("/") and not (tag == "title" and page.foreign()):
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            body = html[at : close.start() if close else len(html)]
            at = close.start() if close else len(html)
            if tag == "title":
                if page.title is None:
                    page.title = BLANK.sub(" ", unescape(body)).strip()
            elif applies and attributes_of(found[3]).get("media", "all").lower() in ("all", "screen", ""):
                page.sheet.read(body)
            elif tag == "textarea":
                page.text(body)
    rest = html[at:]
    cut = rest.find("<")
    while cut >= 0 and not re.match(r"<[A-Za-z/!?]", rest[cut:]):
        cut = rest.find("<", cut + 1)
    page.text(rest if cut < 0 else rest[:cut])
    while page.stack:
        page._pop()
    return {
        "title": page.title,
        "text": page.flow.text().strip("\n"),
        "n_blocks": page.flow.blocks,
        "n_tables": page.n_tables,
        "n_items": page.n_items,
    }


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [render(value.as_py() or "") for value in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([x["title"] for x in done], type=pa.string()),
                pa.array([x["text"] for x in done], type=pa.string()),
                *(pa.array([x[k] for x in done], type=pa.int64()) for k in ("n_blocks", "n_tables", "n_items")),
            ],
            names=["page_id", "url", "title", "text", "n_blocks", "n_tables", "n_items"],
        )


def extract_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, n_blocks, n_tables, n_items) for each row."""
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return plain.mapInArrow(
        _extract, "page_id long, url string, title string, text string, n_blocks long, n_tables long, n_items long"
    )
