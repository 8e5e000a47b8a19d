"""HTML extraction by layout-aware rendering.

A tree builder makes elements of the tags: those that a start tag implies the end of are closed, void ones never opened,
end tags without a start ignored, and what is open at the end closed there. Elements that are not displayed (scripts,
styles, the head, templates, closed details but for their summary, the hidden attribute, display: none and the like) give
no text, nor do those with visibility: hidden, but what is visible again inside of them does; formulas and labels of
drawings do, but not what only describes or defines them. The renderer
emits all other text: runs of white space become one space, paragraphs and headings stand apart by an empty line, other
blocks on lines of their own, list items behind their marks and indented, preformatted text as it is, and the cells of
each table column aligned, by MOST_SPACES spaces a cell at most.

Null pages count as empty and have empty text. Pages are parsed whole without recursion; a page that is no HTML is text.
A stray "<" is text. Repeated rows give repeated rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

#: A quote opens a quoted value after an equals sign, and is a character like others anywhere else.
VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s<>]++)"
TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/<>]*+)((?:[\s/=]++|[^\s/=<>]++(?:{VALUE})?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
VISIBILITY = re.compile(r"(?<![-\w])visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: Spaces that align a cell, at most, so that no text is much longer than its page.
MOST_SPACES = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = frozenset("script style head title template iframe noembed noframes object audio video canvas datalist".split())
#: Inside of math and svg: what is not shown, and what holds HTML.
FOREIGN_NO_TEXT = frozenset("annotation annotation-xml metadata defs title desc".split())
HTML_INSIDE = frozenset("foreignobject annotation-xml title desc mi mo mn ms mtext".split())
#: HTML that math and svg end at.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = APART | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr caption".split())
ENDS_P = APART | frozenset("address article aside center details dialog dir div dd dt fieldset figcaption footer form header hgroup li main menu nav search section summary".split())
#: What a start tag closes, if it is open inside the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An end tag reaches no element outside of these.
SCOPE = frozenset(("table", "td", "th", "caption", "template", "html"))


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


class Flow:
    """Text of a box as lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a collapsed space stands before the next word
        self.gap = 0  # empty lines due before the next text

    def word(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self._put(first)
            for more in rest:
                self.end()
                self.lines.append("")
                self.line = []
                self.lines.pop()
                self._put(more, True)
            return
        parts = SPACE.split(text)
        if parts and parts[0] == "" and len(text):
            self.space = True
        for i, part in enumerate(p for p in parts if p):
            if i:
                self.space = True
            self._put(part)
        if len(parts) > 1 and parts[-1] == "":
            self.space = True

    def _put(self, text: str, fresh: bool = False) -> None:
        if self.gap and self.lines and (text or fresh):
            self.lines.extend([""] * self.gap)
        if text or fresh:
            self.gap = 0
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        if text or fresh:
            self.line.append(text)

    def end(self) -> None:
        """The line, if it has begun."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def apart(self) -> None:
        self.end()
        if self.lines:
            self.gap = max(self.gap, 1)

    def broken(self) -> None:
        """A line break: an empty line counts."""
        if self.line:
            self.end()
        elif self.lines and not self.gap:
            self.lines.append("")

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines

    def take(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Lines of an inner box."""
        self.end()
        if lines:
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.append((first + lines[0]).rstrip(" "))
            self.lines.extend((rest + x).rstrip(" ") for x in lines[1:])


def joined(busy: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbours that are free again at the same row as one."""
    out: list[tuple[int, int, int]] = []
    for b in busy:
        if out and out[-1][1:] == (b[0], b[2]):
            out[-1] = (out[-1][0], b[1], b[2])
        else:
            out.append(b)
    return out


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.caption: list[str] = []
        self.groups: list[int] = []  # rows at which groups of rows begin or end

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.rows.append([])
        self.rows[-1].append((lines, across, down))

    def done(self) -> list[str]:
        """Cells on a grid, columns as wide as their widest one-column cell, two spaces apart."""
        busy: list[tuple[int, int, int]] = []  # columns from, to, and the row at which they are free again
        starts_of_groups = [*self.groups, len(self.rows)]
        placed: list[list[tuple[int, list[str], int]]] = []
        for r, row in enumerate(self.rows):
            at, out, k = 0, [], 0
            busy = [b for b in busy if b[2] > r]
            new: list[tuple[int, int, int]] = []
            for lines, across, down in row:
                while k < len(busy) and busy[k][0] <= at:
                    at = max(at, busy[k][1])
                    k += 1
                end = r + down if down else starts_of_groups[bisect_right(starts_of_groups, r)]
                if new and new[-1][1:] == (at, end):
                    new[-1] = (new[-1][0], at + across, end)
                else:
                    new.append((at, at + across, end))
                out.append((at, lines, across))
                at += across
            if spanning := [b for b in new if b[2] > r + 1]:
                busy = joined(sorted(busy + spanning))
            placed.append(out)
        widths: dict[int, int] = {}
        for row in placed:
            for at, lines, across in row:
                if across == 1:
                    widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
        columns = sorted(c for c, width in widths.items() if width)
        starts = [0, *accumulate(widths[c] + 2 for c in columns)]
        out = list(self.caption)
        for row in placed:
            for k in range(max((len(lines) for _, lines, _ in row), default=0)):
                line = ""
                for at, lines, _ in row:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(min(starts[bisect_left(columns, at)], len(line) + MOST_SPACES))
                        line += ("  " if line and line[-1:] != " " else "") + lines[k]
                out.append(line.rstrip(" "))
        return out


class Element:
    __slots__ = ("attributes", "count", "flow", "foreign", "hidden", "keep", "name", "table", "unseen")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.name, self.attributes = name, attributes
        self.hidden = bool(parent and parent.hidden) or name in NO_TEXT or "hidden" in attributes or bool(NOT_SHOWN.search(attributes.get("style", "")))
        seen = VISIBILITY.search(attributes.get("style", ""))
        self.unseen = seen[1].lower() != "visible" if seen else bool(parent and parent.unseen)  # what is inside may be seen again
        self.hidden |= bool(parent and parent.closed and name != "summary")
        within = bool(parent and parent.foreign)
        self.hidden |= within and name in FOREIGN_NO_TEXT
        self.foreign = name in ("svg", "math") or within and name not in HTML_INSIDE
        self.hidden |= name == "dialog" and "open" not in attributes
        self.keep = bool(parent and parent.keep and name not in ("td", "th")) or name in ("pre", "textarea", "xmp", "listing")
        self.flow = parent.flow if parent else Flow()
        self.table = parent.table if parent else None
        self.count = 0


    @property
    def closed(self) -> bool:
        """Whether it shows its summary alone."""
        return self.name == "details" and "open" not in self.attributes


def _number(text: str | None, least: int, most: int) -> int:
    try:
        return min(most, max(least, int(text or "")))
    except ValueError:
        return least


def _rows_down(text: str | None) -> int:
    """0 stands for the rest of the group."""
    digits = re.match(r"[ \t\n\r\f]*\+?([0-9]+)", text or "")
    return min(65534, int(digits[1].lstrip("0")[:6] or 0)) if digits else 1


class Builder:
    """Elements from tags; boxes are rendered when they close."""

    def __init__(self) -> None:
        self.stack = [Element("#page", {}, None)]
        self.open: Counter[str] = Counter()  # names on the stack

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if top.hidden or top.unseen or top.closed:
            return
        if top.name in ("table", "tbody", "thead", "tfoot", "tr") and not text.strip():
            return
        top.flow.word(text, top.keep)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in ENDS_FOREIGN:
            while self.stack[-1].foreign:
                self.close(len(self.stack) - 1)
        closes, within = CLOSES.get(name, (None, None))
        if closes:
            self._close_inside(closes, within)
        if name in ENDS_P:
            self._close_inside({"p"}, SCOPE | {"button", "li", "blockquote", "div", "body"} if name != "p" else SCOPE | {"button"})
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.close(len(self.stack) - 1)
        if name in ("td", "th") and self.stack[-1].table is not None and not any(e.name == "tr" for e in self._inside_table()):
            self.start("tr", {})
        parent = self.stack[-1]
        flow = parent.flow
        if name in VOID:
            own = Element(name, attributes, parent)
            if own.hidden or own.unseen and name != "br":
                return
            if name == "br":
                flow.broken()
            elif name == "hr":
                flow.apart()
                flow.take(["---"])
                flow.apart()
            elif name == "input" and attributes.get("type", "").lower() in ("submit", "button", "reset") and attributes.get("value"):
                flow.word(attributes["value"], False)
            return
        element = Element(name, attributes, parent)
        self.stack.append(element)
        self.open[name] += 1
        if element.hidden:
            return
        if name == "text" and element.foreign:
            flow.space = True  # labels stand apart
        if name in ("tbody", "thead", "tfoot") and element.table is not None:
            element.table.groups.append(len(element.table.rows))
        if name in APART and not (name in ("ul", "ol") and self.open["li"]):
            flow.apart()
        elif name in BLOCK:
            flow.end()
        if name == "table":
            element.flow, element.table = Flow(), Table()
        elif name == "tr" and element.table is not None:
            element.table.rows.append([])
        elif name in ("td", "th", "caption", "li", "dd", "blockquote"):
            element.flow = Flow()
        if name == "li":
            owner = next((e for e in reversed(self.stack[:-1]) if e.name in ("ul", "ol", "menu", "dir")), None)
            if owner is not None:
                owner.count += 1
                if owner.name == "ol":
                    element.count = _number(owner.attributes.get("start") or "1", -(10**6), 10**6) + owner.count - 1
                    if "value" in attributes:
                        element.count = _number(attributes["value"], -(10**6), 10**6)
            element.attributes = {"mark": f"{element.count}. " if owner is not None and owner.name == "ol" else "- "}

    def _inside_table(self) -> list[Element]:
        at = max((i for i, e in enumerate(self.stack) if e.name == "table"), default=0)
        return self.stack[at:]

    def _close_inside(self, names: set[str], within: set[str]) -> None:
        found = None
        for i in range(len(self.stack) - 1, 0, -1) if any(self.open[n] for n in names) else ():
            name = self.stack[i].name
            if name in names:
                found = i
            elif name in within:
                break
        if found is not None:
            self.close(found)

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", {})
        if name == "p" and not self.open["p"]:
            self.start("p", {})
        if not self.open[name] and not (name in HEADINGS and any(self.open[h] for h in HEADINGS)):
            return None
        for i in range(len(self.stack) - 1, 0, -1):
            own = self.stack[i].name
            if own == name or own in HEADINGS and name in HEADINGS:
                return self.close(i)
            if own in SCOPE and name not in ("table", "tbody", "thead", "tfoot", "tr", "body", "html"):
                return None
            if own == "table":
                return None
        return None

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            e = self.stack.pop()
            self.open[e.name] -= 1
            if e.hidden:
                continue
            parent, name = self.stack[-1], e.name
            if name == "text" and e.foreign:
                parent.flow.space = True
            if name in ("tbody", "thead", "tfoot") and e.table is not None:
                e.table.groups.append(len(e.table.rows))
            if name == "table":
                loose = e.flow.done()  # text between the cells goes before the table
                parent.flow.take(loose)
                parent.flow.take(e.table.done())
            elif name in ("td", "th"):
                lines = e.flow.done()
                if e.table is not None:
                    e.table.cell(lines, _number(e.attributes.get("colspan"), 1, 1000), _rows_down(e.attributes.get("rowspan")))
                else:
                    parent.flow.take(lines)
            elif name == "caption":
                if e.table is not None:
                    e.table.caption.extend(e.flow.done())
                else:
                    parent.flow.take(e.flow.done())
            elif name == "li":
                mark = e.attributes["mark"]
                lines = e.flow.done()
                if lines or not e.unseen:
                    parent.flow.take(lines or [""], mark, " " * len(mark))
            elif name == "dd":
                parent.flow.take(e.flow.done(), "    ", "    ")
            elif name == "blockquote":
                parent.flow.take(e.flow.done(), "  ", "  ")
            if name in APART and not (name in ("ul", "ol") and self.open["li"]):
                parent.flow.apart()
            elif name in BLOCK:
                parent.flow.end()


def render(page: str) -> str:
    """The visible text of a page."""
    builder, at, n = Builder(), 0, len(page)
    page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            builder.text(html.unescape(page[at:]))
            break
        if m.start() > at:
            builder.text(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            builder.end(name)
            continue
        own = attributes(m[3]) if m[3] else {}
        foreign = name in ("svg", "math") or builder.stack[-1].foreign and name not in ENDS_FOREIGN
        builder.start(name, own)
        if foreign and m[3].endswith("/") and not UNQUOTED_SLASH.search(m[3]):
            if builder.stack[-1].name == name:
                builder.close(len(builder.stack) - 1)
            continue
        if name in RAW and builder.stack[-1].name == name:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            builder.text(page[at:stop] if name not in ("textarea", "title") else html.unescape(page[at:stop]))
            at = stop
    builder.close(1)
    return "\n".join(builder.stack[0].flow.done())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text of every row."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
