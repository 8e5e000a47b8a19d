"""Tables that go on over pages: a table that ends a page and one that begins the next become one, from the last page to
the first, so that a merged table can merge again. Only the tables at the edges of pages travel, a document at a time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.otsl import read_rows, write_rows
from ..functions.text import NARROW, WIDE

# What a caption of a continued table ends with.
CONTINUED = ("(续)", "(续表)", "(续上表)", "(continued)", "(cont.)", "(cont’d)")
MOST_HEADER_ROWS, WIDTH_TOLERANCE = 5, 0.1
_HALF = str.maketrans(WIDE, NARROW)
Rows = list[list[list]]


def _span(cell: list, name: str) -> int:
    m = re.match(r"\s*([+-]?\d+)", cell[1].get(name) or "")
    return int(m[1]) if m else 1


def _text(cell: list) -> str:
    return re.sub(r"<[^>]*>", "", cell[2]).translate(_HALF)


def row_width(row: list[list]) -> int:
    return sum(_span(c, "colspan") for c in row)


def table_width(rows: Rows) -> int:
    """Columns of the grid that the cells take."""
    taken: dict[int, set[int]] = {}
    most = 0
    for r, row in enumerate(rows):
        at = 0
        for cell in row:
            while at in taken.get(r, ()):
                at += 1
            across, down = _span(cell, "colspan"), _span(cell, "rowspan")
            for k in range(r, min(r + down, len(rows))):
                taken.setdefault(k, set()).update(range(at, at + across))
            at += across
            most = max(most, at)
    return most


def header_rows(a: Rows, b: Rows) -> int:
    """How many first rows are the same in both."""
    shape = lambda row: [(_span(c, "colspan"), _span(c, "rowspan"), "".join(_text(c).split())) for c in row]
    n = 0
    for x, y in zip(a[:MOST_HEADER_ROWS], b[:MOST_HEADER_ROWS], strict=False):
        if shape(x) != shape(y):
            break
        n += 1
    return n


def edges_match(a: Rows, b: Rows) -> bool:
    last = next((row for row in reversed(a) if row), None)
    n = header_rows(a, b)
    if last is None or len(b) <= n:
        return False
    return row_width(last) == row_width(b[n]) or len(last) == len(b[n])


def widen(rows: Rows, like: list[list], target: int, now: int) -> None:
    """Rows that are too narrow: their last cell grows, unless they have the shape of the row they should be like."""
    spans = [_span(c, "colspan") for c in like]
    for row in rows:
        if not row or row_width(row) >= target or [_span(c, "colspan") for c in row] == spans:
            continue
        row[-1][1]["colspan"] = str(_span(row[-1], "colspan") + target - now)


def merged(a: Rows, b: Rows) -> Rows:
    """a with the rows of b after the header that both have."""
    n = header_rows(a, b)
    if a and n < len(b):
        wide_a, wide_b = table_width(a), table_width(b)
        if wide_a >= wide_b:
            widen(b[n:], a[-1], wide_a, wide_b)
        else:
            widen(a, b[n], wide_b, wide_a)
    return a + b[n:]


@dataclass
class Table:
    page: int
    first: bool  # opens its page
    last: bool  # ends its page
    x0: float
    x1: float
    html: str
    captions: list[str]
    footnotes: list[str]
    merged_into: int | None = None
    crossed: list[str] = field(default_factory=list)  # footnotes that came from later pages


def may_merge(now: Table, before: Table) -> bool:
    if now.captions and not any(c.translate(_HALF).strip().lower().endswith(CONTINUED) for c in now.captions):
        return False
    if before.footnotes or not now.html or not before.html:
        return False
    a, b = now.x1 - now.x0, before.x1 - before.x0
    if not min(a, b) > 0 or abs(a - b) / min(a, b) >= WIDTH_TOLERANCE:
        return False
    x, y = read_rows(before.html), read_rows(now.html)
    return table_width(x) == table_width(y) or edges_match(x, y)


def merge_document(tables: list[Table]) -> list[Table]:
    """Folds from the last page to the first. A merged table keeps its place, without content."""
    opens = {t.page: t for t in tables if t.first}
    ends = {t.page: t for t in tables if t.last}
    for page in sorted(opens, reverse=True):
        now, before = opens[page], ends.get(page - 1)
        if before is None or not may_merge(now, before):
            continue
        before.html = write_rows(merged(read_rows(before.html), read_rows(now.html)))
        before.crossed += now.footnotes + now.crossed
        now.merged_into, now.html = before.page, ""
    return tables


SCHEMA = "page_idx long, is_first boolean, is_last boolean, html string, merged_into long, crossed_footnotes array<string>"


def merge_tables(edges: DataFrame) -> DataFrame:
    """edges: doc_id, page_idx, is_first, is_last, x0, x1, html, captions, footnotes of the tables at the edges of pages.
    doc_id, page_idx, is_first, is_last, html, merged_into (a page), crossed_footnotes."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page_idx", "is_first"], ascending=[True, False])
        tables = [Table(int(r.page_idx), bool(r.is_first), bool(r.is_last), r.x0, r.x1, r.html or "", list(r.captions), list(r.footnotes)) for r in rows.itertuples()]
        merge_document(tables)
        out = rows[["doc_id", "page_idx", "is_first", "is_last"]].copy()
        out["html"] = [t.html for t in tables]
        out["merged_into"] = pd.array([t.merged_into for t in tables], "Int64")
        out["crossed_footnotes"] = [t.crossed for t in tables]
        return out

    wanted = edges.filter("is_first OR is_last").select("doc_id", "page_idx", "is_first", "is_last", F.col("x0").cast("double"), F.col("x1").cast("double"), "html", "captions", "footnotes")
    return wanted.groupBy("doc_id").applyInPandas(fold, f"doc_id {dict(edges.dtypes)['doc_id']}, {SCHEMA}")
