"""Table markup in cell tokens, and its HTML.

A token row is a list of cells: <fcel> and <ecel> begin one, <lcel> belongs to the cell on its left, <ucel> to the one
above, <xcel> to both. Tables stay grids of cells as long as possible; HTML is written last."""

from __future__ import annotations

import html as html_module
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = ("<nl>", "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>")
_SPLIT = re.compile("(" + "|".join(TOKENS) + ")")


def escaped(text: str) -> str:
    return html_module.escape(text, quote=True).replace("&#x27;", "&#39;")


@dataclass
class Cell:
    row: int
    column: int
    text: str
    rows: int = 1
    columns: int = 1


def parsed(markup: str) -> tuple[list[Cell], int, int]:
    """Cells, rows and columns. Texts belong to the token before them as long as the tokens come in step with the rows:
    text before the first token, or an empty row, puts them out of step for good."""
    parts = [p for p in _SPLIT.split(markup) if p.strip()]
    rows: list[list[str]] = [[]]
    for part in parts:
        if part == "<nl>":
            if rows[-1]:
                rows.append([])
        elif part in TOKENS:
            rows[-1].append(part)
    rows = [r for r in rows if r]
    width = max(map(len, rows), default=0)
    texts: dict[tuple[int, int], str] = {}
    at = 0
    for r, row in enumerate(rows):
        row += ["<ecel>"] * (width - len(row))
        for c, token in enumerate(row):
            if at < len(parts) and parts[at] == token:
                at += 1
                if at < len(parts) and parts[at] not in TOKENS:
                    texts[r, c] = parts[at]
                    at += 1
        if at < len(parts) and parts[at] == "<nl>":
            at += 1
    cells = []
    for r, row in enumerate(rows):
        for c, token in enumerate(row):
            if token not in ("<fcel>", "<ecel>"):
                continue
            cell = Cell(r, c, texts.get((r, c), "").strip() if token == "<fcel>" else "")
            follows = c + 1 < width and not (token == "<ecel>" and (r, c) in texts)
            while follows and c + cell.columns < width and row[c + cell.columns] in ("<lcel>", "<xcel>"):
                cell.columns += 1
            while r + cell.rows < len(rows) and rows[r + cell.rows][c] in ("<ucel>", "<xcel>"):
                cell.rows += 1
            cells.append(cell)
    return cells, len(rows), width


def written(cells: list[Cell], rows: int, columns: int) -> str:
    if not cells:
        return ""
    owner: dict[tuple[int, int], Cell] = {}
    for cell in cells:
        for r in range(cell.row, min(rows, cell.row + cell.rows)):
            for c in range(cell.column, min(columns, cell.column + cell.columns)):
                owner[r, c] = cell
    out = []
    for r in range(rows):
        out.append("<tr>")
        for c in range(columns):
            cell = owner.get((r, c))
            if cell is None:
                out.append("<td></td>")
            elif (cell.row, cell.column) == (r, c):
                spans = (f' rowspan="{cell.rows}"' if cell.rows > 1 else "") + (f' colspan="{cell.columns}"' if cell.columns > 1 else "")
                out.append(f"<td{spans}>{escaped(cell.text.strip())}</td>")
        out.append("</tr>")
    return f"<table>{''.join(out)}</table>"


def to_html(markup: str) -> str:
    return markup if markup.startswith("<table") and markup.endswith("</table>") else written(*parsed(markup))


def table_html(text: str) -> str:
    """HTML of a table's text: cell tokens, ready HTML, or lines with cells between pipes."""
    if "<fcel>" in text or "<ecel>" in text:
        return "\n\n".join(to_html(p) if "<fcel>" in p or "<ecel>" in p else p for p in text.split("\n\n"))
    bare = text.strip()
    if bare.startswith("<table") and bare.endswith("</table>"):
        return bare
    if any(t in bare for t in ("<lcel>", "<ucel>", "<xcel>", "<nl>")):
        rows = ["".join(f"<td>{escaped(_SPLIT.sub('', row).strip())}</td>") for row in bare.replace("\r", "").split("<nl>") if _SPLIT.sub("", row).strip()]
        if rows:
            return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"
    lines = ["".join(f"    <td>{c.strip()}</td>\n" for c in line.split("|") if c.strip()) for line in bare.split("\n")]
    return "<table>\n" + "".join(f"  <tr>\n{line}  </tr>\n" for line in lines) + "</table>"


@F.pandas_udf(T.StringType())
def table_html_udf(texts: pd.Series) -> pd.Series:
    return texts.map(table_html, na_action="ignore")


class _Reader(HTMLParser):
    """Rows of (tag, attributes, inner markup) of a table's source; nested tables stay inside their cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.rows: list[list[list]] = []
        self.depth = 0
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.cell is not None and (self.depth > 1 or tag not in ("td", "th", "tr", "tbody", "thead", "tfoot")):
            self.depth += tag == "table"
            self.cell[2] += self.get_starttag_text() or ""
            return
        if tag == "table":
            self.depth += 1
        elif tag == "tr":
            self.cell = None
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.cell = [tag, dict(attrs), ""]
            self.rows[-1].append(self.cell)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if self.cell is not None:
            self.cell[2] += self.get_starttag_text() or ""

    def handle_endtag(self, tag: str) -> None:
        if self.depth > 1 and self.cell is not None:
            self.depth -= tag == "table"
            self.cell[2] += f"</{tag}>"
        elif tag == "table":
            self.depth -= 1
            self.cell = None
        elif tag in ("td", "th", "tr"):
            self.cell = None
        elif self.cell is not None and tag not in ("tbody", "thead", "tfoot"):
            self.cell[2] += f"</{tag}>"

    def _text(self, text: str) -> None:
        if self.cell is not None:
            self.cell[2] += text

    handle_data = _text

    def handle_entityref(self, name: str) -> None:
        self._text(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._text(f"&#{name};")


def read_rows(source: str) -> list[list[list]]:
    reader = _Reader()
    reader.feed(source)
    reader.close()
    return reader.rows


def write_rows(rows: list[list[list]]) -> str:
    """The canonical source of a table: double quotes, no white space between the tags."""
    cells = lambda row: "".join(f"<{tag}{''.join(f' {k}=\"{v if v is not None else ''}\"' for k, v in own.items())}>{inner}</{tag}>" for tag, own, inner in row)
    return "<table>" + "".join(f"<tr>{cells(row)}</tr>" for row in rows) + "</table>"
