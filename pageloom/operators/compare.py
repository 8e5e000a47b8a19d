"""Likeness of two texts by their lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHOWN = 20
KIND = T.StructType(
    [T.StructField("similarity", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("lcs", "left_lines", "right_lines")], T.StructField("diffs", T.ArrayType(T.StringType()))]
)


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def common_lines(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    places: dict[str, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for line in b:
        met = row & places.get(line, 0)
        row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


def compared(left: str, right: str) -> dict:
    """Twice the common lines over all lines; the first differing lines by place, and a note on the lengths."""
    a, b = lines_of(left), lines_of(right)
    lcs = common_lines(a, b)
    diffs = []
    for i in range(max(len(a), len(b))):
        x, y = (t[i] if i < len(t) else "<EOF>" for t in (a, b))
        if x != y and len(diffs) < SHOWN:
            diffs.append(f"{i + 1}: {x or '<EMPTY>'} | {y or '<EMPTY>'}")
    if len(a) != len(b):
        diffs.append(f"lines: {len(a)} | {len(b)}")
    return {"similarity": 2 * lcs / (len(a) + len(b)), "lcs": lcs, "left_lines": len(a), "right_lines": len(b), "diffs": diffs}


@F.pandas_udf(KIND)
def _compare(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compared(a or "", b or "") for a, b in zip(left, right, strict=True)], columns=["similarity", "lcs", "left_lines", "right_lines", "diffs"])


def compare(left: Column, right: Column) -> Column:
    return _compare(left, right)
