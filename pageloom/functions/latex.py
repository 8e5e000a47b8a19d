r"""Formula text. Simple rewrites are columns; those that need a stack run in Arrow batches, and only on rows that need it.

compat="reference" keeps the known quirks of the format's rewrites (a doubled backslash after a sized delimiter, a
doubled one in the added brackets), compat="fixed" writes what was meant."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trimmed

# The delimiter commands that \left and \right may stand before, and how they pair.
LEFT_COUNTED = (r"\lbrace", r"\lVert", r"\lvert", r"\rvert", r"\rVert", r"\vert", r"\Vert", r"\lfloor", r"\lbrack", r"\langle", "|", r"\|", "[", "]", "(", r"\{", r"\}", ".")
RIGHT_COUNTED = (r"\rbrace", r"\lVert", r"\lvert", r"\rvert", r"\rVert", r"\vert", r"\Vert", r"\rfloor", r"\rbrack", r"\rangle", "|", r"\|", "]", "[", ")", "}", "{", ".")
PAIRS = {r"\lbrace": r"\rbrace", r"\lVert": r"\lVert", r"\lvert": r"\lvert", r"\vert": r"\vert", r"\Vert": r"\Vert", r"\lfloor": r"\rfloor", r"\lbrack": r"\rbrack", r"\langle": r"\rangle", "|": "|", r"\|": r"\|", "[": "]", "]": "[", "(": ")", ")": "(", r"\{": r"\}", r"\}": r"\{", "/": "/"}
LEFT_ONLY, RIGHT_ONLY = (r"\rvert", r"\rVert"), (r"\rvert", r"\rVert")
SIZES = tuple(f"{b}{g}{side}" for b in ("big", "Big") for g in ("", "g") for side in ("", "r", "m", "l"))

_LEFT = re.compile("|".join(r"\\left" + re.escape(d) for d in LEFT_COUNTED))
_RIGHT = re.compile("|".join(r"\\right" + re.escape(d) for d in RIGHT_COUNTED))
_EITHER = re.compile(f"({_LEFT.pattern}|{_RIGHT.pattern})")
_CELLS = re.compile(r"(&|\\\\|\\begin\{array\}\s*\{[a-zA-Z\s]*\}|\\end\{array\})")
_LEFT_SQL, _RIGHT_SQL = ("|".join(rf"\\{side}" + re.sub(r"([\\|\[\](){}.])", r"\\\1", d) for d in known) for side, known in (("left", LEFT_COUNTED), ("right", RIGHT_COUNTED)))


def eq_colon(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(r"\eqqcolon"), F.lit("=:")), F.lit(r"\coloneqq"), F.lit(":="))


def less_than(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("< "))


def double_subscript(text: Column) -> Column:
    group = r"_\s*\{(?:[^{}]|\{[^{}]*\})*\}"
    return F.regexp_replace(text, rf"{group}\s*{group}", "")


def sized_delimiters(text: Column, compat: str = "reference") -> Column:
    r"""\big{)} and its like without the braces, over all sizes."""
    slash = r"\\\\" if compat == "reference" else r"\\"
    plain, some = "|".join(SIZES), "|".join(s for s in SIZES if s != "Biggm")
    extra = "|".join(s for s in SIZES if s.endswith("ggm") or s.endswith("ggl"))
    rest = "|".join(s for s in SIZES if s not in extra.split("|"))
    out = text
    for sizes, inside, back in ((plain, r"[()]", ""), (some, r"\\[{}]", ""), (plain, r"\||\\\|", "")):
        out = F.regexp_replace(out, rf"\\({sizes}) ?\{{({inside})\}}", f"{slash}$1{back}$2")
    if compat == "reference":
        out = F.regexp_replace(out, rf"\\({extra}) ?\{{([\[\]])\}}", rf"{slash}$1\\$2")
        out = F.regexp_replace(out, rf"\\({rest}) ?\{{([\[\]])\}}", f"{slash}$1$2")
    else:
        out = F.regexp_replace(out, rf"\\({plain}) ?\{{([\[\]])\}}", f"{slash}$1$2")
    out = F.regexp_replace(out, rf"\\({some}) ?\{{\\([rl]angle)\}}", rf"{slash}$1{slash}$2 ")
    return F.regexp_replace(out, r"\\bigtimes", rf"{slash}times")


def normalised(text: Column) -> Column:
    out = F.regexp_replace(trimmed(text), r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\\left\s+", r"\\left"), r"(?U)\\right\s+", r"\\right")


def with_brackets(text: Column, compat: str = "reference") -> Column:
    opened, closed = (r"\\[\n", r"\n\\]") if compat == "reference" else ("\\[\n", "\n\\]")
    out = trimmed(text)
    out = F.when(out.startswith("\\["), out).otherwise(F.concat(F.lit(opened), out))
    return F.when(out.endswith("\\]"), out).otherwise(F.concat(out, F.lit(closed)))


def combined(contents: Column) -> Column:
    """Formulas as the lines of one; several tags become plain numbers."""
    tags = F.aggregate(contents, F.lit(0), lambda n, c: n + F.size(F.regexp_extract_all(c, F.lit(r"\\tag\s*\{[^}]*\}"), F.lit(0))))
    lines = F.transform(contents, lambda c: F.concat(F.when(tags > 1, F.regexp_replace(c, r"\\tag\s*\{([^}]*)\}", "($1)")).otherwise(c), F.lit(" \\\\ ")))
    return F.concat(F.lit(r"\begin{array}{l} "), F.array_join(lines, ""), F.lit(r"\end{array}"))


def balanced_braces(text: str) -> str:
    """Without braces that have no partner; escaped ones do not count."""
    opened, lone = [], set()
    for m in re.finditer(r"(\\*)([{}])", text):
        if len(m[1]) % 2:
            continue
        if m[2] == "{":
            opened.append(m.start(2))
        elif opened:
            opened.pop()
        else:
            lone.add(m.start(2))
    lone.update(opened)
    return "".join(c for i, c in enumerate(text) if i not in lone) if lone else text


def _cells(nodes: list[str]) -> list[tuple[int, int] | None]:
    """For each node its innermost array and the cell in it. Without arrays only the first node has a place."""
    opened: list[tuple[int, int]] = []
    arrays: list[tuple[int, int, int]] = []
    n = 0
    for i, node in enumerate(nodes):
        if r"\begin{array}" in node:
            n += 1
            opened.append((n, i))
        elif node == r"\end{array}" and opened:
            tag, start = opened.pop()
            arrays.append((tag, start, i))
    if not arrays:
        return [None]
    places: list[tuple[int, int] | None] = [None] * len(nodes)
    for tag, start, end in sorted(arrays, key=lambda a: a[2] - a[1], reverse=True):  # inner ones overwrite
        inner = [(s, e) for _, s, e in arrays if start < s and e < end]
        cell = 0
        for i in range(start, end + 1):
            if any(s <= i <= e for s, e in inner):
                continue
            if nodes[i] in ("&", "\\\\"):
                cell += 1
            else:
                places[i] = (tag, cell)
    return places


def _pairs(left: str, right: str) -> bool:
    l, r = left.removeprefix(r"\left"), right.removeprefix(r"\right")
    if not left.startswith(r"\left") or not right.startswith(r"\right"):
        return False
    if l == ".":
        return r == "." or r in PAIRS.values()
    return l in PAIRS and r in (PAIRS[l], ".")


def _known(token: str) -> bool:
    l, r = token.removeprefix(r"\left"), token.removeprefix(r"\right")
    if token != l:
        return l in PAIRS or l in (*LEFT_ONLY, ".")
    return token != r and (r in PAIRS.values() or r in (*RIGHT_ONLY, "."))


def matched_left_right(text: str) -> str:
    """Each lone left or right delimiter gets an empty partner, cell by cell."""
    if len(_LEFT.findall(text)) == len(_RIGHT.findall(text)) or text.count(r"\begin{array}") != text.count(r"\end{array}"):
        return text
    nodes = [x.strip() for x in _CELLS.split(text.strip()) if x.strip()]
    places = _cells(nodes)
    groups: dict[tuple[int, int] | None, list[int]] = {}
    for i, place in enumerate(places):
        node = nodes[i] if i < len(nodes) else ""
        if node and node not in ("&", "\\\\") and r"\begin{array}" not in node and r"\end{array}" not in node:
            groups.setdefault(place, []).append(i)
    for own in groups.values():
        if sum(len(_LEFT.findall(nodes[i])) for i in own) == sum(len(_RIGHT.findall(nodes[i])) for i in own):
            continue
        parts = [[p for p in _EITHER.split(nodes[i]) if p.strip()] for i in own]
        stack: list[tuple[str, int, int]] = []
        for k, pieces in enumerate(parts):
            for j, token in enumerate(pieces):
                if not _known(token):
                    continue
                if stack and _pairs(stack[-1][0], token):
                    stack.pop()
                else:
                    stack.append((token, k, j))
        for token, k, j in stack:
            parts[k][j] = f"{token} \\right." if token.startswith(r"\left") else f"\\left. {token}"
        for i, pieces in zip(own, parts, strict=True):
            nodes[i] = "".join(pieces)
    return "".join(nodes)


@F.pandas_udf(T.StringType())
def balanced_braces_udf(texts: pd.Series) -> pd.Series:
    return texts.map(balanced_braces, na_action="ignore")


@F.pandas_udf(T.StringType())
def matched_left_right_udf(texts: pd.Series) -> pd.Series:
    return texts.map(matched_left_right, na_action="ignore")


def count_left(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_LEFT_SQL), F.lit(0)))


def count_right(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_RIGHT_SQL), F.lit(0)))


def repaired(text: Column, compat: str = "reference") -> Column:
    """All repairs, in order."""
    out = matched_left_right_udf(text)
    out = sized_delimiters(eq_colon(double_subscript(out)), compat)
    return balanced_braces_udf(less_than(out))
