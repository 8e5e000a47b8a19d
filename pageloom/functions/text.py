"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
WIDE_ALNUM = "".join(w for w, n in zip(WIDE, NARROW, strict=True) if n.isalnum())
NARROW_ALNUM = "".join(n for n in NARROW if n.isalnum())
#: Kana and Han characters tell texts that are set without spaces.
HAN = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
END_TOKEN = "<|im_end|>"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+", ""), r"(?U)[\s\x{FEFF}]+\z", "")


def full_to_half(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


def full_to_half_alnum(text: Column) -> Column:
    return F.translate(text, WIDE_ALNUM, NARROW_ALNUM)


def ends_in_hyphen(text: Column) -> Column:
    return text.rlike(r"(?U)[A-Za-z]-\s*\z")


def language(text: Column) -> Column:
    return F.when(text == "", "").when(text.rlike(HAN), "zh").otherwise("en")


def code_language(text: Column) -> Column:
    return F.when(text == "", "txt").otherwise(language(text))


def html_escaped(text: Column) -> Column:
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def without_end_token(text: Column, token: str = END_TOKEN) -> Column:
    if not token:
        return text
    return F.when(text.endswith(token), F.substring(text, F.lit(1), F.length(text) - len(token))).otherwise(text)


def code_cleaned(text: Column) -> Column:
    """Without the fence lines around it."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    opened = F.when(lines[0].startswith("```"), 1).otherwise(0)
    n = F.size(lines)
    closed = F.when((n > opened) & (trimmed(F.element_at(lines, -1)) == "```"), 1).otherwise(0)
    return F.when(n - opened - closed > 0, trimmed(F.array_join(F.slice(lines, opened + 1, F.greatest(n - opened - closed, F.lit(1))), "\n"))).otherwise("")


def _count(text: Column, literal: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)


def bracket_cleaned(text: Column) -> Column:
    r"""\[x\] becomes [x] where both marks are there as often."""
    opened, closed = _count(text, "\\["), _count(text, "\\]")
    return F.when((opened == closed) & (opened > 0), F.regexp_replace(text, r"\\\[(.*?)\\\]", "[$1]")).otherwise(F.coalesce(text, F.lit("")))


def formula_cleaned(text: Column) -> Column:
    r"""Without one \[ before and one \] after it."""
    out = F.when(text.startswith("\\["), F.substring(text, F.lit(3), F.length(text))).otherwise(text)
    return trimmed(F.when(out.endswith("\\]"), F.substring(out, F.lit(1), F.length(out) - 2)).otherwise(out))


def inline_parts(text: Column) -> Column:
    r"""array of (type, content): text, and what stands in \( \) as inline_equation, if both marks are there as often; else
    all as text. Blank texts go."""
    opened, closed = _count(text, "\\("), _count(text, "\\)")
    kind = "array<struct<type: string, content: string>>"
    pattern = r"\\\((.+?)\\\)"
    between = F.split(text, pattern, -1)
    formulas = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def pair(piece: Column, i: Column) -> Column:
        plain = F.filter(F.array(F.struct(F.lit("text").alias("type"), piece.alias("content"))), lambda p: trimmed(p["content"]) != "")
        formula = F.when(i < F.size(formulas), F.array(F.struct(F.lit("inline_equation").alias("type"), trimmed(F.get(formulas, i)).alias("content")))).otherwise(F.array().cast(kind))
        return F.concat(plain.cast(kind), formula.cast(kind))

    parts = F.flatten(F.transform(between, pair))
    return F.when((opened == closed) & (opened > 0), parts).otherwise(F.array(F.struct(F.lit("text").alias("type"), text.alias("content"))).cast(kind))


def image_name(kind: Column, document: Column, page: Column, box: Column) -> Column:
    """The file of a cut-out: a digest of what it shows and where."""
    place = F.concat_ws("_", document, page.cast("string"), *[box[i].cast("int").cast("string") for i in range(4)])
    return F.concat(F.sha2(F.concat(kind, F.lit("/"), place), 256), F.lit(".jpg"))


def block_image_name(data_uri: Column) -> Column:
    """A digest of the encoded text, with the ending of its media type."""
    ending = F.regexp_extract(data_uri, r"^data:image/([A-Za-z0-9.+-]+);base64,", 1)
    encoded = F.regexp_replace(data_uri, r"^data:image/[A-Za-z0-9.+-]+;base64,", "")
    return F.concat(F.sha2(encoded, 256), F.lit("."), F.when(ending == "jpeg", "jpg").when(ending == "", "png").otherwise(ending))


def image_path(kind: Column, document: Column, page: Column, box: Column, has_writer: bool = True) -> Column:
    """image_name of cut-outs that exist: blank without a writer, for a box without area and for other kinds of spans."""
    exists = kind.isin("image", "table", "interline_equation") & (box[0] < box[2]) & (box[1] < box[3]) & has_writer
    return F.when(exists, image_name(kind, document, page, box)).otherwise("")
