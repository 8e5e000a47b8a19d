"""From a model's layout text to rows of blocks, and the filters on blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions import latex as lx
from ..functions import otsl
from ..functions.text import trimmed
from ..schema import NOT_EXTRACTED, PARATEXT

#: One block of the layout text; the rest of the line says how it is turned.
LINE = r"^<\|box_start\|>([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)<\|box_end\|><\|ref_start\|>(\w+?)<\|ref_end\|>([^\r\n  ]*)\z"
TURNS = (("<|rotate_up|>", 0), ("<|rotate_right|>", 90), ("<|rotate_down|>", 180), ("<|rotate_left|>", 270))
LARGEST = 1000


def turn_of(tail: Column) -> Column:
    """By the first of the marks, in their own order, that is there; 0 without any."""
    out = None
    for mark, angle in TURNS:
        out = F.when(tail.contains(mark), angle) if out is None else out.when(tail.contains(mark), angle)
    return out.otherwise(0)


def page_boxes(raw: Column) -> Column:
    """array of (type, bbox, angle) of a page's layout text, in its order. A box lies within 0 and LARGEST after its
    coordinates are cut to whole numbers, and has an area. Numbers that are none drop their line."""
    part = lambda line, k: F.regexp_extract(line, LINE, k)
    number = lambda line, k: part(line, k).try_cast("double").cast("int").cast("double")
    lines = F.filter(F.split(raw, "\n"), lambda line: line.rlike(LINE))
    found = F.transform(lines, lambda line: F.struct(F.lower(part(line, 5)).alias("type"), F.array(*[number(line, k) for k in (1, 2, 3, 4)]).alias("box"), turn_of(part(line, 6)).alias("angle")))
    inside = F.filter(found, lambda b: F.forall(b["box"], lambda v: v.isNotNull() & v.between(0, LARGEST)))
    turned = F.transform(inside, lambda b: F.struct(b["type"].alias("type"), boxes.ordered(b["box"]).alias("box"), b["angle"].alias("angle")))
    good = F.filter(turned, lambda b: boxes.has_area(b["box"]))
    return F.transform(good, lambda b: F.struct(b["type"].alias("type"), F.transform(b["box"], lambda v: v / LARGEST).alias("bbox"), b["angle"].alias("angle")))


def parse(raw: DataFrame) -> DataFrame:
    """raw: doc_id, page_idx, raw. One row per valid line; block_idx counts them."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = raw.select("doc_id", "page_idx", F.posexplode(page_boxes(F.col("raw"))).alias("block_idx", "b"))
    return rows.select("doc_id", "page_idx", F.col("block_idx").cast("long").alias("block_idx"), "b.type", "b.bbox", "b.angle", none("string").alias("content"), none("string").alias("html"), none("string").alias("image_path"), none("int").alias("level"))


def first_pages(pages: DataFrame, limit: int) -> DataFrame:
    """The first pages of each document; all of them for a limit of 0 or less."""
    return pages.filter(F.col("page_idx") < limit) if limit > 0 else pages


def has_something() -> Column:
    return (F.coalesce(trimmed(F.col("content")), F.lit("")) != "") | (F.coalesce("html", F.lit("")) != "") | (F.coalesce("image_path", F.lit("")) != "")


def filtered(blocks: DataFrame, *, without_lists: bool = False, without_paratext: bool = False, without_empty: bool = False) -> DataFrame:
    keep = F.col("type") != "equation_block"
    if without_empty:
        keep &= has_something() | (F.col("type") == "image")
    if without_lists:
        keep &= F.col("type") != "list"
    if without_paratext:
        keep &= ~F.col("type").isin(*PARATEXT)
    return blocks.filter(keep)


def to_extract(blocks: DataFrame) -> DataFrame:
    """Blocks whose content a model is asked for, with the kind of prompt."""
    prompt = F.when(F.col("type") == "table", "table").when(F.col("type").contains("equation"), "equation").otherwise("text")
    return blocks.filter(~F.col("type").isin(*NOT_EXTRACTED)).withColumn("prompt", prompt)


def filled(blocks: DataFrame, contents: DataFrame) -> DataFrame:
    """blocks with the contents found for doc_id, page_idx, block_idx."""
    key = ["doc_id", "page_idx", "block_idx"]
    return blocks.drop("content").join(contents.select(*key, "content"), key, "left").select(*blocks.columns)


def type_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def with_table_html(blocks: DataFrame) -> DataFrame:
    """The rows without HTML that need it run through Python, no others."""
    needs = (F.col("type") == "table") & (F.coalesce("content", F.lit("")) != "") & (F.coalesce("html", F.lit("")) == "")
    return blocks.withColumn("html", F.when(needs, otsl.table_html_udf(F.when(needs, F.col("content")))).otherwise(F.col("html")))


def post_processed(blocks: DataFrame, *, simple: bool = False, join_equations: bool = False, without_lists: bool = False, without_paratext: bool = False, compat: str = "reference") -> DataFrame:
    """Tables to HTML; unless simple, formulas repaired, those of a container joined, in brackets, and empty blocks gone."""
    from .grouping import joined_equations

    out = with_table_html(blocks)
    if simple:
        return out
    is_formula = (F.col("type") == "equation") & (F.coalesce("content", F.lit("")) != "")
    out = out.withColumn("content", F.when(is_formula, lx.repaired(F.when(is_formula, F.col("content")), compat)).otherwise(F.col("content")))
    if join_equations:
        out = joined_equations(out)
    out = out.withColumn("content", F.when(is_formula, lx.with_brackets(F.col("content"), compat)).otherwise(F.col("content")))
    return filtered(out, without_lists=without_lists, without_paratext=without_paratext, without_empty=True)
