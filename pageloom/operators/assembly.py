"""From rows of blocks to rows of pages (schema.PAGE), and the metrics of the stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..schema import BACKEND, BUCKETS, DISCARDED, LINE, PARA, PART, VERSION
from . import grouping

KEY = ["doc_id", "page_idx"]
PHASES = ("render", "encode", "layout", "crop", "content", "image_save", "post_process")


def spans_of(kind: Column, content: Column, html: Column, image: Column) -> Column:
    """The spans of a block's one line."""
    blank = F.coalesce(content, F.lit(""))
    one = lambda t, c, h: F.array(F.struct(F.lit(t).alias("type"), c.alias("content"), h.alias("html"), image.alias("image_path")))
    none = F.lit(None).cast("string")
    parts = F.transform(text.inline_parts(text.bracket_cleaned(blank)), lambda p: F.struct(p["type"].alias("type"), p["content"].alias("content"), none.alias("html"), none.alias("image_path")))
    shape = LINE["spans"].dataType
    out = F.when(kind == "image", one("image", none, none).cast(shape)).when(kind == "table", one("table", none, F.coalesce(html, content, F.lit(""))).cast(shape))
    return out.when(kind == "equation", one("interline_equation", text.formula_cleaned(blank), none).cast(shape)).otherwise(parts.cast(shape))


def with_lines(blocks: DataFrame) -> DataFrame:
    code = F.col("type").isin("code", "algorithm")
    cleaned = F.when(code, text.code_cleaned(F.col("content"))).otherwise(F.col("content"))
    line = F.array(F.struct(spans_of(F.col("type"), cleaned, F.col("html"), F.col("image_path")).alias("spans")))
    return blocks.withColumn("lines", line.cast("array<struct<spans: array<struct<type: string, content: string, html: string, image_path: string>>>>")).withColumn("code_text", F.when(code, cleaned))


def _as_is(df: DataFrame) -> DataFrame:
    return df


def _places(blocks: DataFrame, compat: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, page_idx, block_idx, owner, kind, role, rank of the blocks that are parts of a paragraph, or have parts."""
    blocks = settle(blocks.select(*KEY, "block_idx", "type", "bbox"))
    items = grouping.listed(blocks)
    own = items.select(*KEY, F.col("list_idx").alias("block_idx"), F.col("list_idx").alias("owner"), F.lit("list").alias("kind"), F.lit("self").alias("role"), F.lit(0).alias("rank")).distinct()
    rank = F.when(F.col("type") == "text", 0).otherwise(1)
    out = own.unionByName(items.select(*KEY, "block_idx", F.col("list_idx").alias("owner"), F.lit("list").alias("kind"), F.lit("item").alias("role"), rank.alias("rank")))
    for kind in ("image", "table", "code"):
        rows = blocks.withColumn("type", F.when(F.col("type") == "algorithm", "code").otherwise(F.col("type"))) if kind == "code" else blocks
        found = settle(grouping.two_layers(rows, kind, compat).filter("body_idx IS NOT NULL"))
        out = out.unionByName(found.select(*KEY, "block_idx", F.col("body_idx").alias("owner"), F.lit(kind).alias("kind"), "role", F.lit(0).alias("rank")))
    return out


def paragraphs(blocks: DataFrame, compat: str = "reference", settle: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """doc_id, page_idx, para (schema.PARA), discarded: lists with their items, bodies with captions and footnotes, and what
    is left as text. Lists without items, and types that no bucket takes, are dropped."""
    rows = with_lines(blocks).join(_places(blocks, compat, settle), [*KEY, "block_idx"], "left").filter("role IS NOT NULL OR type != 'list'")
    of_layer = F.col("type").rlike("^(image|table|code)(_caption|_footnote)?$") | (F.col("type") == "algorithm")
    named = F.coalesce("kind", F.when(of_layer, "text").when(F.col("type") == "equation", "interline_equation").otherwise(F.col("type")))
    rows = rows.withColumn("named", named).withColumn("owner", F.coalesce("owner", "block_idx")).filter(F.col("named").isin(*BUCKETS, *DISCARDED))
    main = F.col("role").isNull() | F.col("role").isin("self", "body")
    part_type = F.when(F.col("role") == "item", F.col("type")).otherwise(F.concat_ws("_", "kind", "role"))
    part = F.struct(part_type.alias("type"), F.col("block_idx").alias("index"), "bbox", "lines").cast(PART)
    whole = rows.groupBy(*KEY, "owner", "named").agg(
        F.first(F.when(main, F.struct("type", "level", "bbox", "lines", "code_text")), ignorenulls=True).alias("m"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "self", F.struct("rank", "block_idx", part.alias("part"))))), lambda x: x["part"]).alias("parts"),
        (F.sum(F.when(F.col("type") == "ref_text", 1).otherwise(0)) > F.sum(F.when(F.col("type") == "text", 1).otherwise(0))).alias("references"),
    )
    layered = F.col("named").isin("image", "table", "code", "list")
    formula = F.exists(F.flatten(F.transform(F.col("m.lines"), lambda line: line["spans"])), lambda s: s["type"] == "inline_equation")
    sub = F.when(F.col("named") == "list", F.when(F.col("references"), "ref_text").otherwise("text")).when(F.col("named") == "code", F.when((F.col("m.type") == "algorithm") | formula, "algorithm").otherwise("code"))
    para = F.struct(
        F.col("named").alias("type"), sub.alias("sub_type"), F.when(sub == "code", text.code_language(F.coalesce("m.code_text", F.lit("")))).alias("guess_lang"), F.col("m.level").alias("level"),
        F.col("owner").alias("index"), F.col("m.bbox").alias("bbox"), F.when(~layered, F.col("m.lines")).alias("lines"), F.when(layered, F.col("parts")).alias("blocks"),
    ).cast(PARA)
    return whole.select(*KEY, para.alias("para"), F.col("named").isin(*DISCARDED).alias("discarded"))


def pages(blocks: DataFrame, sizes: DataFrame, compat: str = "reference", settle: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """One row per page of sizes (doc_id, page_idx, width, height in points), boxes in points, paragraphs in reading order;
    of one index in the order of the buckets. settle may compute what several joins read, so that plans stay small."""
    key = ["doc_id", "page_idx"]
    placed = blocks.join(sizes, key).withColumn("bbox", boxes.to_points(boxes.to_unit(F.col("bbox")), F.col("width"), F.col("height"))).drop("width", "height")
    rank = F.coalesce(*[F.when(F.col("para.type") == t, i) for i, t in enumerate(BUCKETS)], F.lit(len(BUCKETS)))
    entry = F.struct(F.col("para.index").alias("i"), rank.alias("rank"), "para")
    side = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("discarded") == flag, entry))), lambda x: x["para"])
    found = paragraphs(placed, compat, settle).groupBy(*key).agg(side(False).alias("para_blocks"), side(True).alias("discarded_blocks"))
    empty = F.array().cast("array<" + PARA.simpleString() + ">")
    return sizes.join(found, key, "left").select(*key, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.coalesce("para_blocks", empty).alias("para_blocks"), F.coalesce("discarded_blocks", empty).alias("discarded_blocks"))


def documents(pages: DataFrame) -> DataFrame:
    """doc_id, _backend, _version_name, pdf_info: each document's pages in order, with the format's stamp."""
    page = F.struct("page_idx", F.struct("para_blocks", "discarded_blocks", F.array("width", "height").alias("page_size"), "page_idx").alias("page"))
    ordered = F.transform(F.array_sort(F.collect_list(page), lambda a, b: F.when(a["page_idx"] < b["page_idx"], -1).when(a["page_idx"] > b["page_idx"], 1).otherwise(0)), lambda p: p["page"])
    return pages.groupBy("doc_id").agg(ordered.alias("pdf_info")).select("doc_id", F.lit(BACKEND).alias("_backend"), F.lit(VERSION).alias("_version_name"), "pdf_info")


def bucket(pages: DataFrame, kind: str) -> DataFrame:
    """doc_id, page_idx, para: the paragraphs of a type, discarded ones too."""
    both = pages.select("doc_id", "page_idx", F.explode(F.concat("para_blocks", "discarded_blocks")).alias("para"))
    return both.filter(F.col("para.type") == kind)


def total_metrics(metrics: DataFrame) -> DataFrame:
    """doc_id, pages, and the milliseconds of each phase over the pages that were recorded."""
    return metrics.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(f"{p}_ms").alias(f"{p}_ms") for p in PHASES], F.sum(sum((F.col(f"{p}_ms") for p in PHASES), F.lit(0))).alias("total_ms"))
