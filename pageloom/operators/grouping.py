"""Joins between the blocks of a page. Every join has the page as its key, so that boxes are only compared on a page, and
windows and joins share one exchange by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, latex

PAGE = ["doc_id", "page_idx"]
COVERED, LISTED = 0.9, 0.8


def _as(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def covered_equations(blocks: DataFrame) -> DataFrame:
    """doc_id, page_idx, outer_block_idx, block_idx, content: formulas by their containers, of containers with several."""
    outer = _as(blocks.filter("type = 'equation_block'"), "outer", "block_idx", "bbox")
    inner = blocks.filter("type = 'equation'").select(*PAGE, "block_idx", "bbox", "content")
    met = inner.join(outer, PAGE).filter(boxes.share_of(F.col("bbox"), F.col("outer_bbox")) > COVERED)
    several = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "outer_block_idx")) > 1
    return met.withColumn("several", several).filter("several").select(*PAGE, "outer_block_idx", "block_idx", "content")


def combined_equations(blocks: DataFrame) -> DataFrame:
    """doc_id, page_idx, block_idx, n, content: one formula for each container of several, unless all are empty."""
    covered = covered_equations(blocks)
    some = F.coalesce("content", F.lit("")) != ""
    parts = F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("block_idx", "content")))), lambda p: p["content"])
    one = covered.groupBy(*PAGE, F.col("outer_block_idx").alias("block_idx")).agg(F.count(F.lit(1)).alias("n"), parts.alias("parts"))
    return one.filter(F.size("parts") > 0).select(*PAGE, "block_idx", "n", latex.combined(F.col("parts")).alias("content"))


def joined_equations(blocks: DataFrame) -> DataFrame:
    """blocks with each container of several formulas as one formula; the formulas and all other containers go."""
    key = [*PAGE, "block_idx"]
    inside = covered_equations(blocks).select(*key).distinct()
    joined = combined_equations(blocks).select(*key, F.col("content").alias("whole"))
    rest = blocks.filter("type != 'equation_block'").join(inside, key, "left_anti").select(*blocks.columns)
    made = blocks.filter("type = 'equation_block'").join(joined, key).withColumn("type", F.lit("equation")).withColumn("content", F.col("whole"))
    made = made.withColumn("html", F.lit(None).cast("string")) if "html" in blocks.columns else made
    return rest.unionByName(made.select(*blocks.columns))


def without_nested(blocks: DataFrame, compat: str = "reference") -> DataFrame:
    """Boxes in no other box of the page and type group. Of boxes that coincide none stays ("reference"), or the first
    ("fixed")."""
    other = _as(blocks, "other", "block_idx", "bbox")
    cond = [blocks[c] == other[c] for c in PAGE]
    inside = boxes.is_in(F.col("bbox"), F.col("other_bbox")) & (F.col("block_idx") != F.col("other_block_idx"))
    if compat == "fixed":
        inside &= ~boxes.is_in(F.col("other_bbox"), F.col("bbox")) | (F.col("other_block_idx") < F.col("block_idx"))
    return blocks.join(other, [*cond, inside], "left_anti")


def nearest_bodies(bodies: DataFrame, others: DataFrame) -> DataFrame:
    """others with body_idx, the body of the page that is nearest in reading order, then by the centres, then the first.
    Pages without bodies have no rows."""
    met = others.join(_as(bodies, "body", "block_idx", "bbox"), PAGE)
    rank = F.struct(F.abs(F.col("block_idx") - F.col("body_block_idx")), boxes.centre_distance(F.col("bbox"), F.col("body_bbox")), F.col("body_block_idx"))
    best = met.groupBy(*PAGE, "block_idx").agg(F.min_by("body_block_idx", rank).alias("body_idx"))
    return others.join(best, [*PAGE, "block_idx"])


def replaced_footnotes(attached: DataFrame, bodies: DataFrame) -> DataFrame:
    """Footnotes that stand before their body go to the last other body at or before them; body_idx is null without one.
    attached: doc_id, page_idx, block_idx, body_idx."""
    bodies = bodies.select(*PAGE, F.col("block_idx").alias("other_idx"))
    early = attached.filter("block_idx < body_idx")
    met = early.join(bodies, PAGE).filter("other_idx <= block_idx AND other_idx != body_idx")
    best = met.groupBy(*PAGE, "block_idx").agg(F.max("other_idx").alias("found"))
    moved = early.join(best, [*PAGE, "block_idx"], "left").select(*PAGE, "block_idx", F.col("found").alias("body_idx"))
    return attached.filter("block_idx >= body_idx").select(*PAGE, "block_idx", "body_idx").unionByName(moved)


def contiguous_captions(attached: DataFrame) -> DataFrame:
    """attached with kept: captions from the last one up, as long as they follow each other or only the body is between."""
    down = Window.partitionBy(*PAGE, "body_idx").orderBy(F.desc("block_idx"))
    before = F.lag("block_idx").over(down)
    follows = before.isNull() | (F.col("block_idx") == before - 1) | ((F.col("block_idx") == before - 2) & (F.col("body_idx") == before - 1))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return attached.withColumn("follows", follows.cast("int")).withColumn("kept", F.min("follows").over(so_far) == 1).drop("follows")


def contiguous_footnotes(attached: DataFrame) -> DataFrame:
    """attached with kept: footnotes from the first one down, as long as they follow each other."""
    up = Window.partitionBy(*PAGE, "body_idx").orderBy("block_idx")
    before = F.lag("block_idx").over(up)
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return attached.withColumn("follows", (before.isNull() | (F.col("block_idx") == before + 1)).cast("int")).withColumn("kept", F.min("follows").over(so_far) == 1).drop("follows")


def listed(blocks: DataFrame, own_types: tuple[str, ...] = ("text", "ref_text")) -> DataFrame:
    """doc_id, page_idx, block_idx, type, list_idx: blocks that lie in a list, by the first such list."""
    lists = _as(blocks.filter("type = 'list'"), "list", "block_idx", "bbox")
    items = blocks.filter(F.col("type").isin(*own_types)).select(*PAGE, "block_idx", "type", "bbox")
    met = items.join(lists, PAGE).filter(boxes.share_of(F.col("bbox"), F.col("list_bbox")) >= LISTED)
    return met.groupBy(*PAGE, "block_idx", "type").agg(F.min("list_block_idx").alias("list_idx"))


def list_types(items: DataFrame) -> DataFrame:
    """doc_id, page_idx, list_idx, n, sub_type: the most frequent type of its items, of equals the one that comes first;
    texts come before references."""
    place = F.struct(F.when(F.col("type") == "text", 0).otherwise(1), "block_idx")
    kinds = items.groupBy(*PAGE, "list_idx", "type").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first"))
    best = F.min_by("type", F.struct(-F.col("c"), "first"))
    return kinds.groupBy(*PAGE, "list_idx").agg(F.sum("c").alias("n"), best.alias("sub_type"))


def two_layers(blocks: DataFrame, kind: str, compat: str = "reference") -> DataFrame:
    """doc_id, page_idx, body_idx, block_idx, role of the bodies of a kind (image, table, code) and what belongs to them;
    rejected captions and footnotes have no body_idx. Code has no footnotes and no rules of contiguity."""
    only = lambda t: without_nested(blocks.filter(F.col("type") == t), compat)
    bodies = only(kind)
    captions = nearest_bodies(bodies, only(f"{kind}_caption")).select(*PAGE, "block_idx", "body_idx")
    own = bodies.select(*PAGE, F.col("block_idx").alias("body_idx"), "block_idx", F.lit("body").alias("role"))
    if kind == "code":
        return own.unionByName(captions.select(*PAGE, "body_idx", "block_idx", F.lit("caption").alias("role")))
    notes = replaced_footnotes(nearest_bodies(bodies, only(f"{kind}_footnote")).select(*PAGE, "block_idx", "body_idx"), bodies)
    lost = notes.filter("body_idx IS NULL").withColumn("kept", F.lit(False))
    notes = contiguous_footnotes(notes.filter("body_idx IS NOT NULL")).unionByName(lost)
    role = lambda df, name: df.select(*PAGE, F.when(F.col("kept"), F.col("body_idx")).alias("body_idx"), "block_idx", F.lit(name).alias("role"))
    return own.unionByName(role(contiguous_captions(captions), "caption")).unionByName(role(notes, "footnote"))


def reading_order(blocks: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per page with its blocks as an array in order of block_idx."""
    fields = [c for c in blocks.columns if c not in PAGE]
    first = ["block_idx", *[c for c in fields if c != "block_idx"]]
    return blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*first))).alias("blocks"))
