"""Relations of blocks, boxes and texts derived from the driver's tables by whole-number arithmetic, once for Spark and
once in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("title", "image", "image_caption", "table", "table_caption", "table_footnote", "code", "equation", "header", "ref_text", "text", "text")
BOX_TYPES = ("equation_block", "equation", "list", "ref_text", "text", "text")
BOX_KEY = ["doc_id", "page_idx", "block_idx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def as_box(df: DataFrame) -> DataFrame:
    return df.withColumn("bbox", F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_idx, block_idx, type, x0, y0, x1, y1 (thousandths), content: one row per line of documents."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content")).withColumn("i", F.col("i").cast("long"))
    rows = lines.select("doc_id", F.floor(F.col("i") / 8).cast("long").alias("page_idx"), (F.col("i") % 8).alias("block_idx"), _pick(TYPES, F.col("doc_id") * 7 + F.col("i")).alias("type"), "i", "content")
    return rows.select(
        *BOX_KEY, "type", (50 + (F.col("doc_id") % 5) * 10).alias("x0"), (40 + F.col("block_idx") * 115).alias("y0"),
        (950 - (F.col("i") % 3) * 150).alias("x1"), (140 + F.col("block_idx") * 115).alias("y1"), "content",
    )


BLOCKS = f"""
fx_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS i FROM documents),
fx_blocks AS (
  SELECT doc_id, i // 8 AS page_idx, i % 8 AS block_idx, list_extract({list(TYPES)!r}, CAST((doc_id * 7 + i) % 12 + 1 AS INTEGER)) AS type,
         50 + (doc_id % 5) * 10 AS x0, 40 + (i % 8) * 115 AS y0, 950 - (i % 3) * 150 AS x1, 140 + (i % 8) * 115 AS y1, content
  FROM fx_lines)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_idx, block_idx, type, x0, y0, x1, y1 (thousandths), content, key: the orders of a customer as a page."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).cast("long").alias("page_idx"),
        F.expr("CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT)").alias("block_idx"), _pick(BOX_TYPES, key).alias("type"),
        ((key * 37) % 500).alias("x0"), ((key * 53) % 500).alias("y0"), key.alias("key"),
    )
    wide = F.col("type").isin("equation_block", "list")
    rows = rows.withColumn("x1", F.col("x0") + F.when(wide, 500).otherwise(20 + (F.col("key") * 17) % 120)).withColumn("y1", F.col("y0") + F.when(wide, 500).otherwise(20 + (F.col("key") * 29) % 120))
    return rows.select(*BOX_KEY, "type", "x0", "y0", "x1", "y1", F.concat(F.lit("e"), F.col("key").cast("string")).alias("content"), "key")


BOXES = f"""
fx_raw AS (SELECT o_custkey AS doc_id, CAST(0 AS BIGINT) AS page_idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS block_idx,
  list_extract({list(BOX_TYPES)!r}, CAST(o_orderkey % 6 + 1 AS INTEGER)) AS type, (o_orderkey * 37) % 500 AS x0, (o_orderkey * 53) % 500 AS y0, o_orderkey AS key FROM orders),
fx_boxes AS (SELECT doc_id, page_idx, block_idx, type, x0, y0,
  x0 + CASE WHEN type IN ('equation_block', 'list') THEN 500 ELSE 20 + (key * 17) % 120 END AS x1,
  y0 + CASE WHEN type IN ('equation_block', 'list') THEN 500 ELSE 20 + (key * 29) % 120 END AS y1, 'e' || key AS content, key FROM fx_raw)"""

#: Each box beside the next one of its page.
PAIRS = "fx_pairs AS (SELECT a.doc_id, a.block_idx, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM fx_boxes a JOIN fx_boxes b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND b.block_idx = a.block_idx + 1)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_box(boxes(spark, sf_dir))
    other = rows.select("doc_id", "page_idx", (F.col("block_idx") - 1).alias("block_idx"), F.col("bbox").alias("other"))
    return rows.join(other, BOX_KEY).select("doc_id", "block_idx", "bbox", "other")


def layout(spark: SparkSession, sf_dir: str, corner: bool = False) -> DataFrame:
    """doc_id, page_idx, raw: layout text of the boxes. corner: with lines that a parser must turn round or refuse, and all
    turns."""
    rows = boxes(spark, sf_dir)
    k = F.col("key") % 5
    x0, x1 = F.col("x0"), F.col("x1")
    turn = _pick(("up", "right", "down", "left"), F.col("key"))
    if corner:
        x0, x1 = F.when(k == 3, F.col("x1")).otherwise(x0), F.when(k == 1, x1 + 1000).when(k == 2, F.col("x0")).when(k == 3, F.col("x0")).otherwise(x1)
        x1 = F.concat(x1.cast("string"), F.lit(".9"))
    line = F.concat(
        F.lit("<|box_start|>"), F.concat_ws(" ", x0.cast("string"), F.col("y0").cast("string"), x1.cast("string"), F.col("y1").cast("string")), F.lit("<|box_end|><|ref_start|>"),
        F.upper("type") if corner else F.col("type"), F.lit("<|ref_end|>"), F.concat(F.lit("<|rotate_"), turn, F.lit("|>")) if corner else F.lit("<|rotate_up|>"), F.when(F.lit(corner) & (k == 4), "\r").otherwise(""),
    )
    return rows.groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("raw"))


def markup(spark: SparkSession, sf_dir: str, parts: str = "p_partkey % 10 = 0") -> DataFrame:
    """p_brand, otsl: a table of cell tokens for each brand, with a row for each of the parts."""
    rows = table(spark, sf_dir, "part").filter(parts)
    row = F.concat(F.lit("<fcel>"), F.col("p_name"), F.when(F.col("p_size") % 3 == 0, "<lcel>").otherwise(F.concat(F.lit("<fcel>"), F.col("p_type"))))
    return rows.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"]), "<nl>").alias("otsl"))


def edge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per region and a page per nation, with one table of two columns each: a header and its name and key. Its
    width and its caption decide whether it goes on from the page before."""
    nation = table(spark, sf_dir, "nation")
    order = F.expr("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1").cast("long")
    rows = nation.select(F.col("n_regionkey").cast("long").alias("doc_id"), order.alias("page_idx"), F.col("n_nationkey").cast("long").alias("key"), "n_name")
    html = F.concat(F.lit("<table><tr><td>name</td><td>key</td></tr><tr><td>"), F.col("n_name"), F.lit("</td><td>"), F.col("key").cast("string"), F.lit("</td></tr></table>"))
    caption = F.when(F.col("key") % 4 == 1, F.array(F.lit("Table 1 (continued)"))).when(F.col("key") % 4 == 2, F.array(F.lit("Table 2"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "page_idx", F.lit(True).alias("is_first"), F.lit(True).alias("is_last"), F.lit(50.0).alias("x0"), F.when(F.col("key") % 5 == 0, 400.0).otherwise(950.0).alias("x1"), html.alias("html"), caption.alias("captions"), F.array().cast("array<string>").alias("footnotes"))
