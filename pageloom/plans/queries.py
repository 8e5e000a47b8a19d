"""Queries over the derived relations, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import latex as lx
from ..functions import otsl
from ..functions import text as tx
from ..operators import assembly, compare, grouping, layout, pairing, render, tables
from ..schema import PARA
from . import fixtures as fx
from .pipeline import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = ""):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def derived(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = make
    ORACLE_SQL[name] = sql


KEY = fx.BOX_KEY


def _spread(df: DataFrame, box: str, *rest: Column | str) -> DataFrame:
    return df.select(*rest, *[F.col(box)[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


# Markdown -------------------------------------------------------------------------------------------------------------


def _paras(rows: DataFrame) -> DataFrame:
    """Pages with one paragraph for each block; image blocks get the body that their place names."""
    none = F.lit(None)
    text = F.struct(F.lit("text").alias("type"), F.col("content"), none.cast("string").alias("html"), none.cast("string").alias("image_path"))
    picture = F.struct(F.lit("image").alias("type"), none.cast("string").alias("content"), none.cast("string").alias("html"), F.col("image_path"))
    line = lambda span: F.array(F.struct(F.array(span).alias("spans")))
    body = F.array(F.struct(F.lit("image_body").alias("type"), F.col("block_idx").alias("index"), F.col("bbox"), line(picture).alias("lines")))
    image = F.col("type") == "image"
    para = F.struct(
        F.col("type"), none.alias("sub_type"), none.alias("guess_lang"), F.col("level"), F.col("block_idx").alias("index"), F.col("bbox"),
        F.when(~image, line(text)).alias("lines"), F.when(image, body).alias("blocks"),
    ).cast(PARA)
    own = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", para.alias("para")))), lambda x: x["para"])
    pages = rows.groupBy("doc_id", "page_idx").agg(own.alias("para_blocks"))
    return pages.select("doc_id", "page_idx", F.lit(595).alias("width"), F.lit(842).alias("height"), "para_blocks", F.array().cast("array<" + PARA.simpleString() + ">").alias("discarded_blocks"))


def _shown(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    rows = fx.as_box(fx.blocks(spark, sf_dir)).filter(F.col("type").isin(*types)).withColumn("level", (F.col("doc_id") % 7).cast("int"))
    name = tx.image_name(F.col("type"), F.upper(F.md5(F.col("doc_id").cast("string"))), F.col("page_idx"), F.col("bbox"))
    return rows.withColumn("image_path", F.when(F.col("type") == "image", name))


_LEVEL = "CASE WHEN doc_id % 7 > 4 THEN 4 ELSE doc_id % 7 END"
_NAME = "sha256('image/' || upper(md5(CAST(doc_id AS VARCHAR))) || '_' || page_idx || '_' || x0 || '_' || y0 || '_' || x1 || '_' || y1) || '.jpg'"


def _markdown_sql(types: str) -> str:
    return f"""WITH {fx.BLOCKS}, shown AS (SELECT *, CASE type WHEN 'title' THEN trim(repeat('#', CAST({_LEVEL} AS INTEGER)) || ' ' || trim(content))
      WHEN 'image' THEN '![](images/' || {_NAME} || ')' ELSE trim(content) END AS para FROM fx_blocks WHERE type IN ({types}))
    SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY page_idx, block_idx) AS markdown FROM shown WHERE para != '' GROUP BY doc_id"""


@query(_markdown_sql("'title', 'text'"))
def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.document_markdown(_paras(_shown(spark, sf_dir, "title", "text")))


@query(_markdown_sql("'title', 'text', 'ref_text', 'image'"))
def mm_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.document_markdown(_paras(_shown(spark, sf_dir, "title", "text", "ref_text", "image")), style=render.Style(images="images"))


@query(f"""SELECT d.doc_id, coalesce(m.markdown, '') AS markdown FROM (WITH {fx.BLOCKS} SELECT DISTINCT doc_id FROM fx_blocks WHERE type IN ('title', 'text', 'image')) d
LEFT JOIN ({_markdown_sql("'title', 'text'")}) m USING (doc_id)""")
def nlp_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.document_markdown(_paras(_shown(spark, sf_dir, "title", "text", "image")), render.NLP_MARKDOWN)


# Layout ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {fx.BOXES} SELECT doc_id, page_idx, block_idx, type, CAST(0 AS INTEGER) AS angle, x0 / 1000.0 AS x0, y0 / 1000.0 AS y0, x1 / 1000.0 AS x1, y1 / 1000.0 AS y1 FROM fx_boxes".replace("1000.0", "CAST(1000 AS DOUBLE)"))
def layout_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(layout.parse(fx.layout(spark, sf_dir)), "bbox", *KEY, "type", "angle")


@query(f"""WITH {fx.BOXES} SELECT doc_id, page_idx, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS block_idx, type, CAST((key % 4) * 90 AS INTEGER) AS angle,
  x0 / CAST(1000 AS DOUBLE) AS x0, y0 / CAST(1000 AS DOUBLE) AS y0, x1 / CAST(1000 AS DOUBLE) AS x1, y1 / CAST(1000 AS DOUBLE) AS y1 FROM fx_boxes WHERE key % 5 IN (0, 3)""")
def layout_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(layout.parse(fx.layout(spark, sf_dir, corner=True)), "bbox", *KEY, "type", "angle")


@query(f"WITH {fx.BOXES} SELECT CAST((key % 4) * 90 AS INTEGER) AS angle, count(*) AS n FROM fx_boxes WHERE key % 5 IN (0, 3) GROUP BY ALL")
def layout_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.parse(fx.layout(spark, sf_dir, corner=True)).groupBy("angle").agg(F.count(F.lit(1)).alias("n"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda c: F.lit(None).cast("string").alias(c)
    return fx.as_box(fx.blocks(spark, sf_dir)).select("*", none("html"), none("image_path"))


@query(f"WITH {fx.BLOCKS} SELECT doc_id, page_idx, block_idx, type FROM fx_blocks WHERE type NOT IN ('header', 'equation_block') AND (trim(content) != '' OR type = 'image')")
def filter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.filtered(_blocks(spark, sf_dir), without_paratext=True, without_lists=True, without_empty=True).select(*KEY, "type")


@query(f"WITH {fx.BOXES} SELECT doc_id, block_idx, type, CASE WHEN type = 'table' THEN 'table' WHEN contains(type, 'equation') THEN 'equation' ELSE 'text' END AS prompt FROM fx_boxes WHERE type NOT IN ('image', 'list', 'equation_block')")
def extract_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.to_extract(fx.boxes(spark, sf_dir)).select("doc_id", "block_idx", "type", "prompt")


@query(f"WITH {fx.BLOCKS} SELECT doc_id, page_idx, count(*) AS n FROM fx_blocks WHERE page_idx < 2 GROUP BY ALL")
def page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.first_pages(fx.blocks(spark, sf_dir), 2).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.BLOCKS} SELECT type, count(*) AS n FROM fx_blocks GROUP BY type")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.type_histogram(fx.blocks(spark, sf_dir))


_MS = ", ".join(f"sum(page_idx * {k} + n) AS {p}_ms" for k, p in enumerate(assembly.PHASES, 1))


@query(f"""WITH {fx.BLOCKS}, p AS (SELECT doc_id, page_idx, count(*) AS n FROM fx_blocks GROUP BY ALL), s AS (SELECT doc_id, count(*) AS pages, {_MS} FROM p GROUP BY doc_id)
SELECT doc_id, pages, {", ".join(f"CAST({p}_ms AS BIGINT) AS {p}_ms" for p in assembly.PHASES)}, CAST({" + ".join(f"{p}_ms" for p in assembly.PHASES)} AS BIGINT) AS total_ms FROM s""")
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.blocks(spark, sf_dir).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"))
    return assembly.total_metrics(pages.select("doc_id", "page_idx", *[(F.col("page_idx") * k + F.col("n")).alias(f"{p}_ms") for k, p in enumerate(assembly.PHASES, 1)]))


@query(f"WITH {fx.BOXES} SELECT doc_id, page_idx, block_idx, type, CASE WHEN type IN ('image', 'list', 'equation_block') THEN NULL ELSE 'got ' || content END AS content FROM fx_boxes")
def fill_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.boxes(spark, sf_dir)
    answers = layout.to_extract(rows).select(*KEY, F.concat(F.lit("got "), F.col("content")).alias("content"))
    return layout.filled(rows, answers).select(*KEY, "type", "content")


# Boxes ----------------------------------------------------------------------------------------------------------------

W, H = 595.32, 841.92


def _box_query(name: str, value: Callable[[], Column], columns: dict[str, str]) -> None:
    """A box of four numbers from each box, and its SQL by column."""
    derived(
        name,
        lambda spark, sf_dir: fx.as_box(fx.boxes(spark, sf_dir)).withColumn("out", value()).select("doc_id", "block_idx", *[F.col("out")[i].cast("long").alias(c) for i, c in enumerate(columns)]),
        f"WITH {fx.BOXES} SELECT doc_id, block_idx, {', '.join(f'CAST({sql} AS BIGINT) AS {c}' for c, sql in columns.items())} FROM fx_boxes",
    )


_unit = lambda: bx.to_unit(F.col("bbox"))
_box_query("bbox_page_points", lambda: bx.to_points(_unit(), F.lit(W), F.lit(H)), {c: f"trunc({c} / CAST(1000 AS DOUBLE) * {595 if c[0] == 'x' else 841})" for c in ("x0", "y0", "x1", "y1")})
_box_query("bbox_out1000", lambda: bx.to_thousandths(F.col("bbox"), F.lit(2048), F.lit(2896)), {c: f"trunc({c} * 1000 / CAST({2048 if c[0] == 'x' else 2896} AS DOUBLE))" for c in ("x0", "y0", "x1", "y1")})
_box_query(
    "crop_pixel_box", lambda: bx.crop_pixels(F.col("bbox"), F.lit(640), F.lit(480)),
    {"left_px": "greatest(0, least(floor(x0 / CAST(1000 AS DOUBLE) * 640), 639))", "top_px": "greatest(0, least(floor(y0 / CAST(1000 AS DOUBLE) * 480), 479))",
     "right_px": "greatest(greatest(0, least(floor(x0 / CAST(1000 AS DOUBLE) * 640), 639)) + 1, least(ceil(x1 / CAST(1000 AS DOUBLE) * 640), 640))",
     "bottom_px": "greatest(greatest(0, least(floor(y0 / CAST(1000 AS DOUBLE) * 480), 479)) + 1, least(ceil(y1 / CAST(1000 AS DOUBLE) * 480), 480))"},
)
derived(
    "bbox_unit",
    lambda spark, sf_dir: _spread(fx.as_box(fx.boxes(spark, sf_dir)).withColumn("out", _unit()), "out", "doc_id", "block_idx"),
    f"WITH {fx.BOXES} SELECT doc_id, block_idx, {', '.join(f'{c} / CAST(1000 AS DOUBLE) AS {c}' for c in ('x0', 'y0', 'x1', 'y1'))} FROM fx_boxes",
)


@query("""WITH s AS (SELECT o_orderkey, 1 + o_orderkey % 7 AS w, 1 + (o_orderkey * 7) % 900 AS h FROM orders),
p AS (SELECT *, greatest(w, h) / CAST(least(w, h) AS DOUBLE) > 50 AS long FROM s),
q AS (SELECT o_orderkey, CAST(CASE WHEN long AND w < h THEN ceil(h / CAST(50 AS DOUBLE)) ELSE w END AS BIGINT) AS w, CAST(CASE WHEN long AND w >= h THEN ceil(w / CAST(50 AS DOUBLE)) ELSE h END AS BIGINT) AS h FROM p)
SELECT o_orderkey, CAST(ceil(w * CASE WHEN least(w, h) < 28 THEN 28 / CAST(least(w, h) AS DOUBLE) ELSE 1 END) AS BIGINT) AS width, CAST(ceil(h * CASE WHEN least(w, h) < 28 THEN 28 / CAST(least(w, h) AS DOUBLE) ELSE 1 END) AS BIGINT) AS height FROM q""")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", bx.sized_for_model(1 + F.col("o_orderkey") % 7, 1 + (F.col("o_orderkey") * 7) % 900).alias("out"))
    return rows.select("o_orderkey", F.col("out")[0].alias("width"), F.col("out")[1].alias("height"))


@query("""WITH s AS (SELECT o_orderkey, CAST(100 + o_orderkey % 1500 AS DOUBLE) AS w, CAST(100 + (o_orderkey * 7) % 1900 AS DOUBLE) AS h FROM orders),
p AS (SELECT *, least(200 / CAST(72 AS DOUBLE), 3500 / greatest(w, h)) AS scale FROM s)
SELECT o_orderkey, round(scale, 6) AS scale, CAST(ceil(w * scale) AS BIGINT) AS width, CAST(ceil(h * scale) AS BIGINT) AS height FROM p""")
def render_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (100 + F.col("o_orderkey") % 1500).cast("double"), (100 + (F.col("o_orderkey") * 7) % 1900).cast("double")
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", bx.rendered_size(w, h).alias("out"))
    return rows.select("o_orderkey", F.round("out.scale", 6).alias("scale"), "out.width", "out.height")


_MEET = "greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0))"
for _name, _value, _sql in (
    ("box_distance", bx.distance, "sqrt(pow(greatest(0, ax0 - bx1, bx0 - ax1), 2) + pow(greatest(0, ay0 - by1, by0 - ay1), 2))"),
    ("box_center_distance", bx.centre_distance, "sqrt(pow((ax0 + ax1 - bx0 - bx1) / CAST(2 AS DOUBLE), 2) + pow((ay0 + ay1 - by0 - by1) / CAST(2 AS DOUBLE), 2))"),
    ("overlap_ratio", bx.share_of, f"({_MEET}) / CAST((ax1 - ax0) * (ay1 - ay0) AS DOUBLE)"),
    ("cover_ratio", lambda a, b: bx.share_of(b, a), f"({_MEET}) / CAST((bx1 - bx0) * (by1 - by0) AS DOUBLE)"),
):
    derived(
        _name,
        lambda spark, sf_dir, _value=_value: fx.pairs(spark, sf_dir).select("doc_id", "block_idx", F.round(_value(F.col("bbox"), F.col("other")), 6).alias("value")),
        f"WITH {fx.BOXES}, {fx.PAIRS} SELECT doc_id, block_idx, round({_sql}, 6) AS value FROM fx_pairs",
    )

# Joins between blocks -------------------------------------------------------------------------------------------------

_INSIDE = "greatest(0, least(e.x1, c.x1) - greatest(e.x0, c.x0)) * greatest(0, least(e.y1, c.y1) - greatest(e.y0, c.y0)) / CAST((e.x1 - e.x0) * (e.y1 - e.y0) AS DOUBLE)"


@query(f"""WITH {fx.BOXES} SELECT c.doc_id, c.page_idx, c.block_idx, count(*) AS n, '\\begin{{array}}{{l}} ' || string_agg(e.content || ' \\\\ ', '' ORDER BY e.block_idx) || '\\end{{array}}' AS content
FROM fx_boxes c JOIN fx_boxes e ON c.doc_id = e.doc_id AND c.page_idx = e.page_idx AND c.type = 'equation_block' AND e.type = 'equation' AND {_INSIDE} > 0.9 GROUP BY c.doc_id, c.page_idx, c.block_idx HAVING count(*) > 1""")
def equation_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.combined_equations(fx.as_box(fx.boxes(spark, sf_dir)))


@query(f"""WITH {fx.BOXES}, m AS (SELECT c.doc_id, c.block_idx AS outer_idx, e.block_idx FROM fx_boxes c JOIN fx_boxes e ON c.doc_id = e.doc_id AND c.type = 'equation_block' AND e.type = 'equation' AND {_INSIDE} > 0.9),
k AS (SELECT doc_id, outer_idx FROM m GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, block_idx, type FROM fx_boxes b WHERE type != 'equation_block' AND NOT EXISTS (SELECT 1 FROM m JOIN k USING (doc_id, outer_idx) WHERE m.doc_id = b.doc_id AND m.block_idx = b.block_idx)
UNION ALL SELECT doc_id, outer_idx, 'equation' FROM k""")
def equation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.joined_equations(fx.as_box(fx.boxes(spark, sf_dir))).select("doc_id", "block_idx", "type")


@query(f"WITH {fx.BOXES} SELECT doc_id, page_idx, block_idx FROM fx_boxes a WHERE NOT EXISTS (SELECT 1 FROM fx_boxes b WHERE a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.block_idx != b.block_idx AND a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1)")
def drop_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.without_nested(fx.as_box(fx.boxes(spark, sf_dir))).select(*KEY)


def _attached(spark: SparkSession, sf_dir: str, kind: str, role: str) -> DataFrame:
    rows = fx.as_box(fx.blocks(spark, sf_dir))
    return grouping.nearest_bodies(rows.filter(F.col("type") == kind), rows.filter(F.col("type") == f"{kind}_{role}")).select(*KEY, "body_idx")


def _attached_sql(kind: str, role: str) -> str:
    return f"""att AS (SELECT doc_id, page_idx, block_idx, body_idx FROM (SELECT o.doc_id, o.page_idx, o.block_idx, s.block_idx AS body_idx, row_number() OVER (PARTITION BY o.doc_id, o.page_idx, o.block_idx
  ORDER BY abs(o.block_idx - s.block_idx), pow(o.x0 + o.x1 - s.x0 - s.x1, 2) + pow(o.y0 + o.y1 - s.y0 - s.y1, 2), s.block_idx) AS r
  FROM fx_blocks o JOIN fx_blocks s ON o.doc_id = s.doc_id AND o.page_idx = s.page_idx AND s.type = '{kind}' AND o.type = '{kind}_{role}') WHERE r = 1)"""


derived("caption_attach", lambda spark, sf_dir: _attached(spark, sf_dir, "image", "caption"), f"WITH {fx.BLOCKS}, {_attached_sql('image', 'caption')} SELECT * FROM att")
derived("footnote_attach", lambda spark, sf_dir: _attached(spark, sf_dir, "table", "footnote"), f"WITH {fx.BLOCKS}, {_attached_sql('table', 'footnote')} SELECT * FROM att")


@query(f"WITH {fx.BLOCKS} SELECT s.doc_id, s.page_idx, count(o.block_idx) AS n FROM (SELECT DISTINCT doc_id, page_idx FROM fx_blocks WHERE type = 'image') s LEFT JOIN fx_blocks o ON s.doc_id = o.doc_id AND s.page_idx = o.page_idx AND o.type = 'image_caption' GROUP BY ALL")
def caption_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that found a body, by page: all of them where there is one."""
    rows = fx.as_box(fx.blocks(spark, sf_dir))
    found = pairing.paired_by_distance(rows.filter("type = 'image'"), rows.filter("type = 'image_caption'"))
    return found.groupBy("doc_id", "page_idx").agg(F.count("block_idx").alias("n"))


@query(f"WITH {fx.BLOCKS} SELECT s.doc_id, s.page_idx, s.block_idx AS body_idx, coalesce(o.block_idx, -1) AS block_idx FROM fx_blocks s LEFT JOIN fx_blocks o ON s.doc_id = o.doc_id AND s.page_idx = o.page_idx AND o.type = 'image_caption' WHERE s.type = 'image'")
def caption_by_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs themselves; a page of these blocks has one image at most, so that SQL needs no distances."""
    rows = fx.as_box(fx.blocks(spark, sf_dir))
    found = pairing.paired_by_distance(rows.filter("type = 'image'"), rows.filter("type = 'image_caption'"))
    return found.filter("body_idx IS NOT NULL").select("doc_id", "page_idx", "body_idx", F.coalesce("block_idx", F.lit(-1).cast("long")).alias("block_idx"))


_ASOF = f"""{_attached_sql("table", "footnote")},
moved AS (SELECT a.doc_id, a.page_idx, a.block_idx, CASE WHEN a.block_idx >= a.body_idx THEN a.body_idx ELSE (SELECT max(b.block_idx) FROM fx_blocks b WHERE b.doc_id = a.doc_id AND b.page_idx = a.page_idx AND b.type = 'table' AND b.block_idx <= a.block_idx AND b.block_idx != a.body_idx) END AS body_idx FROM att a)"""


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.replaced_footnotes(_attached(spark, sf_dir, "table", "footnote"), fx.blocks(spark, sf_dir).filter("type = 'table'"))


@query(f"WITH {fx.BLOCKS}, {_ASOF} SELECT doc_id, page_idx, block_idx, coalesce(body_idx, -1) AS body_idx FROM moved")
def footnote_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir).withColumn("body_idx", F.coalesce("body_idx", F.lit(-1).cast("long")))


@query(f"""WITH {fx.BLOCKS}, {_attached_sql("table", "caption")}, l AS (SELECT *, lag(block_idx) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx DESC) AS before FROM att),
f AS (SELECT *, CASE WHEN before IS NULL OR block_idx = before - 1 OR (block_idx = before - 2 AND body_idx = before - 1) THEN 1 ELSE 0 END AS ok FROM l)
SELECT doc_id, page_idx, block_idx, body_idx, min(ok) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx DESC) = 1 AS kept FROM f""")
def caption_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.contiguous_captions(_attached(spark, sf_dir, "table", "caption")).select(*KEY, "body_idx", "kept")


@query(f"""WITH {fx.BLOCKS}, {_ASOF}, l AS (SELECT *, lag(block_idx) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx) AS before FROM moved WHERE body_idx IS NOT NULL)
SELECT doc_id, page_idx, block_idx, body_idx, min(CASE WHEN before IS NULL OR block_idx = before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx) = 1 AS kept FROM l""")
def footnote_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.contiguous_footnotes(_moved(spark, sf_dir).filter("body_idx IS NOT NULL")).select(*KEY, "body_idx", "kept")


_LISTED = f"li AS (SELECT e.doc_id, e.page_idx, e.block_idx, e.type, min(c.block_idx) AS list_idx FROM fx_boxes e JOIN fx_boxes c ON c.doc_id = e.doc_id AND c.page_idx = e.page_idx AND c.type = 'list' AND e.type IN ('text', 'ref_text') AND {_INSIDE} >= 0.8 GROUP BY ALL)"


@query(f"WITH {fx.BOXES}, {_LISTED} SELECT doc_id, page_idx, block_idx, type, list_idx FROM li")
def list_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.listed(fx.as_box(fx.boxes(spark, sf_dir)))


@query(f"WITH {fx.BOXES}, {_LISTED} SELECT doc_id, page_idx, list_idx, count(*) AS n, CASE WHEN count(*) FILTER (type = 'ref_text') > count(*) FILTER (type = 'text') THEN 'ref_text' ELSE 'text' END AS sub_type FROM li GROUP BY doc_id, page_idx, list_idx")
def list_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.list_types(grouping.listed(fx.as_box(fx.boxes(spark, sf_dir))))


@query(f"""WITH {fx.BLOCKS}, b AS (SELECT doc_id, page_idx, block_idx AS body_idx, block_idx, 'body' AS role FROM fx_blocks WHERE type = 'table') SELECT body_idx IS NULL AS lost, role, count(*) AS n FROM (
SELECT body_idx, role FROM b UNION ALL SELECT CASE WHEN kept THEN body_idx END, 'caption' FROM (WITH {fx.BLOCKS}, {_attached_sql("table", "caption")}, l AS (SELECT *, lag(block_idx) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx DESC) AS before FROM att),
f AS (SELECT *, CASE WHEN before IS NULL OR block_idx = before - 1 OR (block_idx = before - 2 AND body_idx = before - 1) THEN 1 ELSE 0 END AS ok FROM l)
SELECT body_idx, min(ok) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx DESC) = 1 AS kept FROM f)
UNION ALL SELECT CASE WHEN kept THEN body_idx END, 'footnote' FROM (WITH {fx.BLOCKS}, {_ASOF}, l AS (SELECT *, lag(block_idx) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx) AS before FROM moved)
SELECT body_idx, min(CASE WHEN before IS NULL OR block_idx = before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx) = 1 AS kept FROM l)) GROUP BY ALL""")
def two_layer_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.two_layers(fx.as_box(fx.blocks(spark, sf_dir)), "table")
    return found.groupBy(F.col("body_idx").isNull().alias("lost"), "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, page_idx, block_idx, coalesce(body_idx, -1) AS body_idx, role FROM (
WITH {fx.BLOCKS} SELECT doc_id, page_idx, block_idx, block_idx AS body_idx, 'body' AS role FROM fx_blocks WHERE type = 'table'
UNION ALL SELECT doc_id, page_idx, block_idx, CASE WHEN kept THEN body_idx END, 'caption' FROM (WITH {fx.BLOCKS}, {_attached_sql("table", "caption")}, l AS (SELECT *, lag(block_idx) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx DESC) AS before FROM att),
f AS (SELECT *, CASE WHEN before IS NULL OR block_idx = before - 1 OR (block_idx = before - 2 AND body_idx = before - 1) THEN 1 ELSE 0 END AS ok FROM l)
SELECT *, min(ok) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx DESC) = 1 AS kept FROM f)
UNION ALL SELECT doc_id, page_idx, block_idx, CASE WHEN kept THEN body_idx END, 'footnote' FROM (WITH {fx.BLOCKS}, {_ASOF}, l AS (SELECT *, lag(block_idx) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx) AS before FROM moved)
SELECT *, min(CASE WHEN before IS NULL OR block_idx = before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx, body_idx ORDER BY block_idx) = 1 AS kept FROM l))""")
def two_layer_nest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nest itself, a row for each of its blocks."""
    found = grouping.two_layers(fx.as_box(fx.blocks(spark, sf_dir)), "table")
    return found.select(*KEY, F.coalesce("body_idx", F.lit(-1).cast("long")).alias("body_idx"), "role")


@query(f"WITH {fx.BLOCKS} SELECT doc_id, page_idx, count(*) AS n, string_agg(type, ',' ORDER BY block_idx) AS types FROM fx_blocks GROUP BY doc_id, page_idx")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = grouping.reading_order(fx.blocks(spark, sf_dir).select(*KEY, "type"))
    return pages.select("doc_id", "page_idx", F.size("blocks").cast("long").alias("n"), F.array_join(F.transform("blocks", lambda b: b["type"]), ",").alias("types"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.as_box(fx.blocks(spark, sf_dir)).drop("x0", "y0", "x1", "y1")
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    rows = rows.select("*", none("int", "angle"), none("string", "html"), none("string", "image_path"), none("int", "level"))
    sizes = rows.select("doc_id", "page_idx").distinct().select("*", F.lit(595).alias("width"), F.lit(842).alias("height"))
    return assembly.pages(rows, sizes)


@query(f"WITH {fx.BLOCKS} SELECT doc_id, page_idx, count(*) FILTER (type = 'header') AS discarded FROM fx_blocks GROUP BY doc_id, page_idx")
def discard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page_idx", F.size("discarded_blocks").cast("long").alias("discarded"))


@query()
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with grouped paragraphs: of each type, how many, and how many parts they have."""
    paras = _pages(spark, sf_dir).select(F.explode("para_blocks").alias("p"))
    return paras.groupBy("p.type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("p.blocks"), F.lit(0))).alias("parts"))


def _whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the blocks of all types: tables in HTML, images with their paths, titles with their levels."""
    rows = fx.as_box(fx.blocks(spark, sf_dir)).drop("x0", "y0", "x1", "y1")
    name = tx.image_name(F.col("type"), F.upper(F.md5(F.col("doc_id").cast("string"))), F.col("page_idx"), F.col("bbox"))
    rows = rows.select(
        "*", F.lit(None).cast("int").alias("angle"), F.lit(None).cast("string").alias("html"),
        F.when(F.col("type") == "image", name).alias("image_path"), (F.col("doc_id") % 7).cast("int").alias("level"),
    )
    sizes = rows.select("doc_id", "page_idx").distinct().select("*", F.lit(595).alias("width"), F.lit(842).alias("height"))
    return assembly.pages(layout.with_table_html(rows), sizes, settle=settled)


@query()
def page_assembly_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled paragraphs themselves, with their parts, as JSON."""
    pages = _whole_pages(spark, sf_dir)
    return pages.select("doc_id", "page_idx", F.posexplode(F.concat("para_blocks", "discarded_blocks")).alias("pos", "p")).select("doc_id", "page_idx", "pos", F.to_json("p").alias("para"))


@query()
def doc_markdown_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, from blocks of all types; Markdown has no place for headers."""
    return render.document_markdown(_whole_pages(spark, sf_dir), style=render.Style(images="images"))


@query()
def nlp_markdown_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.document_markdown(_whole_pages(spark, sf_dir), render.NLP_MARKDOWN)


@query()
def content_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = render.content_list(_whole_pages(spark, sf_dir), render.Style(images="images"))
    return found.select("doc_id", "page_idx", "pos", F.to_json("item").alias("item"))


@query()
def content_list_v2_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.content_list_v2(_whole_pages(spark, sf_dir), render.Style(images="images"))


# Text -----------------------------------------------------------------------------------------------------------------


def _text_query(name: str, source: Callable[[], Column], source_sql: str, own: Callable[[Column], Column], sql: str) -> None:
    """A function of a text made of each part; sql is over the column t."""
    derived(
        name,
        lambda spark, sf_dir: fx.table(spark, sf_dir, "part").select("p_partkey", source().alias("t")).select("p_partkey", own(F.col("t")).alias("value")),
        f"WITH s AS (SELECT p_partkey, {source_sql} AS t FROM part) SELECT p_partkey, {sql} AS value FROM s",
    )


_k = lambda n: F.col("p_partkey") % n
_wide = lambda: F.translate(F.concat_ws(" ", "p_brand", "p_name"), tx.NARROW, tx.WIDE)
_WIDE_SQL = f"translate(p_brand || ' ' || p_name, '{tx.NARROW.replace(chr(39), chr(39) * 2)}', '{tx.WIDE}')"
_text_query("full_to_half", _wide, _WIDE_SQL, tx.full_to_half, f"translate(t, '{tx.WIDE}', '{tx.NARROW.replace(chr(39), chr(39) * 2)}')")
_text_query("full_to_half_marks", _wide, _WIDE_SQL, tx.full_to_half_alnum, f"translate(t, '{tx.WIDE_ALNUM}', '{tx.NARROW_ALNUM}')")
_text_query("hyphen_flag", lambda: F.concat("p_name", F.when(_k(3) == 0, "-").when(_k(3) == 1, "- ").otherwise("")), "p_name || CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '- ' ELSE '' END", tx.ends_in_hyphen, "regexp_matches(t, '[A-Za-z]-\\s*$')")
_text_query("detect_lang", lambda: F.when(_k(5) == 0, "").when(_k(5) == 1, F.concat("p_name", F.lit("中"))).when(_k(5) == 2, F.concat("p_name", F.lit("ア"))).when(_k(5) == 3, "한국").otherwise(F.col("p_name")), "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_name || '中' WHEN 2 THEN p_name || 'ア' WHEN 3 THEN '한국' ELSE p_name END", tx.language, "CASE WHEN t = '' THEN '' WHEN contains(t, '中') OR contains(t, 'ア') THEN 'zh' ELSE 'en' END")
_text_query("html_escape", lambda: F.concat(F.lit("<a href=\"x\">'"), "p_name", F.lit("' & co</a>")), "'<a href=\"x\">''' || p_name || ''' & co</a>'", tx.html_escaped, "'&lt;a href=&quot;x&quot;&gt;&#39;' || split_part(t, chr(39), 2) || '&#39; &amp; co&lt;/a&gt;'")
_text_query("code_clean", lambda: F.concat(F.when(_k(2) == 0, "```python\n").otherwise(""), "p_name", F.lit("\n  "), "p_type", F.when(_k(3) == 0, "\n``` ").otherwise("")), "p_name || '|' || p_type", tx.code_cleaned, "split_part(t, '|', 1) || chr(10) || '  ' || split_part(t, '|', 2)")
_text_query("bracket_clean", lambda: F.concat(F.lit("\\["), "p_name", F.when(_k(2) == 0, "\\] and \\[x\\]").otherwise("")), "'\\[' || p_name || CASE p_partkey % 2 WHEN 0 THEN '\\] and \\[x\\]' ELSE '' END", tx.bracket_cleaned, "CASE p_partkey % 2 WHEN 0 THEN replace(replace(t, '\\[', '['), '\\]', ']') ELSE t END")
_text_query("formula_clean", lambda: F.concat(F.when(_k(2) == 0, "\\[\n").otherwise(" "), "p_name", F.when(_k(3) == 0, "\n\\]").otherwise(" ")), "p_name", tx.formula_cleaned, "t")
_text_query("end_token", lambda: F.concat("p_name", F.when(_k(2) == 0, tx.END_TOKEN).otherwise("")), "p_name", tx.without_end_token, "t")
_text_query(
    "inline_split", lambda: F.concat("p_name", F.lit(" \\( x "), "p_brand", F.lit(" \\) "), F.when(_k(3) == 0, "\\(").otherwise("tail")), "p_name || ' \\( x ' || p_brand || ' \\) ' || CASE p_partkey % 3 WHEN 0 THEN '\\(' ELSE 'tail' END",
    lambda t: F.array_join(F.transform(tx.inline_parts(t), lambda p: F.concat_ws("=", p["type"], p["content"])), "|"),
    "CASE p_partkey % 3 WHEN 0 THEN 'text=' || t ELSE 'text=' || split_part(t, '\\(', 1) || '|inline_equation=' || trim(split_part(split_part(t, '\\(', 2), '\\)', 1)) || '|text= tail' END",
)


@query(f"WITH {fx.BLOCKS} SELECT doc_id, page_idx, block_idx, {_NAME} AS name FROM fx_blocks WHERE type = 'image'")
def image_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "image").select(*KEY, F.col("image_path").alias("name"))


_text_query("block_image_name", lambda: F.concat(F.lit("data:image/jpeg;base64,"), F.base64(F.col("p_name").cast("binary"))), "to_base64(encode(p_name))", tx.block_image_name, "sha256(t) || '.jpg'")

# Formulas -------------------------------------------------------------------------------------------------------------

_size = lambda: F.element_at(F.array(*map(F.lit, lx.SIZES)), (_k(16) + 1).cast("int"))
_SIZE_SQL = f"list_extract({list(lx.SIZES)!r}, CAST(p_partkey % 16 + 1 AS INTEGER))"
_mark = lambda: F.element_at(F.array(*map(F.lit, "()|")), (F.floor(F.col("p_partkey") / 16) % 3 + 1).cast("int"))
_MARK_SQL = "list_extract(['(', ')', '|'], CAST(p_partkey // 16 % 3 + 1 AS INTEGER))"
derived(
    "latex_big",
    lambda spark, sf_dir: fx.table(spark, sf_dir, "part").select("p_partkey", lx.sized_delimiters(F.concat(F.lit("a \\"), _size(), F.when(_k(2) == 0, " ").otherwise(""), F.lit("{"), _mark(), F.lit("} b \\bigtimes"))).alias("value")),
    f"SELECT p_partkey, 'a \\\\' || {_SIZE_SQL} || {_MARK_SQL} || ' b \\\\times' AS value FROM part",
)
_text_query("latex_eqcolon", lambda: F.concat("p_name", F.lit(" \\coloneqq \\eqqcolon b")), "p_name", lx.eq_colon, "t || ' := =: b'")
_text_query("latex_lt", lambda: F.concat("p_name", F.lit(" <a< b")), "p_name", lx.less_than, "t || ' < a<  b'")
_text_query("latex_subsup", lambda: F.concat("p_name", F.when(_k(2) == 0, "_{a}_{b{c}} x").otherwise("_{a}^{b} x")), "p_name", lx.double_subscript, "t || CASE p_partkey % 2 WHEN 0 THEN ' x' ELSE '_{a}^{b} x' END")
_text_query("latex_normalize", lambda: F.concat(F.lit(" \\left  ( "), "p_brand", F.lit("\n\n\\right  ) ")), "p_brand", lx.normalised, "'\\left( ' || t || ' \\right)'")
_text_query("latex_brackets", lambda: F.when(_k(2) == 0, F.concat(F.lit("\\["), "p_brand", F.lit("\\]"))).otherwise(F.concat(F.lit(" "), "p_brand")), "p_brand", lambda t: lx.with_brackets(t, "fixed"), "CASE p_partkey % 2 WHEN 0 THEN '\\[' || t || '\\]' ELSE '\\[' || chr(10) || t || chr(10) || '\\]' END")
_text_query("latex_combine", lambda: F.concat_ws("|", F.concat("p_brand", F.lit("\\tag{1}")), F.concat("p_name", F.when(_k(2) == 0, "\\tag {2}").otherwise(""))), "p_brand || '|' || p_name", lambda t: lx.combined(F.split(t, r"\|")), "'\\begin{array}{l} ' || CASE p_partkey % 2 WHEN 0 THEN split_part(t, '|', 1) || '(1) \\\\ ' || split_part(t, '|', 2) || '(2) \\\\ ' ELSE split_part(t, '|', 1) || '\\tag{1} \\\\ ' || split_part(t, '|', 2) || ' \\\\ ' END || '\\end{array}'")
_text_query("latex_braces", lambda: F.concat(F.repeat(F.lit("{"), _k(4).cast("int")), "p_brand", F.lit("\\{ {x} "), F.repeat(F.lit("}"), _k(3).cast("int"))), "p_brand", lx.balanced_braces_udf, "repeat('{', CAST(least(p_partkey % 4, p_partkey % 3) AS INTEGER)) || t || '\\{ {x} ' || repeat('}', CAST(least(p_partkey % 4, p_partkey % 3) AS INTEGER))")
_text_query("latex_leftright", lambda: F.when(_k(3) == 0, F.concat(F.lit("\\left( "), "p_brand")).when(_k(3) == 1, F.concat("p_brand", F.lit("\\right]"))).otherwise(F.concat(F.lit("\\left( "), "p_brand", F.lit(" \\right)"))), "p_brand", lx.matched_left_right_udf, "CASE p_partkey % 3 WHEN 0 THEN '\\left( \\right. ' || t WHEN 1 THEN t || '\\left. \\right]' ELSE '\\left( ' || t || ' \\right)' END")
_text_query("latex_counts", lambda: F.concat(F.repeat(F.lit("\\left("), _k(4).cast("int")), F.repeat(F.lit("\\right|"), _k(3).cast("int"))), "p_brand", lambda t: F.concat_ws(",", lx.count_left(t).cast("string"), lx.count_right(t).cast("string")), "(p_partkey % 4) || ',' || (p_partkey % 3)")

# Tables ---------------------------------------------------------------------------------------------------------------


@query("""SELECT p_brand, '<table>' || string_agg('<tr><td' || CASE WHEN p_size % 3 = 0 THEN ' colspan="2">' || p_name || '</td>' ELSE '>' || p_name || '</td><td>' || p_type || '</td>' END || '</tr>', '' ORDER BY p_partkey) || '</table>' AS html FROM part WHERE p_partkey % 10 = 0 GROUP BY p_brand""")
def otsl_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.markup(spark, sf_dir).select("p_brand", otsl.table_html_udf("otsl").alias("html"))


@query(ORACLE_SQL["otsl_html"].replace(" WHERE p_partkey % 10 = 0", ""))
def otsl_html_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As otsl_html, of every part."""
    return fx.markup(spark, sf_dir, "true").select("p_brand", otsl.table_html_udf("otsl").alias("html"))


@query("""SELECT p_partkey, '<table>' || chr(10) || '  <tr>' || chr(10) || '    <td>' || p_name || '</td>' || chr(10) || '    <td>' || p_type || '</td>' || chr(10) || '  </tr>' || chr(10) || '  <tr>' || chr(10) || '    <td>' || p_brand || '</td>' || chr(10) || '  </tr>' || chr(10) || '</table>' AS html FROM part""")
def table_pipe_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_type", F.lit(" |\n"), "p_brand", F.lit(" | "))
    return fx.table(spark, sf_dir, "part").select("p_partkey", otsl.table_html_udf(text).alias("html"))


@query("""WITH n AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS page_idx, n_nationkey AS key, n_name FROM nation),
g AS (SELECT *, CASE WHEN page_idx = 0 OR key % 4 = 2 OR (key % 5 = 0) != (lag(key) OVER w % 5 = 0) THEN 1 ELSE 0 END AS head FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx)),
i AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY page_idx) AS island FROM g),
h AS (SELECT doc_id, island, '<table><tr><td>name</td><td>key</td></tr>' || string_agg('<tr><td>' || n_name || '</td><td>' || key || '</td></tr>', '' ORDER BY page_idx) || '</table>' AS html FROM i GROUP BY ALL)
SELECT CAST(doc_id AS BIGINT) AS doc_id, page_idx, CASE WHEN head = 1 THEN html ELSE '' END AS html, CASE WHEN head = 1 THEN -1 ELSE page_idx - 1 END AS merged_into FROM i JOIN h USING (doc_id, island)""")
def table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.merge_tables(fx.edge_tables(spark, sf_dir))
    return found.select("doc_id", "page_idx", "html", F.coalesce("merged_into", F.lit(-1).cast("long")).alias("merged_into"))


_text_query(
    "table_kind", lambda: F.concat(F.lit("<table><td"), F.when(_k(3) == 0, " colspan").otherwise(""), F.lit(">"), F.when(_k(4) == 0, "<table>").otherwise("")), "p_name",
    lambda t: F.concat_ws("/", render.table_kind(t)["table_type"], render.table_kind(t)["table_nest_level"].cast("string")),
    "CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN 'complex_table/' ELSE 'simple_table/' END || CASE WHEN p_partkey % 4 = 0 THEN '2' ELSE '1' END",
)


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 9 - 2 > 4 THEN 4 WHEN p_size % 9 - 2 < 1 THEN 0 ELSE p_size % 9 - 2 END AS INTEGER) AS level FROM part")
def title_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_partkey", render.title_level((F.col("p_size") % 9 - 2).cast("int")).alias("level"))


@query(f"""WITH {fx.BLOCKS} SELECT doc_id, page_idx, block_idx, CASE type WHEN 'ref_text' THEN type ELSE 'text' END AS type, trim(content) || CASE WHEN regexp_matches(trim(content), '[A-Za-z]-$') THEN '' ELSE ' ' END AS text,
  CASE WHEN type = 'title' THEN {_LEVEL} ELSE 0 END AS text_level, CAST(trunc(x0 * 1000 / CAST(595 AS DOUBLE)) AS BIGINT) AS left_edge FROM fx_blocks WHERE type IN ('title', 'text', 'ref_text')""")
def content_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paras(_shown(spark, sf_dir, "title", "text", "ref_text"))
    found = render.content_list(rows)
    place = rows.select("doc_id", "page_idx", F.posexplode("para_blocks").alias("pos", "p")).select("doc_id", "page_idx", "pos", F.col("p.index").alias("block_idx"))
    i = F.col("item")
    return found.join(place, ["doc_id", "page_idx", "pos"]).select(*KEY, i["type"].alias("type"), i["text"].alias("text"), F.coalesce(i["text_level"], F.lit(0)).cast("long").alias("text_level"), i["bbox"][0].cast("long").alias("left_edge"))


@query(f"""WITH {fx.BLOCKS} SELECT doc_id, page_idx, '[' || string_agg('{{"type":"' || CASE WHEN type = 'title' AND doc_id % 7 > 0 THEN 'title","content":{{"title_content"' ELSE 'paragraph","content":{{"paragraph_content"' END || ':[{{"type":"text","content":"' ||
  replace(replace(content, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || CASE WHEN regexp_matches(content, '[A-Za-z]-$') THEN '' ELSE ' ' END || '"}}]' || CASE WHEN type = 'title' AND doc_id % 7 > 0 THEN ',"level":' || {_LEVEL} ELSE '' END || '}},"bbox":[' ||
  CAST(trunc(x0 * 1000 / CAST(595 AS DOUBLE)) AS BIGINT) || ',' || CAST(trunc(y0 * 1000 / CAST(842 AS DOUBLE)) AS BIGINT) || ',' || CAST(trunc(x1 * 1000 / CAST(595 AS DOUBLE)) AS BIGINT) || ',' || CAST(trunc(y1 * 1000 / CAST(842 AS DOUBLE)) AS BIGINT) || ']}}', ',' ORDER BY block_idx) || ']' AS items
FROM fx_blocks WHERE type IN ('title', 'text') GROUP BY doc_id, page_idx""")
def content_list_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paras(_shown(spark, sf_dir, "title", "text"))
    found = render.content_list_v2(rows)
    return found.select("doc_id", "page_idx", F.regexp_replace("items", r'"title_content":(\[.*?\]),"level"', '"title_content":$1,"level"').alias("items"))


@query("""WITH s AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, CAST(2 * n / CAST(2 * n + 1 + doc_id % 3 AS DOUBLE) AS DOUBLE) AS similarity, CAST(n AS BIGINT) AS lcs FROM s""")
def markdown_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself with some lines more that it lacks."""
    more = F.concat(F.lit("@first\n"), F.col("text"), F.repeat(F.lit("\n@more"), (F.col("doc_id") % 3).cast("int")))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", compare.compare(F.col("text"), more).alias("c"))
    return rows.select("doc_id", "c.similarity", "c.lcs")
