"""Whole runs: documents to Markdown and content lists, with the models as callables."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex, otsl
from ..operators import assembly, layout, render, tables
from ..sources.config import Config
from ..sources.predict import Predictor, predicted

PROMPTS = {"layout": "\nLayout Detection:", "table": "\nTable Recognition:", "equation": "\nFormula Recognition:", "text": "\nText Recognition:"}


@dataclass
class Results:
    blocks: DataFrame
    pages: DataFrame
    markdown: DataFrame
    content_list: DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that the cluster shares, so that what follows asks no model again and plans stay
    small. Where no folder is set a local session gets one of its own; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
    return df.checkpoint()


def register(spark: SparkSession) -> None:
    """Python functions under names for SQL."""
    spark.udf.register("table_html", otsl.table_html_udf)
    spark.udf.register("balanced_braces", latex.balanced_braces_udf)
    spark.udf.register("matched_left_right", latex.matched_left_right_udf)


def extracted(page_images: DataFrame, predictor: Callable[[], Predictor], config: Config = Config()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Blocks with contents, and errors: the layout of each page first, then the content of each block that needs one.
    page_images: doc_id, page_idx, image (a file, which models are shown whole). A page whose layout fails has no blocks.
    runs.run() starts from pixels and shows the model each block's crop."""
    key = ["doc_id", "page_idx"]
    asked = page_images.select(*key, "image", F.lit(PROMPTS["layout"]).alias("prompt"))
    found = settled(predicted(asked, predictor, key, config.request_concurrency, config.retries))
    blocks = layout.parse(found.select(*key, F.col("content").alias("raw")))
    wanted = layout.to_extract(blocks)
    prompt = F.coalesce(*[F.when(F.col("prompt") == k, v) for k, v in PROMPTS.items()])
    requests = wanted.join(page_images.select(*key, "image"), key).select(*key, "block_idx", "image", prompt.alias("prompt"))
    contents = settled(predicted(requests, predictor, [*key, "block_idx"], config.request_concurrency, config.retries))
    errors = found.select(*key, F.lit(None).cast("long").alias("block_idx"), "error").unionByName(contents.select(*key, "block_idx", "error")).filter("error IS NOT NULL")
    return layout.filled(blocks, contents), errors


def rendered(blocks: DataFrame, sizes: DataFrame, config: Config = Config(), compat: str = "reference", simple: bool = False, images: str = "images") -> Results:  # noqa: B008
    """sizes: doc_id, page_idx, width, height of every page."""
    done = layout.post_processed(blocks, simple=simple, join_equations=config.join_equations, without_lists=config.without_lists, without_paratext=config.without_paratext, compat=compat)
    done = settled(done)
    pages = settled(assembly.pages(done, sizes, compat))
    if config.merge_tables and config.tables:
        pages = with_merged_tables(pages)
    style = render.Style(config.formulas, config.tables, images)
    return Results(done, pages, render.document_markdown(pages, style=style), render.content_list(pages, style))


def with_merged_tables(pages: DataFrame) -> DataFrame:
    """pages with tables that go on over pages merged. Only tables at the edges of pages leave their rows."""
    n = F.size("para_blocks")
    at = lambda p: p["type"] == "table"
    edge = F.filter(F.array(F.struct(F.lit(True).alias("is_first"), (n == 1).alias("is_last"), F.get("para_blocks", F.lit(0)).alias("p")), F.struct((n == 1).alias("is_first"), F.lit(True).alias("is_last"), F.get("para_blocks", n - 1).alias("p"))), lambda e, i: at(e["p"]) & ((i == 0) | (n > 1)))
    edges = pages.filter(n > 0).select("doc_id", "page_idx", F.explode(edge).alias("e"))
    parts = lambda kind: F.transform(F.filter("e.p.blocks", lambda b: b["type"] == kind), lambda b: render.para_text(b["lines"]))
    html = F.coalesce(F.try_element_at(F.flatten(F.transform(F.filter("e.p.blocks", lambda b: b["type"] == "table_body"), lambda b: F.transform(F.flatten(F.transform(b["lines"], lambda line: line["spans"])), lambda s: s["html"]))), F.lit(1)), F.lit(""))
    edges = edges.select("doc_id", "page_idx", "e.is_first", "e.is_last", F.col("e.p.bbox")[0].alias("x0"), F.col("e.p.bbox")[2].alias("x1"), html.alias("html"), parts("table_caption").alias("captions"), parts("table_footnote").alias("footnotes"))
    merged = tables.merge_tables(edges).select("doc_id", "page_idx", "is_first", F.struct("html", F.col("merged_into").isNotNull().alias("gone")).alias("t"))
    first = merged.filter("is_first").select("doc_id", "page_idx", F.col("t").alias("t_first"))
    last = merged.filter("NOT is_first").select("doc_id", "page_idx", F.col("t").alias("t_last"))
    joined = pages.join(first, ["doc_id", "page_idx"], "left").join(last, ["doc_id", "page_idx"], "left")

    def put(p, t):  # noqa: ANN001, ANN202
        span = lambda s: s.withField("html", F.when(s["type"] == "table", t["html"]).otherwise(s["html"]))
        lines = lambda b: F.transform(b["lines"], lambda line: line.withField("spans", F.transform(line["spans"], span)))
        block = lambda b: b.withField("lines", F.when(t["gone"], F.slice(b["lines"], F.lit(1), F.lit(0))).when(b["type"] == "table_body", lines(b)).otherwise(b["lines"]))
        return p.withField("blocks", F.transform(p["blocks"], block))

    own = F.transform("para_blocks", lambda p, i: F.when((i == 0) & F.col("t_first").isNotNull(), put(p, F.col("t_first"))).when((i == F.size("para_blocks") - 1) & F.col("t_last").isNotNull(), put(p, F.col("t_last"))).otherwise(p))
    return joined.withColumn("para_blocks", own).select(*pages.columns)
