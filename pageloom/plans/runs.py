"""Runs over documents as files: pages, their layout, crops and contents, images, and what is rendered from them.

A page's pixels stay in its row: one map asks for the layout, SQL reads it, and another map crops, asks for contents and
saves images. Nothing is shuffled until only text is left.
"""

from __future__ import annotations

import base64
import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..operators import assembly, layout, render
from ..schema import NOT_EXTRACTED, PAGE_METRICS
from ..sources import files, sinks
from ..sources.config import Config
from ..sources.predict import Predictor, retryable, with_retries
from . import pipeline

Encode = Callable[[np.ndarray], bytes]
PLACE = ["doc_id", "page_idx", "width", "height", "scale", "page_width", "page_height"]
PHASES = ("render_ms", "encode_ms", "layout_ms", "crop_ms", "content_ms", "image_save_ms", "post_process_ms")


@dataclass
class Run:
    blocks: DataFrame
    pages: DataFrame
    documents: DataFrame
    markdown: DataFrame
    content_list: DataFrame
    errors: DataFrame
    metrics: DataFrame


def _page_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["image"], np.uint8).reshape(row["height"], row["width"], 3)


def _mapped(rows: DataFrame, each: Callable[[], Callable[[dict], dict]], config: Config, schema: str, kept: list[str]) -> DataFrame:
    """rows with what each() makes of every one, page_concurrency of them at a time. A page that fails for good gives its
    error if it may be skipped, and ends the run otherwise."""
    kinds = dict(rows.dtypes)
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = each()

        def one(row: dict) -> dict:
            if row.get("error") is not None:
                return {"error": row["error"]}
            try:
                return with_retries(lambda: own(row), config.page_retries, wait=lambda k: k + 1.0) | {"error": None}
            except Exception as error:
                if config.skip_failed_pages and retryable(error):
                    return {"error": f"{getattr(error, 'code', type(error).__name__)}: {error}"}
                raise

        with ThreadPoolExecutor(config.page_concurrency) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, config.page_concurrency):
                    part = batch.slice(at, config.page_concurrency)
                    found = list(pool.map(one, part.to_pylist()))
                    columns = [part.column(k) for k in kept] + [pa.array([x.get(n) for x in found], to) for n, to in zip(names, types, strict=True)]
                    yield pa.record_batch(columns, names=[*kept, *names])

    types = [{"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[part.split(" ")[1]] for part in schema.split(", ")]
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in kept), schema]))


def _milliseconds(began: float) -> int:
    return round((time.monotonic() - began) * 1000)


def with_layout(images: DataFrame, predictor: Callable[[], Predictor], config: Config, encode: Encode) -> DataFrame:
    """images (schema.PAGE_IMAGE) with raw (the layout text of the page in the layout model's size), error, times."""

    def each() -> Callable[[dict], dict]:
        ask = predictor()

        def one(row: dict) -> dict:
            began = time.monotonic()
            shown = encode(files.stretched(_page_of(row)))
            encoded = _milliseconds(began)
            return {"raw": ask(shown, pipeline.PROMPTS["layout"]), "encode_ms": encoded, "layout_ms": _milliseconds(began) - encoded}

        return one

    return _mapped(images, each, config, "raw string, encode_ms long, layout_ms long, error string", images.columns)


def with_boxes(found: DataFrame) -> DataFrame:
    """found with boxes: type, bbox, angle, crop (pixels), ask (the prompt, if any), name and cut (of the image of its span)."""
    kind = lambda b: F.when(b["type"] == "equation", "interline_equation").otherwise(b["type"])
    points = lambda b: boxes.to_points(b["bbox"], F.col("page_width"), F.col("page_height"))
    pixels = lambda b, i: F.greatest(F.lit(0), F.least((points(b)[i] * F.col("scale")).cast("int"), F.col(("width", "height")[i % 2])))
    ask = lambda b: F.when(b["type"] == "table", pipeline.PROMPTS["table"]).when(b["type"].contains("equation"), pipeline.PROMPTS["equation"]).otherwise(pipeline.PROMPTS["text"])

    def box(b: Column) -> Column:
        return F.struct(
            b["type"].alias("type"), b["bbox"].alias("bbox"), b["angle"].alias("angle"), boxes.crop_pixels(b["bbox"], F.col("width"), F.col("height")).alias("crop"),
            F.when(~b["type"].isin(*NOT_EXTRACTED), ask(b)).alias("ask"), text.image_path(kind(b), F.md5("image"), F.col("page_idx"), points(b)).alias("name"), F.array(*[pixels(b, i).cast("long") for i in range(4)]).alias("cut"),
        )

    return found.withColumn("boxes", F.when(F.col("error").isNull(), F.transform(layout.page_boxes(F.col("raw")), box)))


def with_contents(found: DataFrame, predictor: Callable[[], Predictor], config: Config, folder: str | None, encode: Encode, encode_cut: Encode, ending: str) -> DataFrame:
    """What with_boxes() gives without pixels, with contents and files (the images of blocks), one of each box."""

    def each() -> Callable[[dict], dict]:
        ask, save = predictor(), sinks.writer(folder) if folder else None
        requests = ThreadPoolExecutor(config.request_concurrency)

        def one(row: dict) -> dict:
            page, own = _page_of(row), row["boxes"]
            cropped = lambda b: np.ascontiguousarray(page[b[1] : b[3], b[0] : b[2]])
            began = time.monotonic()
            shown = [encode(files.fitted(cropped(b["crop"]))) if b["ask"] else None for b in own]
            crop_ms, began = _milliseconds(began), time.monotonic()
            contents = list(requests.map(lambda x: ask(*x) if x[0] else None, zip(shown, [b["ask"] for b in own], strict=True)))
            content_ms, began, saved = _milliseconds(began), time.monotonic(), []
            for b in own:
                name = ""
                if save and b["type"] == "image":
                    data = encode(files.fitted(cropped(b["crop"])))
                    name = f"{hashlib.sha256(base64.b64encode(data)).hexdigest()}.{ending}"
                    save(name, data)
                if save and b["name"]:
                    save(b["name"], encode_cut(cropped(b["cut"])))
                saved.append(name)
            return {"contents": contents, "files": saved, "crop_ms": crop_ms, "content_ms": content_ms, "image_save_ms": _milliseconds(began)}

        return one

    kept = [*PLACE, "boxes", "render_ms", "encode_ms", "layout_ms"]
    return _mapped(found, each, config, "contents array<string>, files array<string>, crop_ms long, content_ms long, image_save_ms long, error string", kept)


def run(docs: DataFrame, rasteriser: Callable[[], files.Rasteriser], predictor: Callable[[], Predictor], config: Config = Config(), folder: str | None = None, encode: Encode = files.png, encode_cut: Encode | None = None, ending: str = "png", compat: str = "reference", images: str = "images") -> Run:  # noqa: B008
    """docs: doc_id, content. Images go to folder/images, if there is a folder; spans then have links to them. encode makes
    what models see and what is saved of blocks, encode_cut what is saved of spans."""
    shown = files.pages(docs, rasteriser, config.dpi, limit=config.page_limit)
    target = f"{folder.rstrip('/')}/images" if folder else None
    boxed = with_boxes(with_layout(shown, predictor, config, encode))
    found = pipeline.settled(with_contents(boxed, predictor, config, target, encode, encode_cut or encode, ending))
    each = F.posexplode(F.arrays_zip("boxes", "contents")).alias("block_idx", "b")
    none = lambda kind: F.lit(None).cast(kind)
    path = F.when(F.lit(folder is not None) & (F.col("b.boxes.name") != ""), F.col("b.boxes.name"))
    blocks = found.filter("error IS NULL").select("doc_id", "page_idx", each).select(
        "doc_id", "page_idx", F.col("block_idx").cast("long").alias("block_idx"), "b.boxes.type", "b.boxes.bbox", "b.boxes.angle", F.col("b.contents").alias("content"), none("string").alias("html"), path.alias("image_path"), none("int").alias("level"),
    )
    sizes = found.select("doc_id", "page_idx", F.col("page_width").alias("width"), F.col("page_height").alias("height"))
    results = pipeline.rendered(blocks, sizes, config, compat, images=images)
    metrics = found.select("doc_id", "page_idx", *[F.coalesce(p, F.lit(0)).cast("long").alias(p) if p in found.columns else F.lit(0).cast("long").alias(p) for p in PHASES])
    errors = found.filter("error IS NOT NULL").select("doc_id", "page_idx", "error")
    return Run(results.blocks, results.pages, assembly.documents(results.pages), results.markdown, results.content_list, errors, metrics.select(*[f.name for f in PAGE_METRICS.fields]))


def sweep(docs: DataFrame, rasteriser: Callable[[], files.Rasteriser], predictor: Callable[[], Predictor], config: Config = Config(), concurrency: tuple[int, ...] = (1, 2, 4)) -> DataFrame:  # noqa: B008
    """page_concurrency, pages, total_ms and the milliseconds of each phase, of a run with each number of pages at a time."""
    out = []
    for n in concurrency:
        began = time.monotonic()
        done = run(docs, rasteriser, predictor, replace(config, page_concurrency=n))
        totals = done.metrics.agg(F.count(F.lit(1)).alias("pages"), *[F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in PHASES]).first()
        out.append((n, totals["pages"], _milliseconds(began), *[totals[p] for p in PHASES]))
    return docs.sparkSession.createDataFrame(out, "page_concurrency int, pages long, total_ms long, " + ", ".join(f"{p} long" for p in PHASES))


def made(pages: DataFrame, mode: str, style: render.Style = render.Style()) -> DataFrame:  # noqa: B008
    """doc_id, output: the Markdown, or the JSON of a content list, of each document by the mode's name; null for a mode
    that there is not."""
    if mode in (render.MARKDOWN, render.NLP_MARKDOWN):
        return render.document_markdown(pages, mode, style).select("doc_id", F.col("markdown").alias("output"))
    if mode not in (render.CONTENT_LIST, render.CONTENT_LIST_V2):
        return pages.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("output"))
    if mode == render.CONTENT_LIST:
        parts = render.content_list(pages, style).select("doc_id", F.struct("page_idx", "pos", F.to_json("item").alias("json")).alias("part"))
    else:
        parts = render.content_list_v2(pages, style).select("doc_id", F.struct("page_idx", F.col("items").alias("json")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["json"]), ",")
    lists = parts.groupBy("doc_id").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("output"))
    return pages.select("doc_id").distinct().join(lists, "doc_id", "left").select("doc_id", F.coalesce("output", F.lit("[]")).alias("output"))
