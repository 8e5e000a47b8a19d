"""Whole runs with a model that answers from the pixels it is given."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.operators import assembly, render
from pageloom.plans import pipeline, runs
from pageloom.sources import files, predict, sinks
from pageloom.sources.config import Config

COLOURS = {"title": (255, 0, 0), "text": (0, 255, 0), "image": (0, 0, 255), "equation": (255, 255, 0), "table": (0, 255, 255)}
#: Of each page: kind, and the box in points of a page of 200 by 100.
PAGES = [[("title", (20, 10, 180, 30)), ("image", (20, 40, 100, 80)), ("text", (20, 85, 24, 86))], [("table", (10, 10, 190, 90))], [("equation", (50, 50, 150, 60)), ("text", (0, 70, 200, 100))]]


class Raster:
    def sizes(self, document):
        return [(200.0, 100.0)] * len(PAGES)

    def render(self, document, page, scale):
        out = np.full((round(100 * scale), round(200 * scale), 3), 255, np.uint8)
        for kind, (x0, y0, x1, y1) in PAGES[page]:
            out[round(y0 * scale) : round(y1 * scale), round(x0 * scale) : round(x1 * scale)] = COLOURS[kind]
        return out


def pixels(data):
    """Of a PNG of png()."""
    width, height = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)


def model(image, prompt):
    shown = pixels(image)
    if prompt == pipeline.PROMPTS["layout"]:
        assert shown.shape == (1036, 1036, 3)
        lines = []
        for kind, colour in COLOURS.items():
            where = np.argwhere((shown == colour).all(2))
            if len(where):
                (y0, x0), (y1, x1) = where.min(0), where.max(0) + 1
                lines.append(f"<|box_start|>{x0 / 1.036:.0f} {y0 / 1.036:.0f} {x1 / 1.036:.0f} {y1 / 1.036:.0f}<|box_end|><|ref_start|>{kind}<|ref_end|>")
        return "\n".join(lines)
    assert min(shown.shape[:2]) >= 28
    seen = next(k for k, c in COLOURS.items() if (shown[shown.shape[0] // 2, shown.shape[1] // 2] == c).all())
    return {"table": "<fcel>cyan<nl>", "equation": "y", "title": "red words", "text": "green words"}[seen] if prompt == pipeline.PROMPTS.get(seen, pipeline.PROMPTS["text"]) else "wrong prompt"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    docs = files.from_bytes(spark, {"a.pdf": b"1", "b.pdf": b"2"})
    return folder, runs.run(docs, Raster, lambda: model, Config(dpi=144), str(folder), compat="fixed")


def test_run_from_pixels(spark, made):
    tmp_path, done = made
    assert done.errors.count() == 0
    names = {r.type: r.image_path for r in done.blocks.filter("doc_id = 'a.pdf'").collect()}
    shown = {r.doc_id: r.markdown for r in done.markdown.collect()}
    assert shown["a.pdf"] == f"# red words\n\ngreen words\n\n![](images/{names['image']})\n\n<table><tr><td>cyan</td></tr></table>\n\ngreen words\n\n$$\ny\n$$"
    assert shown["b.pdf"] == shown["a.pdf"]
    written = {p.name: p.read_bytes() for p in (tmp_path / "images").iterdir()}
    assert {names[k] for k in ("image", "table", "equation")} <= written.keys() and names["text"] is None
    cut = pixels(written[names["image"]])
    assert (cut[2:-2, 2:-2] == COLOURS["image"]).all() and cut.shape[0] == pytest.approx(80, abs=3) and cut.shape[1] == pytest.approx(160, abs=3)
    block = next(d for n, d in written.items() if n.endswith(".png") and n not in names.values())
    assert (pixels(block)[2:-2, 2:-2] == COLOURS["image"]).all()
    documents = {r.doc_id: r for r in done.documents.collect()}
    assert [p.page_idx for p in documents["a.pdf"].pdf_info] == [0, 1, 2] and documents["a.pdf"].pdf_info[0].page_size == [200, 100] and documents["a.pdf"]._backend == "vlm"
    assert {r.pages for r in assembly.total_metrics(done.metrics).collect()} == {3}
    assert assembly.bucket(done.pages, "title").count() == 2
    sinks.results(done.markdown, done.content_list, done.pages, str(tmp_path / "out"), done.documents)
    assert {r.doc_id: r.markdown for r in spark.read.json(str(tmp_path / "out" / "markdown")).collect()} == shown
    assert spark.read.json(str(tmp_path / "out" / "documents")).count() == 2


def test_modes(made):
    pages = made[1].pages.filter("doc_id = 'a.pdf' AND page_idx < 2")
    outputs = {mode: runs.made(pages, mode, render.Style(images="images")).first().output for mode in (render.MARKDOWN, render.NLP_MARKDOWN, render.CONTENT_LIST, render.CONTENT_LIST_V2, "other")}
    assert outputs["other"] is None and outputs[render.MARKDOWN].startswith("# red words") and "<table>" not in outputs[render.NLP_MARKDOWN]
    items = json.loads(outputs[render.CONTENT_LIST])
    assert [i["type"] for i in items] == ["text", "text", "image", "table"] and items[0]["text_level"] == 1 and items[2]["img_path"].startswith("images/")
    assert [[i["type"] for i in page] for page in json.loads(outputs[render.CONTENT_LIST_V2])] == [["title", "paragraph", "image"], ["table"]]


class Failing:
    """Fails with a status at contents of pages with tables, and at the first call of all else."""

    def __init__(self, status):
        self.status, self.calls = status, 0

    def __call__(self, image, prompt):
        self.calls += 1
        if self.calls == 1:
            raise predict.PredictError("busy", status=503)
        if prompt == pipeline.PROMPTS["table"]:
            raise predict.PredictError("table", status=self.status)
        return model(image, prompt)


def test_pages_that_fail(spark):
    docs = files.from_bytes(spark, {"a": b"1"})
    config = Config(dpi=72, page_retries=1, page_concurrency=1)
    done = runs.run(docs, Raster, lambda: Failing(500), config)
    assert [(r.page_idx, r.error) for r in done.errors.collect()] == [(1, "REQUEST: table")]
    assert {r.page_idx for r in done.blocks.collect()} == {0, 2} and done.pages.count() == 3
    for failing, own in ((Failing(400), config), (Failing(500), Config(dpi=72, page_retries=0, skip_failed_pages=False))):
        with pytest.raises(Exception, match="table|busy"):
            runs.run(docs, Raster, lambda failing=failing: failing, own)


def test_sweep(spark):
    got = runs.sweep(files.from_bytes(spark, {"a": b"1"}), Raster, lambda: model, Config(dpi=72, page_limit=1), (2,)).collect()
    assert [(r.page_concurrency, r.pages) for r in got] == [(2, 1)]


def test_requests_of_servers():
    chat = predict.Chat("http://host", model="m", by_prompt={"p": {"top_k": 5}})
    assert [m["role"] for m in chat.body(b"x", "q")["messages"]] == ["user"] and chat.body(None, "q")["top_k"] == 1 and chat.body(None, "p")["top_k"] == 5
    assert chat.body(b"x", "q")["messages"][0]["content"][0]["image_url"]["url"] == files.data_uri(b"x") == "data:image/png;base64,eA=="
    assert predict.Chat("http://host", model="m", system=predict.SYSTEM).body(None, "q")["messages"][0]["role"] == "system"


def test_fitted_is_what_sql_says(spark):
    from pageloom.functions import boxes

    sizes = [(100, 100), (3000, 20), (10, 900), (5, 5), (28, 1400), (27, 1401)]
    rows = spark.createDataFrame(sizes, "w int, h int").select("w", "h", boxes.sized_for_model(F.col("w"), F.col("h")).alias("s")).collect()
    for r in rows:
        assert list(files.fitted(np.zeros((r.h, r.w, 3), np.uint8)).shape[1::-1]) == list(r.s)
    assert hashlib.sha256(files.fitted(np.zeros((4, 400, 3), np.uint8)).tobytes()).hexdigest()
