import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.sources import files, predict, sinks
from pageloom.sources.config import Config
from pageloom.plans import pipeline


def test_config():
    env = {"X_TIMEOUT": "abc", "X_RETRIES": "2.9", "X_FORMULAS": "no", "X_TABLES": "YES", "X_MODEL": " ", "X_END_TOKEN": "", "X_PAGE_LIMIT": "-1"}
    got = Config.from_env("X_", env)
    assert (got.timeout, got.retries, got.formulas, got.tables, got.model, got.end_token, got.page_limit) == (600.0, 2, False, True, None, "", 0)


class Raster:
    def sizes(self, document):
        return [(72.0, 36.0)] * document[0]

    def render(self, document, page, scale):
        return np.full((round(36 * scale), round(72 * scale), 3), page, np.uint8)


def test_pages_and_crops(spark, tmp_path):
    docs = files.from_bytes(spark, {"a": b"\x03", "b": b"\x01"})
    got = files.pages(docs, Raster, dpi=72, limit=2).orderBy("doc_id", "page_idx").collect()
    assert [(r.doc_id, r.page_idx, r.width, r.height) for r in got] == [("a", 0, 72, 36), ("a", 1, 72, 36), ("b", 0, 72, 36)]
    pages = files.pages(docs, Raster, dpi=72).withColumn("boxes", F.array(F.array(*map(F.lit, (0, 0, 10, 5)))))
    crop = files.crops(pages)
    assert crop.count() == 4 and crop.first().image[:4] == b"\x89PNG"
    sinks.images(crop.select(F.concat(F.sha2("image", 256), F.lit(".png")).alias("name"), "image"), str(tmp_path / "images"))
    assert len(list((tmp_path / "images").iterdir())) == 3
    for name, size in (("s.pdf", 3), ("l.PDF", 9), ("x.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert files.by_size(spark, str(tmp_path)).first().length == 3
    assert files.by_size(spark, str(tmp_path), largest=True).first().length == 9


def answer(image, prompt):
    if prompt == "bad":
        raise predict.PredictError("no", status=400)
    return prompt.upper()


def test_predicted(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "bad"), (3, bytearray(b"x"), "c")], "id long, image binary, prompt string")
    got = {r.id: (r.content, r.error) for r in predict.predicted(rows, lambda: answer, ["id"]).collect()}
    assert got[1] == ("A", None) and got[3] == ("C", None) and got[2][0] == "" and "no" in got[2][1]


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise predict.PredictError("busy", status=503)
        return "ok"

    assert predict.with_retries(flaky, 3, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(predict.PredictError):
        predict.with_retries(lambda: (_ for _ in ()).throw(predict.PredictError("x", status=400)), 3, sleep=lambda s: None)
    assert predict.retryable(Exception(predict.EMPTY)) and not predict.retryable(ValueError("x"))


def model(image, prompt):
    if "Layout" in prompt:
        return "<|box_start|>0 0 500 100<|box_end|><|ref_start|>title<|ref_end|>\n<|box_start|>0 200 900 300<|box_end|><|ref_start|>table<|ref_end|>"
    return "<fcel>a<nl>" if "Table" in prompt else "Hello"


def test_extraction(spark):
    images = spark.createDataFrame([(1, 0, bytearray(b"i"))], "doc_id long, page_idx long, image binary")
    blocks, errors = pipeline.extracted(images, lambda: model)
    sizes = images.select("doc_id", "page_idx", F.lit(100).alias("width"), F.lit(100).alias("height"))
    assert errors.count() == 0
    assert pipeline.rendered(blocks, sizes).markdown.first().markdown == "# Hello\n\n<table><tr><td>a</td></tr></table>"
