"""Documents as files, and their pages as images. Rasterising and encoding are callables, as no library for either is
assumed; what follows from sizes alone is SQL."""

from __future__ import annotations

import base64
import math
import struct
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import LEAST_EDGE, LONGEST_RATIO
from ..schema import PAGE_IMAGE

LONGEST_SIDE = 3500


class Rasteriser(Protocol):
    def sizes(self, document: bytes) -> list[tuple[float, float]]:
        """Width and height in points of each page."""

    def render(self, document: bytes, page: int, scale: float) -> np.ndarray:
        """Height by width by 3 bytes, on white."""


def documents(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """doc_id (the path), length, content of all files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("doc_id"), "length", "content")


def by_size(spark: SparkSession, path: str, largest: bool = False, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """The one smallest, or largest, document; contents of others are not read."""
    length = F.col("length").desc() if largest else F.col("length").asc()
    return documents(spark, path, pattern).select("doc_id", "length").orderBy(length, "doc_id").limit(1)


def from_bytes(spark: SparkSession, parts: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in parts.items()], "doc_id string, length long, content binary")


def pages(docs: DataFrame, rasteriser: Callable[[], Rasteriser], dpi: int = 200, first: int = 0, last: int | None = None, limit: int = 0) -> DataFrame:
    """schema.PAGE_IMAGE rows of pages first to last; a limit is the same as last = limit - 1. No page beyond is rendered."""
    if limit > 0:
        last = limit - 1

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = rasteriser()
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                sizes = own.sizes(content)
                end = len(sizes) - 1 if last is None or last < 0 else min(last, len(sizes) - 1)
                for page in range(first, end + 1):
                    scale = min(dpi / 72, LONGEST_SIDE / max(sizes[page]))
                    began = time.monotonic()
                    image = own.render(content, page, scale)
                    took = round((time.monotonic() - began) * 1000)
                    (across, down) = sizes[page]
                    yield pd.DataFrame({"doc_id": [doc_id], "page_idx": [page], "width": [image.shape[1]], "height": [image.shape[0]], "scale": [scale], "page_width": [across], "page_height": [down], "image": [image.tobytes()], "render_ms": [took]})

    return docs.select("doc_id", "content").mapInPandas(run, PAGE_IMAGE)


#: What the layout model is shown.
LAYOUT_SIZE = (1036, 1036)


def stretched(image: np.ndarray, width: int = LAYOUT_SIZE[0], height: int = LAYOUT_SIZE[1]) -> np.ndarray:
    """image in another size, without regard to its shape; each pixel is the nearest one."""
    rows = (np.arange(height) + 0.5) * image.shape[0] / height
    columns = (np.arange(width) + 0.5) * image.shape[1] / width
    return image[rows.astype(int)][:, columns.astype(int)]


def padded(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """image in the middle of a white one."""
    out = np.full((max(height, image.shape[0]), max(width, image.shape[1]), 3), 255, np.uint8)
    top, left = (out.shape[0] - image.shape[0]) // 2, (out.shape[1] - image.shape[1]) // 2
    out[top : top + image.shape[0], left : left + image.shape[1]] = image
    return out


def fitted(image: np.ndarray) -> np.ndarray:
    """image as boxes.sized_for_model() says: in the middle of a white one if it is too long, enlarged if too small."""
    height, width = image.shape[:2]
    if max(width, height) / min(width, height) > LONGEST_RATIO:
        image = padded(image, math.ceil(height / LONGEST_RATIO) if width < height else width, math.ceil(width / LONGEST_RATIO) if width >= height else height)
    height, width = image.shape[:2]
    factor = LEAST_EDGE / min(width, height)
    return stretched(image, math.ceil(width * factor), math.ceil(height * factor)) if factor > 1 else image


def data_uri(image: bytes, media: str = "image/png") -> str:
    """A file as text, as servers take it."""
    return f"data:{media};base64,{base64.b64encode(image).decode()}"


def png(image: np.ndarray) -> bytes:
    """An image file of height by width by 3 bytes."""
    height, width, _ = image.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + row.tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def crops(page_blocks: DataFrame, encode: Callable[[np.ndarray], bytes] = png) -> DataFrame:
    """page_blocks: doc_id, page_idx, width, height, image, boxes (array of pixel boxes left, top, right, bottom); a page
    and its boxes travel together. One row per box: doc_id, page_idx, block_idx, image (a file)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                page = np.frombuffer(row.image, np.uint8).reshape(row.height, row.width, 3)
                files = [encode(np.ascontiguousarray(page[b[1] : b[3], b[0] : b[2]])) for b in row.boxes]
                yield pd.DataFrame({"doc_id": row.doc_id, "page_idx": row.page_idx, "block_idx": range(len(files)), "image": files})

    kinds = dict(page_blocks.dtypes)
    return page_blocks.mapInPandas(run, f"doc_id {kinds['doc_id']}, page_idx {kinds['page_idx']}, block_idx long, image binary")
