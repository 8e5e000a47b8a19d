"""Pages as a stream: layout texts are parsed row by row, and a document is whole when all its pages are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import layout

PAGE = "doc_id long, page_idx long, page_count long, raw string, markdown string, ts timestamp"
WHOLE = "doc_id long, pages long, complete boolean, markdown string"


def read(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """JSON lines of PAGE that arrive in a folder."""
    return spark.readStream.schema(PAGE).json(path).withWatermark("ts", late)


def parsed(stream: DataFrame) -> DataFrame:
    """One row per block, in append mode: no state is kept."""
    return stream.select("doc_id", "page_idx", "ts", F.posexplode(layout.page_boxes(F.col("raw"))).alias("block_idx", "b")).select("doc_id", "page_idx", "block_idx", "ts", "b.type", "b.bbox", "b.angle")


def windowed_types(stream: DataFrame, size: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Counts of block types over sliding windows."""
    return parsed(stream).groupBy(F.window("ts", size, step), "type").agg(F.count(F.lit(1)).alias("n"))


def _collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pages, count = (dict(zip(*state.get[:2], strict=True)), state.get[2]) if state.exists else ({}, 0)
    if state.hasTimedOut:
        state.remove()
        yield _whole(key[0], pages, False)
        return
    latest = state.getCurrentWatermarkMs()
    for batch in batches:
        latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
        for row in batch.itertuples():
            pages.setdefault(int(row.page_idx), row.markdown or "")
            count = int(row.page_count)
    if count and len(pages) >= count:
        if state.exists:
            state.remove()
        yield _whole(key[0], pages, True)
        return
    state.update((list(pages), list(pages.values()), count))
    state.setTimeoutTimestamp(latest + WAIT_MS)


WAIT_MS = 600_000


def _whole(doc_id: int, pages: dict[int, str], complete: bool) -> pd.DataFrame:
    text = "\n\n".join(pages[p] for p in sorted(pages) if pages[p])
    return pd.DataFrame({"doc_id": [doc_id], "pages": [len(pages)], "complete": [complete], "markdown": [text]})


def documents(stream: DataFrame) -> DataFrame:
    """A row per document once all its pages arrived, or, marked, when the watermark is WAIT_MS past its last one."""
    state = "pages array<long>, texts array<string>, count long"
    return stream.groupBy("doc_id").applyInPandasWithState(_collect, WHOLE, state, "append", GroupStateTimeout.EventTimeTimeout)
