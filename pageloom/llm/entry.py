"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_pii, op2_mix, op3_lm, op4_near, op5_warc, op6_imatch, op7_exact, op8_html, op9_bpe, op10_toxic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii.query,
    "op2_mix": op2_mix.query,
    "op3_context_mixing": op3_lm.query,
    "op4_near_dedup": op4_near.query,
    "op5_warc_revisits": op5_warc.query,
    "op6_imatch": op6_imatch.query,
    "op7_exact_dedup": op7_exact.query,
    "op8_html_text": op8_html.query,
    "op9_byte_bpe": op9_bpe.query,
    "op10_toxicity": op10_toxic.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_near_dedup": op4_near.SQL,
    "op5_warc_revisits": op5_warc.SQL,
    "op7_exact_dedup": op7_exact.SQL,
}
