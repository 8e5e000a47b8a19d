"""Schemas of the stages: every stage states its types, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BOX = T.ArrayType(_D)
#: One layout element of a page; block_idx is its place in reading order.
BLOCK = _struct(doc_id=_L, page_idx=_L, block_idx=_L, type=_S, bbox=BOX, angle=_I, content=_S, html=_S, image_path=_S, level=_I)
SPAN = _struct(type=_S, content=_S, html=_S, image_path=_S)
LINE = _struct(spans=T.ArrayType(SPAN))
#: A part of a paragraph that has a body, captions and footnotes; or an item of a list.
PART = _struct(type=_S, index=_L, bbox=BOX, lines=T.ArrayType(LINE))
PARA = _struct(type=_S, sub_type=_S, guess_lang=_S, level=_I, index=_L, bbox=BOX, lines=T.ArrayType(LINE), blocks=T.ArrayType(PART))
PAGE = _struct(doc_id=_L, page_idx=_L, width=_I, height=_I, para_blocks=T.ArrayType(PARA), discarded_blocks=T.ArrayType(PARA))
#: Pixels of a page, and its size in points.
PAGE_IMAGE = _struct(doc_id=_S, page_idx=_I, width=_I, height=_I, scale=_D, page_width=_D, page_height=_D, image=T.BinaryType(), render_ms=_L)
PAGE_METRICS = _struct(doc_id=_L, page_idx=_L, render_ms=_L, encode_ms=_L, layout_ms=_L, crop_ms=_L, content_ms=_L, image_save_ms=_L, post_process_ms=_L)
VERSION = "2.7.1"
BACKEND = "vlm"

# The block types of the data model.
TEXT_LIKE = ("text", "title", "header", "footer", "page_number", "aside_text", "page_footnote", "ref_text", "list", "index", "phonetic", "image_caption", "image_footnote", "table_caption", "table_footnote", "code_caption")
DISCARDED = ("header", "footer", "page_number", "aside_text", "page_footnote")
PARATEXT = ("header", "footer", "page_number")
NOT_EXTRACTED = ("image", "list", "equation_block")
BUCKETS = ("image", "table", "code", "ref_text", "phonetic", "title", "text", "interline_equation", "list")
