"""Queries that take every row of their tables."""

import html
import json
import re

import __spark_entry__
from pageloom.plans import fixtures as fx
from pageloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def test_markup_of_every_part(spark):
    got = plans.QUERIES["otsl_html_all"](spark, DATA).collect()
    assert sum(r.html.count("<tr>") for r in got) == fx.table(spark, DATA, "part").count()
    assert "%" not in plans.ORACLE_SQL["otsl_html_all"].replace("p_size % 3", "")


def _bare(text):
    return re.sub(r"\s+", "", text)


def _pieces(kind, content):
    """What must be seen of a line: a table's cells may stand apart, a hyphen at the end may go."""
    return [_bare(c).rstrip("-") for c in (content.split("|") if kind == "table" else [content])]


def _lines(spark):
    """Of each document: type and content of its lines, by Python alone."""
    rows = fx.table(spark, DATA, "documents").select("doc_id", "text").collect()
    return {r.doc_id: [(fx.TYPES[(r.doc_id * 7 + i) % 12], x) for i, x in enumerate(r.text.split("\n"))] for r in rows}


def test_markdown_of_every_block(spark):
    wanted = _lines(spark)
    got = {r.doc_id: r.markdown for r in __spark_entry__.entry(spark).collect()}
    assert got.keys() == wanted.keys()
    for doc, lines in wanted.items():
        shown = _bare(re.sub(r"</?t\w+[^>]*>", "", html.unescape(got[doc])))
        assert got[doc].count("![](images/") == sum(t == "image" for t, _ in lines)
        for kind, content in lines:
            if kind not in ("image", "header"):
                assert all(c in shown for c in _pieces(kind, content)), (doc, kind, content)


def test_content_lists_of_every_block(spark):
    wanted = _lines(spark)
    items = plans.QUERIES["content_list_all"](spark, DATA).collect()
    v2 = plans.QUERIES["content_list_v2_all"](spark, DATA).collect()
    for texts in ([(r.doc_id, [json.loads(r.item)]) for r in items], [(r.doc_id, json.loads(r["items"])) for r in v2]):
        of_doc = {}
        for doc, found in texts:
            of_doc[doc] = of_doc.get(doc, "") + _bare(re.sub(r"</?t\w+[^>]*>|\\n", "", html.unescape(json.dumps(found, ensure_ascii=False))))
        assert of_doc.keys() == wanted.keys()
        for doc, lines in wanted.items():
            for kind, content in lines:
                if kind != "image":
                    assert all(c in of_doc[doc] for c in _pieces(kind, json.dumps(content, ensure_ascii=False)[1:-1])), (doc, kind, content)


def test_assembled_blocks_hold_every_block_once(spark):
    got = []
    for r in plans.QUERIES["page_assembly_blocks"](spark, DATA).collect():
        p = json.loads(r.para)
        got += [(r.doc_id, r.page_idx, b["index"]) for b in p.get("blocks") or [p]]
    wanted = [(r.doc_id, r.page_idx, r.block_idx) for r in fx.blocks(spark, DATA).collect()]
    assert sorted(got) == sorted(wanted)


def test_pairs_name_the_blocks(spark):
    kinds = {(r.doc_id, r.page_idx, r.block_idx): r.type for r in fx.blocks(spark, DATA).collect()}
    for r in plans.QUERIES["caption_by_distance_pairs"](spark, DATA).collect():
        assert kinds[r.doc_id, r.page_idx, r.body_idx] == "image"
        assert r.block_idx == -1 or kinds[r.doc_id, r.page_idx, r.block_idx] == "image_caption"
