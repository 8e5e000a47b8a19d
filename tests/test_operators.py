from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators import assembly, grouping, layout, pairing, render, tables
from pageloom.plans import pipeline
from pageloom.schema import BLOCK, PAGE
from pageloom.sources.config import Config


def blocks(spark, *rows):
    return spark.createDataFrame([(1, 0, i, t, [float(v) for v in box], 0, content, None, None, None) for i, (t, box, content) in enumerate(rows)], BLOCK)


def line(box, kind, tail=""):
    return f"<|box_start|>{box}<|box_end|><|ref_start|>{kind}<|ref_end|>{tail}"


def test_layout(spark):
    raw = "\n".join([line("0 0 1000 1000", "Text", "<|rotate_right|>"), "", line("0 0 1001 5", "text"), line("5 5 5 9", "text"), line("1.2.3 0 5 5", "text"), line("900 800 100.9 200", "title"), line("0 0 1 1", "text") + "\r", "junk"])
    rows = layout.parse(spark.createDataFrame([(1, 0, raw)], "doc_id long, page_idx long, raw string")).orderBy("block_idx").collect()
    assert [(r.block_idx, r.type, r.angle, r.bbox) for r in rows] == [(0, "text", 90, [0, 0, 1, 1]), (1, "title", 0, [0.1, 0.2, 0.9, 0.8])]


def test_equations(spark):
    page = blocks(spark, ("equation_block", (0, 0, 1, 1), None), ("equation", (0.1, 0.1, 0.9, 0.4), "a=1"), ("equation", (0.1, 0.5, 0.9, 0.9), "b=2"), ("equation_block", (0, 0, 0.2, 0.2), None))
    got = layout.post_processed(page, join_equations=True, compat="fixed").collect()
    assert [(r.type, r.block_idx) for r in got] == [("equation", 0)]
    assert "\\begin{array}{l} a=1 \\\\ b=2 \\\\ \\end{array}" in got[0].content
    simple = layout.post_processed(page, simple=True)
    assert simple.count() == 4


def test_table_html_preferred(spark):
    page = blocks(spark, ("table", (0, 0, 1, 1), "<fcel>A<fcel>B<nl>")).withColumn("html", F.lit("<table>own</table>"))
    assert layout.with_table_html(page).first().html == "<table>own</table>"
    assert layout.with_table_html(page.withColumn("html", F.lit(None).cast("string"))).first().html.startswith("<table><tr><td>A")


def test_nested_boxes_that_coincide(spark):
    page = blocks(spark, ("image", (0, 0, 4, 4), None), ("image", (0, 0, 4, 4), None), ("image", (5, 5, 6, 6), None))
    assert [r.block_idx for r in grouping.without_nested(page).collect()] == [2]
    assert sorted(r.block_idx for r in grouping.without_nested(page, "fixed").collect()) == [0, 2]


def test_footnotes_and_captions(spark):
    key = "doc_id long, page_idx long, block_idx long, body_idx long"
    got = grouping.contiguous_captions(spark.createDataFrame([(1, 0, i, 3) for i in (0, 2, 4)], key)).collect()
    assert {r.block_idx: r.kept for r in got} == {4: True, 2: True, 0: False}
    notes = grouping.replaced_footnotes(spark.createDataFrame([(1, 0, 1, 2), (1, 0, 3, 2), (2, 0, 0, 1)], key), spark.createDataFrame([(1, 0, 0), (1, 0, 2), (2, 0, 1)], "doc_id long, page_idx long, block_idx long"))
    assert {(r.doc_id, r.block_idx): r.body_idx for r in notes.collect()} == {(1, 1): 0, (1, 3): 2, (2, 0): None}


def test_pages_and_markdown(spark):
    page = blocks(
        spark, ("title", (0.1, 0, 0.9, 0.1), "T"), ("image", (0.1, 0.1, 0.9, 0.3), None), ("image_caption", (0.1, 0.3, 0.9, 0.35), "Figure 1"), ("list", (0, 0.4, 1, 0.6), "x"),
        ("text", (0.1, 0.41, 0.9, 0.45), "one"), ("ref_text", (0.1, 0.5, 0.9, 0.55), "two"), ("code", (0, 0.6, 1, 0.7), "```\nx = 1\n```"), ("text", (0, 0.8, 1, 0.9), r"see \(x^2\) here"),
        ("header", (0, 0.95, 1, 1), "h"), ("equation", (0, 0.9, 1, 0.95), r"\[ y \]"), ("unheard", (0, 0, 0.01, 0.01), "gone"),
    ).withColumn("image_path", F.when(F.col("type") == "image", "a.jpg"))
    sizes = spark.createDataFrame([(1, 0, 1000, 1000), (1, 1, 1000, 1000)], "doc_id long, page_idx long, width int, height int")
    pages = assembly.pages(page, sizes).cache()
    first = pages.filter("page_idx = 0").first()
    assert [p.type for p in first.para_blocks] == ["title", "image", "list", "code", "text", "interline_equation"]
    assert [p.type for p in first.discarded_blocks] == ["header"]
    assert first.para_blocks[2].sub_type == "text" and [b.type for b in first.para_blocks[2].blocks] == ["text", "ref_text"]
    text = render.document_markdown(pages, style=render.Style(images="img")).first().markdown
    assert text == "# T\n\n![](img/a.jpg)  \nFigure 1\n\none   \ntwo\n\n```en\nx = 1 \n```\n\nsee $x^2$ here\n\n$$\ny\n$$"
    assert "a.jpg" not in render.document_markdown(pages, render.NLP_MARKDOWN).first().markdown
    items = [r.j for r in render.content_list(pages).select(F.to_json("item").alias("j")).collect()]
    assert len(items) == 7 and '"type":"list","sub_type":"text","list_items":["one ","two "]' in items[2]
    v2 = {r.page_idx: r["items"] for r in render.content_list_v2(pages).collect()}
    assert v2[1] == "[]" and '"equation_inline"' in v2[0] and '"list_type":"text_list"' in v2[0]


def test_hyphen_joins_lines(spark):
    span = lambda t: [("text", t, None, None)]
    para = ("text", None, None, None, 0, [0.0] * 4, [(span("exam-"),), (span("ple of"),), (span("Well-"),), (span("Known"),)], None)
    page = spark.createDataFrame([(1, 0, 10, 10, [para], [])], PAGE)
    assert render.document_markdown(page).first().markdown == "example of Well-Known"


def test_empty(spark):
    none = spark.createDataFrame([], BLOCK)
    sizes = spark.createDataFrame([], "doc_id long, page_idx long, width int, height int")
    got = pipeline.rendered(none, sizes)
    assert got.markdown.count() == 0 and got.content_list.count() == 0


def _table(page, rows, **more):
    html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    return tables.Table(page, True, True, 0, 100, html, more.get("captions", []), more.get("footnotes", []))


def test_table_merge():
    got = tables.merge_document([_table(0, ["ab", "12"]), _table(1, ["ab", "34"], captions=["Tab (continued)"]), _table(2, ["56"], footnotes=["n"])])
    assert tables.read_rows(got[0].html) == tables.read_rows(_table(0, ["ab", "12", "34", "56"]).html)
    assert (got[1].merged_into, got[2].merged_into, got[0].crossed) == (0, 1, ["n"])
    assert tables.merge_document([_table(0, ["ab"], footnotes=["f"]), _table(1, ["cd"])])[1].merged_into is None
    assert tables.merge_document([_table(0, ["ab"]), _table(1, ["cd"], captions=["Table 2"])])[1].merged_into is None
    wide = _table(1, ["cd"])
    wide.x1 = 150
    assert tables.merge_document([_table(0, ["ab"]), wide])[1].merged_into is None
    got = tables.merge_document([_table(0, ["abc", "12"]), _table(1, ["34"])])
    assert [len(r) for r in tables.read_rows(got[0].html)] == [3, 2, 2]
    got = tables.merge_document([_table(0, ["abc", "123"]), _table(1, ["abc", "34"])])
    assert got[0].html.endswith('<tr><td>3</td><td colspan="1">4</td></tr></table>')


def test_whole_run(spark):
    cells = "<fcel>A<fcel>B<nl><fcel>{}<fcel>2<nl>"
    rows = [(1, p, i, t, [0.1, 0.1 + i / 10, 0.9, 0.18 + i / 10], 0, c, None, None, None) for p, i, t, c in ((0, 0, "title", "T"), (0, 1, "table", cells.format(1)), (1, 0, "table", cells.format(3)), (1, 1, "text", "end"))]
    sizes = spark.createDataFrame([(1, 0, 600, 800), (1, 1, 600, 800)], "doc_id long, page_idx long, width int, height int")
    got = pipeline.rendered(spark.createDataFrame(rows, BLOCK), sizes, Config(), compat="fixed").markdown.first().markdown
    assert got == "# T\n\n<table><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>2</td></tr></table>\n\nend"


def test_filters(spark):
    page = blocks(spark, ("text", (0, 0, 1, 1), " "), ("image", (0, 0, 1, 1), None), ("list", (0, 0, 1, 1), "x"), ("footer", (0, 0, 1, 1), "x"), ("equation_block", (0, 0, 1, 1), "x"))
    assert [r.type for r in layout.filtered(page, without_empty=True).collect()] == ["image", "list", "footer"]
    assert [r.type for r in layout.filtered(page, without_lists=True, without_paratext=True).collect()] == ["text", "image"]
    assert isinstance(page.schema["bbox"].dataType, T.ArrayType)


def test_pairing_by_distance():
    bodies = [(0, 0, 10, 10), (0, 100, 10, 110)]
    assert pairing.pair(bodies, [(0, 12, 10, 14), (0, 112, 10, 114), (0, 115, 10, 116)]) == {0: [0], 1: [1, 2]}
    assert pairing.pair(bodies, []) == {0: [], 1: []} and pairing.pair([], [(0, 0, 1, 1)]) == {}


def test_delimiters():
    style = render.Style().with_delimiters({"display": {"left": "[", "right": "]"}, "inline": {"left": "(", "right": ")"}})
    assert (style.display, style.inline) == (("[", "]"), ("(", ")")) and render.Style().with_delimiters(None) == render.Style()
