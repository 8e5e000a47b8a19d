"""Markdown and JSON content lists from pages of paragraphs (schema.PAGE), as expressions on one row per page; only the
joining of a document's pages shuffles."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.text import ends_in_hyphen, full_to_half_alnum, language, trimmed

MARKDOWN, NLP_MARKDOWN, CONTENT_LIST, CONTENT_LIST_V2 = "mm_markdown", "nlp_markdown", "content_list", "content_list_v2"
PLAIN = ("text", "interline_equation", "phonetic", "ref_text")


@dataclass(frozen=True)
class Style:
    formulas: bool = True
    tables: bool = True
    images: str = ""
    inline: tuple[str, str] = ("$", "$")
    display: tuple[str, str] = ("$$", "$$")

    def with_delimiters(self, settings: dict | None) -> Style:
        """Formula marks from settings of the form {"display": {"left", "right"}, "inline": {"left", "right"}}."""
        if not settings:
            return self
        marks = {kind: (settings[kind]["left"], settings[kind]["right"]) for kind in ("display", "inline")}
        return replace(self, **marks)


def _is(kind: str):  # noqa: ANN202
    return lambda x: x["type"] == kind


def _each(items: Column, own) -> Column:  # noqa: ANN001
    return F.array_join(F.transform(F.coalesce(items, F.array()), own), "")


def _language(lines: Column) -> Column:
    texts = F.flatten(F.transform(lines, lambda line: F.transform(F.filter(line["spans"], _is("text")), lambda s: full_to_half_alnum(s["content"]))))
    return language(F.replace(F.array_join(texts, ""), F.lit("\n"), F.lit("")))


def _joins_next(lines: Column, i: Column) -> Column:
    """Whether the next line goes on with a small letter."""
    first = F.get(F.get(lines, i + 1)["spans"], F.lit(0))
    return F.coalesce((first["type"] == "text") & first["content"].rlike("^[a-z]"), F.lit(False))


def para_text(lines: Column, style: Style = Style()) -> Column:  # noqa: B008
    """A paragraph's spans as one text: half-width letters, words apart except in Chinese and after a broken word."""
    lines = F.coalesce(lines, F.array())
    chinese = _language(lines) == "zh"

    def piece(line: Column, i: Column, s: Column, j: Column) -> Column:
        shown = F.when(s["type"] == "text", full_to_half_alnum(s["content"])).when(s["type"] == "inline_equation", F.concat(F.lit(style.inline[0]), s["content"], F.lit(style.inline[1])))
        if style.formulas:
            shown = shown.when(s["type"] == "interline_equation", F.concat(F.lit(f"{style.display[0]}\n"), s["content"], F.lit(f"\n{style.display[1]}")))
        else:
            shown = shown.when((s["type"] == "interline_equation") & (s["image_path"] != ""), F.concat(F.lit(f"![]({style.images}/"), s["image_path"], F.lit(")")))
        own = trimmed(F.coalesce(shown, F.lit("")))
        last = j == F.size(line["spans"]) - 1
        apart = F.concat(own, F.lit(" "))
        broken = last & (s["type"] == "text") & ends_in_hyphen(own)
        western = F.when(broken, F.when(_joins_next(lines, i), F.substring(own, F.lit(1), F.length(own) - 1)).otherwise(own)).otherwise(apart)
        return F.when((own == "") | (s["type"] == "interline_equation"), own).when(chinese, F.when(last & (s["type"] != "inline_equation"), own).otherwise(apart)).otherwise(western)

    return F.array_join(F.flatten(F.transform(lines, lambda line, i: F.transform(line["spans"], lambda s, j: piece(line, i, s, j)))), "")


def para_spans(lines: Column, phonetic: Column) -> Column:
    """A paragraph's spans as array of (type, content), texts that follow each other as one."""
    lines = F.coalesce(lines, F.array())
    chinese = _language(lines) == "zh"
    kind = "array<struct<type: string, content: string>>"

    def own(line: Column, i: Column, s: Column, j: Column) -> Column:
        content = F.when(s["type"] == "text", full_to_half_alnum(s["content"])).otherwise(s["content"])
        last = j == F.size(line["spans"]) - 1
        broken = last & ends_in_hyphen(content)
        apart = F.concat(content, F.lit(" "))
        text = F.when(chinese, F.when(last, content).otherwise(apart)).when(broken, F.when(_joins_next(lines, i), F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content)).otherwise(apart)
        type_ = F.when(s["type"] == "inline_equation", "equation_inline").when((s["type"] == "text") & phonetic, "phonetic").when(s["type"] == "text", "text")
        blank = F.coalesce(trimmed(s["content"]), F.lit("")) == ""
        return F.struct(F.when(~blank, type_).alias("type"), F.when(type_ == "text", text).otherwise(content).alias("content"))

    spans = F.flatten(F.transform(lines, lambda line, i: F.transform(line["spans"], lambda s, j: own(line, i, s, j))))
    spans = F.filter(spans, lambda s: s["type"].isNotNull()).cast(kind)

    def add(done: Column, s: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))
        same = F.coalesce((before["type"] == "text") & (s["type"] == "text"), F.lit(False))
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(before["type"].alias("type"), F.concat(before["content"], s["content"]).alias("content"))))
        return F.when(same, longer).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), add)


def title_level(level: Column) -> Column:
    own = F.coalesce(level, F.lit(1))
    return F.when(own > 4, 4).when(own < 1, 0).otherwise(own)


def _parts(p: Column, kind: str) -> Column:
    return F.filter(F.coalesce(p["blocks"], F.array()), _is(kind))


def _spans(parts: Column, kind: str) -> Column:
    return F.filter(F.flatten(F.flatten(F.transform(parts, lambda b: F.transform(F.coalesce(b["lines"], F.array()), lambda line: line["spans"])))), _is(kind))


def para_markdown(p: Column, mode: str = MARKDOWN, style: Style = Style()) -> Column:  # noqa: B008
    """One paragraph; blank where the mode leaves it out."""
    text = lambda b: para_text(b["lines"])
    link = lambda s: F.concat(F.lit(f"![]({style.images}/"), s["image_path"], F.lit(")"))
    linked = lambda s: F.coalesce(s["image_path"], F.lit("")) != ""
    styled = para_text(p["lines"], style)
    items = _each(p["blocks"], lambda b: F.concat(para_text(b["lines"], style), F.lit("  \n")))
    title = F.concat(F.repeat(F.lit("#"), title_level(p["level"])), F.lit(" "), para_text(p["lines"]))
    out = F.when(p["type"].isin(*PLAIN), styled).when(p["type"] == "list", items).when(p["type"] == "title", title)
    if mode == MARKDOWN:
        picture = _each(F.filter(_spans(_parts(p, "image_body"), "image"), linked), link)
        captions, notes = _parts(p, "image_caption"), _parts(p, "image_footnote")
        before = F.concat(_each(captions, lambda b: F.concat(text(b), F.lit("  \n"))), picture, _each(notes, lambda b: F.concat(F.lit("  \n"), text(b))))
        after = F.concat(picture, _each(captions, lambda b: F.concat(F.lit("  \n"), text(b))))
        out = out.when(p["type"] == "image", F.when(F.size(notes) > 0, before).otherwise(after))
        as_html = lambda s: F.when(F.lit(style.tables) & (F.coalesce(s["html"], F.lit("")) != ""), F.concat(F.lit("\n"), s["html"], F.lit("\n"))).when(linked(s), link(s)).otherwise("")
        body = _each(_spans(_parts(p, "table_body"), "table"), as_html)
        out = out.when(p["type"] == "table", F.concat(_each(_parts(p, "table_caption"), lambda b: F.concat(text(b), F.lit("  \n"))), body, _each(_parts(p, "table_footnote"), lambda b: F.concat(F.lit("\n"), text(b), F.lit("  ")))))
    fenced = lambda b: F.when(p["sub_type"] == "code", F.concat(F.lit("```"), F.coalesce(p["guess_lang"], F.lit("txt")), F.lit("\n"), text(b), F.lit("\n```"))).when(p["sub_type"] == "algorithm", text(b)).otherwise("")
    out = out.when(p["type"] == "code", F.concat(_each(_parts(p, "code_caption"), lambda b: F.concat(text(b), F.lit("  \n"))), _each(_parts(p, "code_body"), fenced)))
    return trimmed(F.coalesce(out, F.lit("")))


def page_markdown(paras: Column, mode: str = MARKDOWN, style: Style = Style()) -> Column:  # noqa: B008
    """array of a page's paragraphs that are not blank."""
    return F.filter(F.transform(F.coalesce(paras, F.array()), lambda p: para_markdown(p, mode, style)), lambda t: t != "")


def document_markdown(pages: DataFrame, mode: str = MARKDOWN, style: Style = Style()) -> DataFrame:  # noqa: B008
    """doc_id, markdown."""
    shown = pages.select("doc_id", "page_idx", page_markdown(F.col("para_blocks"), mode, style).alias("paras"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "paras"))), lambda p: p["paras"]))
    return shown.groupBy("doc_id").agg(F.array_join(joined, "\n\n").alias("markdown"))


def _all_paras(pages: DataFrame) -> DataFrame:
    """One row per paragraph: those of the layout, then the discarded ones."""
    both = F.concat(F.coalesce("para_blocks", F.array().cast(pages.schema["para_blocks"].dataType)), F.coalesce("discarded_blocks", F.array().cast(pages.schema["para_blocks"].dataType)))
    return pages.select("doc_id", "page_idx", "width", "height", F.posexplode(both).alias("pos", "p"))


def content_list(pages: DataFrame, style: Style = Style()) -> DataFrame:  # noqa: B008
    """doc_id, page_idx, pos, item: one row per paragraph; fields that its type lacks are null. to_json(item) is its JSON."""
    p = F.col("p")
    text = lambda b: para_text(b["lines"])
    is_ = lambda *kinds: p["type"].isin(*kinds)
    texts = lambda kind: F.transform(_parts(p, kind), text)
    path = lambda spans: F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(spans, lambda s: F.coalesce(s["image_path"], F.lit("")) != ""), lambda s: F.concat(F.lit(f"{style.images}/"), s["image_path"]))), -1), F.lit(""))
    html = F.try_element_at(F.transform(F.filter(_spans(_parts(p, "table_body"), "table"), lambda s: F.coalesce(s["html"], F.lit("")) != ""), lambda s: s["html"]), F.lit(-1))
    plain = ("text", "ref_text", "phonetic", "header", "footer", "page_number", "aside_text", "page_footnote")
    level = title_level(p["level"])
    item = F.struct(
        F.when(is_("title"), "text").when(is_("interline_equation"), "equation").otherwise(p["type"]).alias("type"),
        F.when(is_(*plain, "title", "interline_equation"), text(p)).alias("text"),
        F.when(is_("title") & (level != 0), level).alias("text_level"),
        F.when(is_("interline_equation"), "latex").alias("text_format"),
        F.when(is_("list"), F.coalesce(p["sub_type"], F.lit(""))).when(is_("code"), p["sub_type"]).alias("sub_type"),
        F.when(is_("list"), F.filter(F.transform(F.coalesce(p["blocks"], F.array()), text), lambda t: trimmed(t) != "")).alias("list_items"),
        F.when(is_("image"), path(_spans(_parts(p, "image_body"), "image"))).when(is_("table"), path(_spans(_parts(p, "table_body"), "table"))).alias("img_path"),
        *[F.when(is_(kind), texts(f"{kind}_{part}")).alias(f"{kind}_{part}") for kind in ("image", "table") for part in ("caption", "footnote")],
        F.when(is_("table"), html).alias("table_body"),
        F.when(is_("code"), texts("code_caption")).alias("code_caption"),
        F.when(is_("code"), F.try_element_at(texts("code_body"), F.lit(-1))).alias("code_body"),
        F.when(is_("code") & (p["sub_type"] == "code") & (F.size(_parts(p, "code_body")) > 0), p["guess_lang"]).alias("guess_lang"),
        boxes.to_thousandths(p["bbox"], F.col("width"), F.col("height")).alias("bbox"),
        F.col("page_idx").alias("page_idx"),
    )
    return _all_paras(pages).select("doc_id", "page_idx", "pos", item.alias("item"))


def _body_data(p: Column) -> Column:
    """(path, payload) of the first body with either."""
    kind = "array<struct<path: string, payload: string>>"

    def of(lines: Column) -> Column:
        spans = F.filter(F.flatten(F.transform(F.coalesce(lines, F.array()), lambda line: line["spans"])), lambda s: s["type"].isin("table", "image", "interline_equation", "text"))
        s = F.get(spans, F.lit(0))
        path = F.when(s["type"] != "text", s["image_path"])
        payload = F.when(s["type"] == "table", s["html"]).when(s["type"].isin("interline_equation", "text"), s["content"])
        return F.struct(F.coalesce(path, F.lit("")).alias("path"), F.coalesce(payload, F.lit("")).alias("payload"))

    bodies = F.filter(F.coalesce(p["blocks"], F.array()), lambda b: b["type"].isin("image_body", "table_body", "code_body"))
    found = F.filter(F.transform(bodies, lambda b: of(b["lines"])).cast(kind), lambda d: (d["path"] != "") | (d["payload"] != ""))
    nothing = F.struct(F.lit("").alias("path"), F.lit("").alias("payload"))
    return F.when(p["blocks"].isNotNull(), F.coalesce(F.get(found, F.lit(0)), nothing)).otherwise(of(p["lines"]))


def table_kind(html: Column) -> Column:
    """(table_type, table_nest_level)."""
    tables = (F.length(html) - F.length(F.replace(html, F.lit("<table"), F.lit("")))) / len("<table")
    nested = F.when(tables > 1, 2).otherwise(1)
    complex_ = html.contains("colspan") | html.contains("rowspan") | (nested > 1)
    return F.struct(F.when(complex_, "complex_table").otherwise("simple_table").alias("table_type"), nested.alias("table_nest_level"))


def content_list_v2(pages: DataFrame, style: Style = Style()) -> DataFrame:  # noqa: B008
    """doc_id, page_idx, items: per page a JSON array of {type, content, bbox}; [] for an empty page."""
    p = F.col("p")
    is_ = lambda *kinds: p["type"].isin(*kinds)
    spans = lambda lines: para_spans(lines, F.lit(False))
    own = para_spans(p["lines"], is_("phonetic"))
    level = title_level(p["level"])
    data = _body_data(p)
    several = lambda kind: F.flatten(F.transform(_parts(p, kind), lambda b: spans(b["lines"])))
    source = F.struct(F.concat(F.lit(f"{style.images}/"), data["path"]).alias("path"))
    page_kind = F.when(is_("header"), "page_header").when(is_("footer"), "page_footer").when(is_("aside_text"), "page_aside_text").when(is_("page_number", "page_footnote"), p["type"])
    code, algorithm = is_("code") & (p["sub_type"] == "code"), is_("code") & (p["sub_type"] == "algorithm")
    items = F.filter(F.transform(F.coalesce(p["blocks"], F.array()), lambda b: F.struct(F.lit("text").alias("item_type"), spans(b["lines"]).alias("item_content"))), lambda x: F.size(x["item_content"]) > 0)
    reference = F.array(F.struct(F.lit("text").alias("item_type"), own.alias("item_content")))
    body_spans = F.coalesce(F.try_element_at(F.transform(_parts(p, "code_body"), lambda b: spans(b["lines"])), F.lit(-1)), F.array().cast("array<struct<type: string, content: string>>"))
    kind = table_kind(data["payload"])
    paragraph = is_("text", "phonetic") | (is_("title") & (level == 0))
    content = F.struct(
        *[F.when(page_kind == k, own).alias(f"{k}_content") for k in ("page_header", "page_footer", "page_aside_text", "page_number", "page_footnote")],
        F.when(is_("title") & (level != 0), own).alias("title_content"), F.when(is_("title") & (level != 0), level).alias("level"), F.when(paragraph, own).alias("paragraph_content"),
        F.when(is_("interline_equation"), data["payload"]).alias("math_content"), F.when(is_("interline_equation"), "latex").alias("math_type"), F.when(is_("interline_equation", "image", "table"), source).alias("image_source"),
        *[F.when(is_(k), several(f"{k}_{part}")).alias(f"{k}_{part}") for k in ("image", "table") for part in ("caption", "footnote")],
        F.when(is_("table"), data["payload"]).alias("html"), F.when(is_("table"), kind["table_type"]).alias("table_type"), F.when(is_("table"), kind["table_nest_level"]).alias("table_nest_level"),
        F.when(code, several("code_caption")).alias("code_caption"), F.when(code, body_spans).alias("code_content"), F.when(code, F.coalesce(p["guess_lang"], F.lit("txt"))).alias("code_language"),
        F.when(algorithm, several("code_caption")).alias("algorithm_caption"), F.when(algorithm, body_spans).alias("algorithm_content"),
        F.when(is_("ref_text") | (is_("list") & (p["sub_type"] == "ref_text")), "reference_list").when(is_("list"), "text_list").alias("list_type"),
        F.when(is_("ref_text"), reference).when(is_("list"), items).alias("list_items"),
    )
    name = page_kind
    for condition, value in ((is_("title") & (level != 0), "title"), (paragraph, "paragraph"), (is_("interline_equation"), "equation_interline"), (is_("image"), "image"), (is_("table"), "table"), (code, "code"), (algorithm, "algorithm"), (is_("ref_text", "list"), "list")):
        name = name.when(condition, value)
    item = F.struct(name.alias("type"), F.when(name.isNotNull(), content).alias("content"), boxes.to_thousandths(p["bbox"], F.col("width"), F.col("height")).alias("bbox"))
    rows = _all_paras(pages).select("doc_id", "page_idx", "pos", F.to_json(item).alias("json"))
    lists = rows.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "json"))).alias("own"))
    found = pages.select("doc_id", "page_idx").join(lists, ["doc_id", "page_idx"], "left")
    joined = F.array_join(F.transform(F.coalesce("own", F.array().cast("array<struct<pos: int, json: string>>")), lambda x: x["json"]), ",")
    return found.select("doc_id", "page_idx", F.concat(F.lit("["), joined, F.lit("]")).alias("items"))
