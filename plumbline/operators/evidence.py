"""Evidence: list items, answers, amounts, verification of answers, rectangles of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.textnorm import join_hyphens, plain, plain_tokens
from plumbline.operators.layout import points_to_box
from plumbline.operators.search import ranked


def title(c: Column) -> Column:
    return F.initcap(c)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _guarded(text: Column, needed: str, pattern: str) -> Column:
    """All matches of a slow pattern, looked for only in texts that hold what each match must."""
    return F.when(text.rlike(needed), _all(text, pattern, 0)).otherwise(F.array().cast("array<string>"))


def matches(text: Column) -> Column:
    """array<struct<extractor, position, raw, display>>: case names, heading terms, matters, in that order.

    The groups of a match are read from the matched text, so that each pattern passes over a text once.
    """
    group = lambda raw, pattern, k: title(F.regexp_extract(raw, pattern, k))
    cases = F.transform(_guarded(text, rules.CASE_MARK, rules.CASE_NAME), lambda r: F.struct(r.alias("raw"), F.concat(group(r, rules.CASE_NAME, 1), F.lit(" v. "), group(r, rules.CASE_NAME, 2)).alias("display")))
    terms = F.flatten(F.array(*(F.transform(_all(text, f"(?i){t}", 0), lambda r: F.struct(r.alias("raw"), title(r).alias("display"))) for t in rules.HEADING_TERMS)))
    matters = F.transform(_guarded(text, rules.MATTER_WORDS, rules.MATTER), lambda r: F.struct(r.alias("raw"), group(r, rules.MATTER, 1).alias("display")))
    number = lambda xs, k: F.transform(xs, lambda x, i: F.struct(F.lit(k).alias("extractor"), i.alias("position"), x["raw"].alias("raw"), x["display"].alias("display")))
    return F.concat(number(cases, 1), number(terms, 2), number(matters, 3))


def list_items(results: DataFrame) -> DataFrame:
    """Items of each query's chunks in order, one for each display text (case aside), the first wins."""
    rows = results.withColumn("m", F.explode(matches(join_hyphens(F.col("text_content"))))).select("query_id", "rank", "chunk_id", "page_numbers", "m.*")
    first = Window.partitionBy("query_id", F.lower("display")).orderBy("rank", "extractor", "position")
    rows = rows.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_")
    order = Window.partitionBy("query_id").orderBy("rank", "extractor", "position")
    return rows.withColumn("item_no", F.row_number().over(order)).select("query_id", "item_no", "chunk_id", "page_numbers", "raw", "display")


def pages_text(pages: Column) -> Column:
    return F.array_join(pages.cast("array<string>"), ",")


def format_list(items: DataFrame, heading: str = "Items found") -> DataFrame:
    line = F.concat(F.lit("- "), "display", F.lit(" | raw: "), "raw", F.lit(" (chunk_id="), "chunk_id", F.lit(", pages="), pages_text(F.col("page_numbers")), F.lit(")"))
    lines = F.sort_array(F.collect_list(F.struct("item_no", line.alias("line"))))
    return items.groupBy("query_id").agg(F.concat(F.lit(f"{heading}\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("answer"))


def searched_scope(results: DataFrame) -> DataFrame:
    """Sections and pages that a query searched, for answers without evidence."""
    section = F.coalesce(F.when(F.col("heading_path") != "", F.col("heading_path")), F.when(F.col("section_id") != "", F.col("section_id")), F.lit("unknown"))
    return results.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(section)), ", ").alias("sections"), pages_text(F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers"))))).alias("pages"))


def resolve_mode(mode: Column, n_items: Column) -> Column:
    """deterministic, or needs_model; an unknown mode is llm_fallback."""
    known = F.when(mode.isin("deterministic", "llm_fallback", "llm_always"), mode).otherwise("llm_fallback")
    return F.when(known == "deterministic", "deterministic").when((known == "llm_fallback") & (n_items >= rules.MIN_ITEMS), "deterministic").otherwise("needs_model")


def source_blocks(results: DataFrame, ids: bool = False) -> DataFrame:
    """The prompt table: `[Cn] text` blocks, or blocks with chunk ids and pages."""
    block = F.concat(F.lit("chunk_id="), "chunk_id", F.lit(" pages="), pages_text(F.col("page_numbers")), F.lit(" text="), "text_content") if ids else F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("] "), "text_content")
    parts = F.sort_array(F.collect_list(F.struct("rank", block.alias("b"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n").alias("sources"))


def closed_matters(results: DataFrame) -> DataFrame:
    """Sentences that say closed, settled or discontinued, with the names in them."""
    rows = results.select("query_id", "rank", "chunk_id", F.posexplode(F.split("text_content", "(?<=[.!?])\\s+")).alias("sentence_no", "sentence")).filter(F.col("sentence").rlike(rules.CLOSED_WORDS))
    names = F.transform(F.filter(matches(F.col("sentence")), lambda m: m["extractor"] != 2), lambda m: m["display"])
    return rows.withColumn("names", F.array_join(F.array_distinct(names), "; ")).withColumn("how", F.lower(F.regexp_extract("sentence", rules.CLOSED_WORDS, 1)))


MONEY = r"(?:US|C)?\$\s*(\d[\d,]*(?:\.\d+)?)\s*(million|billion)"
#: A label before its amount in parentheses, and an amount before its label.
LABELLED = rf"(?i)([A-Za-z][A-Za-z' -]*?)\s*\({MONEY}"
LABELLED_AFTER = rf"(?i){MONEY}(?: (?:after|before) tax)? (?:of|for|related to) ([A-Za-z][A-Za-z' -]*)"
AGGREGATE_AMOUNT = rf"(?i)(?:aggregate|net|total) impact(?: of| was| is|:)?\s*{MONEY}"


def millions(number: Column, unit: Column) -> Column:
    scale = F.when(F.lower(unit) == "billion", 1000).otherwise(1)
    return F.round(F.regexp_replace(number, ",", "").cast("decimal(18,4)") * scale, 3).cast("decimal(18,3)")


def amounts(results: DataFrame) -> DataFrame:
    """Labelled amounts in millions, the stated aggregate or net impact, and whether the items add up to it.

    Only lines with a currency sign are searched, one by one.
    """
    lines = F.filter(F.split("text_content", "\n"), lambda x: x.contains("$"))

    def items(line: Column, pattern: str, label: int, number: int) -> Column:
        values = F.zip_with(_all(line, pattern, number), _all(line, pattern, number + 1), millions)
        return F.zip_with(_all(line, pattern, label), values, lambda a, n: F.struct(F.trim(a).alias("label"), n.alias("millions")))

    parts = F.flatten(F.transform(lines, lambda x: F.concat(items(x, LABELLED, 1, 2), items(x, LABELLED_AFTER, 3, 1))))
    said = F.get(F.filter(lines, lambda x: x.rlike(AGGREGATE_AMOUNT)), 0)
    stated = F.when(said.isNotNull(), millions(F.regexp_extract(said, AGGREGATE_AMOUNT, 1), F.regexp_extract(said, AGGREGATE_AMOUNT, 2)))
    rows = results.withColumn("stated", stated).withColumn("item", F.explode(parts))
    total = rows.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n_items"), F.sum("item.millions").alias("total"), F.max("stated").alias("stated"))
    return total.withColumn("adds_up", F.col("total") == F.col("stated"))


def numeric_span(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), rules.NUMERIC_SPAN, 0)


def attribute_spans(results: DataFrame) -> DataFrame:
    """First chunk, in order, with a numeric span."""
    rows = results.withColumn("span", numeric_span(F.col("text_content"))).filter("span <> ''").withColumnRenamed("rank", "place")
    return ranked(rows, ["query_id"], [F.col("place")], 1).select("query_id", "chunk_id", "span")


def pointer_answers(anchors: DataFrame) -> DataFrame:
    """A note reference in the anchor's text, else its heading."""
    note = F.regexp_extract("text_content", "(?i)Note \\d+", 0)
    return anchors.select("query_id", "chunk_id", F.concat(F.lit("See "), F.when(note != "", note).otherwise(F.coalesce("heading_path", F.lit("the cited section"))), F.lit(" [C1]")).alias("answer"))


def parse_items(answers: DataFrame) -> DataFrame:
    """query_id, item_no, item, chunk_id of an answer's list lines."""
    rows = answers.select("query_id", F.posexplode(F.split("answer", "\n")).alias("item_no", "line")).withColumn("line", F.trim("line")).filter(F.col("line").startswith("- "))
    item = F.regexp_replace(F.regexp_replace(F.expr("substring(line, 3)"), " \\(chunk_id=(?s:.*)$", ""), " \\| raw:(?s:.*)$", "")
    return rows.select("query_id", "item_no", F.trim(item).alias("item"), F.regexp_extract("line", "chunk_id=([\\w-]+)", 1).alias("chunk_id")).filter("chunk_id <> ''")


def verify_items(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """YES if each item has enough of its tokens in its cited chunk; else NO with the missing tokens."""
    items = parse_items(answers).join(chunks.select("chunk_id", "text_content"), "chunk_id", "left")
    want, have = plain_tokens(F.col("item")), plain_tokens(F.coalesce("text_content", F.lit("")))
    enough = F.when(F.size(want) == 0, False).otherwise(F.size(F.array_intersect(want, have)) / F.greatest(F.size(want), F.lit(1)) >= rules.PASS_RATIO)
    missing = F.when(F.size(want) == 0, "<no tokens>").otherwise(F.array_join(F.array_sort(F.array_except(want, have)), ", "))
    rows = items.withColumns({"ok": enough, "failure": F.when(~enough, F.concat(F.lit("Missing tokens for '"), "item", F.lit("': "), missing))})
    judged = rows.groupBy("query_id").agg(F.bool_and("ok").alias("ok"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("item_no", "failure")))), lambda x: x["failure"]), "; ").alias("failures"))
    return answers.select("query_id").join(judged, "query_id", "left").select("query_id", F.when(F.coalesce("ok", F.lit(False)), "YES").otherwise("NO").alias("verdict"), F.when(F.col("ok").isNull(), "Not found in retrieved evidence.").when(F.col("ok"), "All listed items meet normalized token coverage.").otherwise(F.col("failures")).alias("rationale"))


def cited(answers: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks that an answer cites as [Cn]; out of range is ignored, and without any valid citation all chunks are."""
    marks = F.transform(_all(F.col("answer"), r"\[C(\d+)\]", 1), lambda x: x.cast("int"))
    rows = results.join(answers.select("query_id", "answer", marks.alias("marks")), "query_id")
    hit = F.array_contains("marks", F.col("rank"))
    any_hit = F.max(hit.cast("int")).over(Window.partitionBy("query_id")) == 1
    return rows.withColumn("keep_", hit | ~any_hit).filter("keep_").drop("keep_", "marks")


def verify_attribute(answers: DataFrame, results: DataFrame) -> DataFrame:
    """YES if the answer's numeric span stands in a cited chunk."""
    span = plain(numeric_span(F.col("answer")))
    rows = cited(answers, results).withColumn("hit", (numeric_span(F.col("answer")) != "") & (span != "") & plain(F.col("text_content")).contains(span))
    return answers.join(rows.groupBy("query_id").agg(F.bool_or("hit").alias("hit")), "query_id", "left").select("query_id", F.when(F.coalesce("hit", F.lit(False)), "YES").otherwise("NO").alias("verdict"))


def cited_chunk(answers: DataFrame, results: DataFrame) -> DataFrame:
    """The chunk to show: the first valid citation, else the first chunk."""
    marks = _all(F.col("answer"), r"\[C(\d+)\]", 1).cast("array<int>")
    rows = results.join(answers.select("query_id", marks.alias("marks")), "query_id").withColumn("at", F.nullif(F.array_position("marks", F.col("rank")), F.lit(0)))
    return rows.groupBy("query_id").agg(F.coalesce(F.min_by("chunk_id", F.when(F.col("at").isNotNull(), F.struct("at", "rank"))), F.min_by("chunk_id", "rank")).alias("chunk_id"))


def annotations(results: DataFrame, color: str = "yellow") -> DataFrame:
    """One rectangle per polygon of each chunk, numbered in order; polygons without points are left out."""
    rows = results.select("query_id", "rank", "chunk_id", F.posexplode("polygons").alias("polygon_no", "p")).filter(F.size("p.polygon") > 0)
    box = points_to_box(F.col("p.polygon"))
    rows = rows.select("query_id", "rank", "chunk_id", "polygon_no", F.coalesce("p.page_number", F.lit(1)).alias("page"), box.alias("b"))
    order = Window.partitionBy("query_id").orderBy("rank", "polygon_no")
    return rows.select("query_id", "chunk_id", "page", F.col("b.x0").alias("x"), F.col("b.y0").alias("y"), (F.col("b.x1") - F.col("b.x0")).alias("width"), (F.col("b.y1") - F.col("b.y0")).alias("height"), F.lit(color).alias("color"), F.row_number().over(order).alias("annotation_no"))


def first_annotation(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "chunk_id").agg(F.min("annotation_no").alias("annotation_no"))
