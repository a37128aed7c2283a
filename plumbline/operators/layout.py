"""Layout: page text to lines, headings, spans, tables; boxes and polygons."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import grid, rules, scan
from plumbline.functions.frames import union
from plumbline.functions.textnorm import WHITE, any_pattern, collapse, is_title, is_upper, numbered, strip


def page_lines(pages: DataFrame) -> DataFrame:
    """Stripped, non-empty lines with their number on the page."""
    rows = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.select("doc_id", "page_number", "line_no", F.btrim("raw", F.lit(WHITE)).alias("line")).filter("line <> ''")


def words_to_lines(words: DataFrame) -> DataFrame:
    """Words by block and line to lines in order of x0, with the box around them."""
    ordered = F.array_sort(F.collect_list(F.struct("x0", "word_no", "word")))
    return words.groupBy("doc_id", "page_number", "block_no", "line_no").agg(F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("line"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def outside_tables(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows whose box overlaps no table box of their page (edges count as overlap).

    Boxes and tables meet by grid cells of their page, at the level of the larger one, so that a page with very many
    of both is no product of them. Rows without a whole box overlap nothing.
    """
    place, page = ["doc_id", "page_number", "x0", "y0", "x1", "y1"], ["doc_id", "page_number"]
    held = tables.select(*place).distinct()
    # Only boxes that reach into the extent of their page's tables are cut into cells; sides may come in any order.
    sides = {"left_": F.min(F.least("x0", "x1")), "right_": F.max(F.greatest("x0", "x1")), "top_": F.min(F.least("y0", "y1")), "bottom_": F.max(F.greatest("y0", "y1"))}
    whole = reduce(and_, (F.col(c).isNotNull() for c in place))
    extent = held.filter(whole).groupBy(*page).agg(*(c.alias(n) for n, c in sides.items()))
    reaching = (F.least("x0", "x1") <= F.col("right_")) & (F.greatest("x0", "x1") >= F.col("left_")) & (F.least("y0", "y1") <= F.col("bottom_")) & (F.greatest("y0", "y1") >= F.col("top_"))
    near = boxes.select(*place).filter(whole).join(extent, page).filter(reaching).select(*place)
    top = grid.top_level(boxes, held)
    a, b = grid.with_cells(near, top), grid.with_cells(held, top)
    b = b.select("doc_id", "page_number", "level_", "cx_", "cy_", *(F.col(c).alias(f"{c}_table_") for c in ("x0", "y0", "x1", "y1", "level_of_")))
    apart = (F.col("x0") > F.col("x1_table_")) | (F.col("x1") < F.col("x0_table_")) | (F.col("y0") > F.col("y1_table_")) | (F.col("y1") < F.col("y0_table_"))
    met = a.join(b, ["doc_id", "page_number", "level_", "cx_", "cy_"]).filter(~apart & (F.col("level_") == F.greatest("level_of_", "level_of__table_")))
    # A place decides, so equal rows go or stay together; a null is equal to nothing and stays.
    return boxes.join(met.select(*place).distinct(), place, "left_anti").select(*boxes.columns)


def heading_level(line: Column) -> Column:
    """1, 2 or null; the first rule that applies wins."""
    short = F.length(line) <= 80
    rules_ = [(any_pattern(line, rules.HEADING_ONE), 1), (any_pattern(line, rules.HEADING_TWO), 2), (short & is_upper(line), 1), (short & line.endswith(":"), 2), (short & is_title(line), 2), ((F.length(line) <= 100) & numbered(line), 2)]
    level = F.when(F.length(line) < 3, None)
    for condition, value in rules_:
        level = level.when(condition, value)
    return level.cast("int")


def leveled(lines: DataFrame) -> DataFrame:
    """Adds level, for what reads the lines several times and writes them before."""
    return lines.withColumn("level", heading_level(F.col("line")))


def heading_stack(lines: DataFrame, at_once: int = scan.RANGE) -> DataFrame:
    """Adds level (unless it is there), heading_path, section_id: the stack carried over the lines and pages of a document.

    Levels are 1 and 2 only, so the stack is the last heading of level 1 (before any, the first heading) and
    the latest heading. Both are maxima and minima of places, so each page is summed up in one row, the rows
    are scanned (`scan.before`), and a page's lines start from what came before it: no task needs more
    than a page's lines or a range of pages.
    """
    here = F.when(F.col("level").isNotNull(), F.struct("page_number", "line_no", collapse(F.col("line")).alias("text")))
    lines = lines if "level" in lines.columns else leveled(lines)
    rows = lines.withColumn("here_", here)
    one = F.when(F.col("level") == 1, F.col("here_"))
    pages = rows.groupBy("doc_id", "page_number").agg(F.max(one).alias("one_"), F.min("here_").alias("first_"), F.max("here_").alias("last_"))
    state = scan.before(pages, {"one_": "max", "first_": "min", "last_": "max"}, at_once)
    so_far = Window.partitionBy("doc_id", "page_number").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"own_one_": F.max(one).over(so_far), "own_first_": F.min("here_").over(so_far), "own_last_": F.max("here_").over(so_far)})
    rows = rows.join(state, ["doc_id", "page_number"]).withColumn("base_", F.coalesce("own_one_", "one_", "first_", "own_first_")).withColumn("last_", F.coalesce("own_last_", "last_"))
    deep = (F.col("last_.page_number") != F.col("base_.page_number")) | (F.col("last_.line_no") != F.col("base_.line_no"))
    path = F.concat_ws("/", F.col("doc_id"), F.col("base_.text"), F.when(deep, F.col("last_.text")))
    return rows.select(*lines.columns, path.alias("heading_path"), F.coalesce(F.col("last_.text"), F.col("doc_id")).alias("section_id"))


def table_islands(lines: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` lines with cells between bars: table_no and markdown per run."""
    bars = lines.filter(F.col("line").contains(" | "))
    page = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    runs = bars.withColumn("island", F.col("line_no") - F.row_number().over(page))
    cells = F.filter(F.split(F.regexp_replace("line", "^\\||\\|$", ""), "\\|"), lambda x: strip(x) != "")
    runs = runs.withColumn("cells", F.transform(cells, strip))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "cells")))
    return runs.groupBy("doc_id", "page_number", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_rows"), rows.alias("rows_")).filter(F.col("n_rows") >= least).select("doc_id", "page_number", "first_line", "last_line", "n_rows", markdown(F.transform("rows_", lambda r: r["cells"])).alias("markdown"))


def markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table: header, rule, body."""
    shown = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")).otherwise("")


def cells_to_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row_index, column_index, content, seq) to a dense grid, the last of equal places wins."""
    last = cells.groupBy(*keys, "row_index", "column_index").agg(F.max_by(strip(F.coalesce("content", F.lit(""))), "seq").alias("content"))
    size = cells.groupBy(*keys).agg(F.max("row_index").alias("r"), F.max("column_index").alias("c"))
    grid = size.select(*keys, F.explode(F.sequence(F.lit(0), "r")).alias("row_index"), "c").select(*keys, "row_index", F.explode(F.sequence(F.lit(0), "c")).alias("column_index"))
    full = grid.join(last, [*keys, "row_index", "column_index"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    row = full.groupBy(*keys, "row_index").agg(F.array_sort(F.collect_list(F.struct("column_index", "content"))).alias("cs"))
    return row.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_index", "cs"))).alias("rs")).select(*keys, markdown(F.transform("rs", lambda r: F.transform(r["cs"], lambda c: c["content"]))).alias("markdown"))


def spans(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Spans of a page: lines with running offsets (a newline between), then tables with the page's last heading."""
    rows = heading_stack(lines).select("doc_id", "page_number", F.lit(0).alias("kind"), F.col("line_no").alias("ordinal"), F.col("line").alias("text"), "heading_path", "section_id")
    if tables is not None:
        page = rows.groupBy("doc_id", "page_number").agg(F.max_by(F.struct("heading_path", "section_id"), "ordinal").alias("h"))
        extra = tables.join(page, ["doc_id", "page_number"]).select("doc_id", "page_number", F.lit(1).alias("kind"), F.col("first_line").alias("ordinal"), F.concat(F.lit("[TABLE] "), F.col("h.heading_path"), F.lit("\n"), F.col("markdown")).alias("text"), "h.heading_path", "h.section_id")
        rows = union(rows, extra)
    page = Window.partitionBy("doc_id", "page_number").orderBy("kind", "ordinal")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return rows.withColumn("span_no", F.row_number().over(page)).withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text")).withColumn("is_table", F.col("kind") == 1).drop("kind", "ordinal")


def page_text(span_rows: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    return span_rows.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "\n").alias("text"))


def flat_to_points(flat: Column) -> Column:
    """[x, y, x, y, ...] to points; an odd tail is dropped."""
    pairs = F.floor(F.size(flat) / 2).cast("int")
    return F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def box_to_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))


def points_to_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def layout_json(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and tables of layout JSON rows (doc_id, pages, tables); a table is on each page that one of its regions names."""
    page = df.select("doc_id", F.explode("pages").alias("p"))
    lines = page.select("doc_id", F.col("p.pageNumber").alias("page_number"), F.posexplode("p.lines").alias("line_no", "l")).select("doc_id", "page_number", "line_no", strip(F.col("l.content")).alias("line"), flat_to_points(F.col("l.polygon")).alias("points"))
    found = df.select("doc_id", F.posexplode("tables").alias("table_no", "t")).select("doc_id", "table_no", "t.cells", F.explode("t.boundingRegions").alias("r"))
    found = found.select("doc_id", "table_no", "cells", F.col("r.pageNumber").alias("page_number"), flat_to_points(F.col("r.polygon")).alias("points")).filter(F.size("points") > 0)
    return lines, found.dropDuplicates(["doc_id", "table_no", "page_number"])
