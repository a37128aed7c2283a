"""Retrieval plans over batches of queries: locate an anchor, expand it, select; status and audit per query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.frames import union
from plumbline.operators import intents, search
from plumbline.operators.search import ranked
from plumbline.sources.tables import written

POSITION = ["page_number", "macro_id", "child_id", "chunk_id"]


@dataclass(frozen=True)
class Config:
    top_k: int = 3
    wide_k: int = 100
    candidates: int = 25
    window: int = 2
    hybrid: bool = True
    rerank: bool = False
    neighbours: int = 0


def position() -> list[Column]:
    return [F.asc_nulls_last(c) for c in POSITION]


def by_section(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Chunks with an anchor's heading or section; an empty side matches nothing. Two equi-joins, not one with OR."""
    heading = chunks.join(anchors.filter("heading_path <> ''").select("query_id", "doc_id", "heading_path"), ["doc_id", "heading_path"])
    section = chunks.join(anchors.filter("section_id <> ''").select("query_id", "doc_id", "section_id"), ["doc_id", "section_id"])
    return union(heading, section).dropDuplicates(["query_id", "chunk_id"])


def by_macro(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    return chunks.join(anchors.select("query_id", "doc_id", "macro_id"), ["doc_id", "macro_id"])


def by_page_window(chunks: DataFrame, anchors: DataFrame, window: int = 2) -> DataFrame:
    """Chunks on the pages from window before an anchor's first page to window after its last."""
    pages = F.sequence(F.greatest(F.array_min("page_numbers") - window, F.lit(1)), F.array_max("page_numbers") + window)
    a = anchors.filter(F.size("page_numbers") > 0).select("query_id", "doc_id", F.explode(pages).alias("page_"))
    return chunks.withColumn("page_", F.explode("page_numbers")).join(a, ["doc_id", "page_"]).drop("page_").dropDuplicates(["query_id", "chunk_id"])


def expand(chunks: DataFrame, anchors: DataFrame, window: int = 2) -> DataFrame:
    """The first of section, macro and page window that has chunks, in document order; `page_window` (boolean) allows the last."""
    parts = [by_section(chunks, anchors).withColumns({"priority": F.lit(1), "method": F.lit("section")}), by_macro(chunks, anchors).withColumns({"priority": F.lit(2), "method": F.lit("macro_id")}), by_page_window(chunks, anchors.filter("page_window"), window).withColumns({"priority": F.lit(3), "method": F.lit("page_window")})]
    every = union(*parts)
    rows = every.withColumn("least_", F.min("priority").over(Window.partitionBy("query_id"))).filter("priority = least_").drop("least_", "priority")
    return ranked(rows, ["query_id"], position(), None)


def filter_tables(rows: DataFrame) -> DataFrame:
    """Rows (with their query) without tables, for the queries that leave tables out."""
    return rows.filter(~(intents.filters_tables(F.col("query")) & intents.is_table(F.col("chunk_type"), F.col("text_content"))))


def items_of_note_anchor(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First clean candidate of each query by rank, and the decisions up to it."""
    judged = intents.anchor_rejections(candidates)
    first = judged.withColumn("accepted_", F.min(F.when(F.size("reasons") == 0, F.col("rank"))).over(Window.partitionBy("query_id")))
    audit = first.filter(F.col("accepted_").isNull() | (F.col("rank") <= F.col("accepted_"))).select("query_id", "rank", "chunk_id", "reasons")
    return first.filter("rank = accepted_").drop("accepted_", "reasons"), audit


def with_neighbours(chunks: DataFrame, following: int = 2) -> DataFrame:
    """Adds the text of a chunk and the next narrative chunks of its section."""
    ahead = Window.partitionBy("doc_id", "section_id").orderBy(*position()).rowsBetween(0, following)
    own = F.when(F.col("chunk_type") == "narrative", F.col("text_content"))
    return chunks.withColumn("evidence", F.array_join(F.collect_list(own).over(ahead), "\n"))


def run_plans(chunks: DataFrame, queries: DataFrame, cfg: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Results (query_id, rank, method, chunk columns) and one status row per query.

    `chunks` has the chunk columns, page_number and embedding; `queries` has query_id, doc_id, query and
    query_embedding. The batch is split by route; every route is a join over its queries. What several
    routes read is a written table, so that each step is planned over tables and made once.
    """
    cfg = cfg or Config()
    q = written(intents.classify(queries).withColumn("target", intents.section_target(F.col("query"))), "queries")
    body, vectors = written(chunks.drop("embedding"), "chunks"), written(chunks.select("doc_id", "chunk_id", "page_numbers", "embedding"), "vectors")
    index = tuple(written(part, "index") for part in search.bm25_index(body))

    location = q.filter("intent = 'location'")
    at_pages = search.vector_search(vectors, location.select("query_id", "doc_id", "pages", "query_embedding"), cfg.wide_k, pages=True)
    located = at_pages.select("query_id", "chunk_id", "rank").join(body, "chunk_id").withColumn("method", F.lit("pages"))

    coverage = q.filter("intent = 'coverage'")
    items = F.coalesce(F.col("target.label") == "items_of_note", F.lit(False))
    note = coverage.filter(items)
    phrases = F.array(*map(F.lit, rules.POSITIVE))
    candidates = search.phrase_candidates(body, note.select("query_id", "doc_id", phrases.alias("phrases")), cfg.candidates)
    anchors_note, audit = items_of_note_anchor(written(candidates.join(note.select("query_id", "query", "coverage_type"), "query_id"), "candidates"))
    rest = coverage.filter(~items)
    legal = rest.filter(intents.is_litigation(F.col("query")))
    best = written(search.best_phrase_anchor(index, legal.select("query_id", "doc_id", F.array(*map(F.lit, rules.LITIGATION_ANCHORS)).alias("phrases"))), "best")
    open_ = rest.join(best.select("query_id"), "query_id", "left_anti").withColumn("query", intents.expanded(F.col("query")))
    meaning = q.filter("intent = 'semantic'")
    # one search for both routes: each query says how many chunks it takes
    cols = ["query_id", "doc_id", "query", "query_embedding"]
    asked = union(open_.select(*cols, F.lit("anchor").alias("route"), F.lit(1).alias("k")), meaning.select(*cols, F.lit("search").alias("route"), F.lit(cfg.wide_k).alias("k")))
    asked = written(asked, "asked")
    taken = asked.select("query_id", "route", "k")
    near = search.vector_search(vectors, asked, 3 * cfg.wide_k if cfg.hybrid else cfg.wide_k)
    if cfg.hybrid:
        lexical = search.bm25_search(index, asked, 3 * cfg.wide_k).join(taken, "query_id")
        near = search.fuse(near.filter("rank <= 3 * k"), lexical.filter("rank <= 3 * k"), cfg.wide_k).join(taken, "query_id")
    hits = written(near.filter("rank <= k").select("query_id", "chunk_id", "rank", "route"), "hits")
    anchor_rows = union(*(x.select("query_id", "chunk_id") for x in (anchors_note, best, hits.filter("route = 'anchor'"))))
    window = F.coalesce((F.col("coverage_type") == "attribute") | F.col("target").isNotNull(), F.lit(False))
    anchor_rows = written(anchor_rows, "anchors")
    anchors = written(anchor_rows.join(body, "chunk_id").join(coverage.select("query_id", window.alias("page_window")), "query_id"), "anchors")
    expanded = filter_tables(expand(body, anchors, cfg.window).join(q.select("query_id", "query"), "query_id"))

    wide = filter_tables(hits.filter("route = 'search'").drop("route").join(body, "chunk_id").join(q.select("query_id", "query"), "query_id"))
    chosen = ranked(wide.withColumnRenamed("rank", "rank_"), ["query_id"], [F.col("rank_")], cfg.top_k).drop("rank_").withColumn("method", F.lit("search"))
    if cfg.rerank:
        expanded, chosen = (search.rerank(x).drop("prior_rank", "rerank_score") for x in (expanded, chosen))

    columns = ["query_id", "rank", "method", *body.columns]
    out = written(union(*(x.select(columns) for x in (located, expanded, chosen))), "results")
    counts = out.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("pages_read"))
    listed = F.col("coverage_type").isin("list", "numeric_list")
    has_anchor = F.col("anchor_id").isNotNull()
    status = F.when((F.col("intent") == "coverage") & (F.col("coverage_type") == "list") & ~has_anchor, "CoverageListQuery has no anchor heading.").when((F.col("intent") == "coverage") & (F.col("coverage_type") == "numeric_list") & ~has_anchor, "not_found").when((F.col("intent") == "coverage") & listed & F.col("n_chunks").isNull(), "CoverageListQuery expansion returned no chunks.").otherwise("ok")
    log = audit.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "reasons")))).alias("decisions"))
    record = q.select("query_id", "intent", "coverage_type", "status_filter").join(anchor_rows.withColumnRenamed("chunk_id", "anchor_id"), "query_id", "left").join(counts, "query_id", "left").join(log, "query_id", "left")
    return out, record.withColumn("status", status)


def debug_record(results: DataFrame, top: int = 10, snippet: int = 160) -> DataFrame:
    """One audit row per query: its first chunks as JSON, and the headings, sections and pages that it read."""
    shown = F.when(F.col("rank") <= top, F.struct("rank", "chunk_id", F.substring("text_content", 1, snippet).alias("snippet")))
    return results.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(shown))).alias("top_chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("pages"), F.array_sort(F.collect_set("heading_path")).alias("headings"), F.array_sort(F.collect_set("section_id")).alias("sections"))
