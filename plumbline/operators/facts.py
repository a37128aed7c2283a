"""Document facts: extraction, resolution, cached answers and the front-matter fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.frames import union
from plumbline.functions.textnorm import strip
from plumbline.operators import search
from plumbline.operators.search import ranked

FACTS = ["default_currency", "units", "accounting_framework", "consolidation_basis", "reporting_period"]


def _found(text: Column, pattern: str, value: Column) -> Column:
    return F.when(text.rlike(pattern), value)


def fact_values(text: Column) -> dict[str, Column]:
    """Value of each fact in a text, or null. Units need no word before them (see README)."""
    currency, units, framework, period = rules.CURRENCY, rules.UNITS, rules.FRAMEWORK, rules.PERIOD
    part = lambda p, g: F.regexp_extract(text, p, g)
    return {
        "default_currency": _found(text, currency, F.concat_ws(" ", strip(part(currency, 1)), strip(part(currency, 2)))),
        "units": _found(text, units, F.lower(part(units, 1))),
        "accounting_framework": _found(text, framework, F.upper(part(framework, 1))),
        "consolidation_basis": F.when(F.lower(text).contains("consolidated"), "consolidated"),
        "reporting_period": _found(text, period, part(period, 1)),
    }


def excerpt(text: Column, most: int = 200) -> Column:
    return F.substring(F.substring_index(strip(text), "\n", 1), 1, most)


def extract_facts(chunks: DataFrame) -> DataFrame:
    """One row per document and fact: not_found, ambiguous (more than one value) or found with the first chunk's lineage."""
    values = fact_values(F.col("text_content"))
    pairs = F.filter(F.array(*(F.struct(F.lit(name).alias("fact_name"), values[name].alias("value")) for name in FACTS)), lambda p: p["value"].isNotNull())
    # the excerpt goes on, not the text: it would be copied for each fact and sorted with its group
    cut = excerpt(F.col("text_content")).alias("excerpt")
    rows = chunks.filter(F.coalesce(F.col("chunk_type") != "table", F.lit(True))).select("doc_id", "chunk_id", "page_number", "page_numbers", "macro_id", "child_id", cut, F.explode(pairs).alias("p")).select("*", "p.*")
    order = F.struct("page_number", "macro_id", "child_id", "chunk_id")
    found = rows.groupBy("doc_id", "fact_name").agg(F.count_distinct("value").alias("n"), F.min_by(F.struct("value", "chunk_id", "page_numbers", "excerpt"), order).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("all_pages"))
    every = chunks.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, FACTS))).alias("fact_name"))
    one = F.col("n") == 1
    status = F.when(F.col("n").isNull(), "not_found").when(one, "found").otherwise("ambiguous")
    pages = F.when(one, F.col("first.page_numbers")).otherwise(F.coalesce("all_pages", F.array().cast("array<int>")))
    return every.join(found, ["doc_id", "fact_name"], "left").select("doc_id", "fact_name", F.when(one, F.col("first.value")).alias("value"), status.alias("status"), F.when(one, 0.9).otherwise(0.0).alias("confidence"), F.when(one, F.col("first.chunk_id")).alias("source_chunk_id"), pages.alias("page_numbers"), F.when(one, F.col("first.excerpt")).alias("evidence_excerpt"))


def fact_name(query: Column) -> Column:
    """The first fact, in order, with an alias in the query."""
    lower = F.lower(query)
    out = F.lit(None).cast("string")
    for name, aliases in reversed(rules.FACT_ALIASES):
        hit = F.lit(False)
        for a in aliases:
            hit = hit | lower.contains(a)
        out = F.when(hit, name).otherwise(out)
    return out


def cached_answers(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """Queries on facts with `answer` from found facts that have a source; null where the fallback is needed."""
    rows = queries.withColumn("fact_name", fact_name(F.col("query"))).filter("fact_name is not null")
    known = facts.filter("status = 'found' and source_chunk_id is not null").select("doc_id", "fact_name", "value", "source_chunk_id")
    return rows.join(known, ["doc_id", "fact_name"], "left").withColumn("answer", F.when(F.col("value").isNotNull(), F.concat("fact_name", F.lit(": "), "value", F.lit(" [C1]"))))


def fallback_candidates(chunks: DataFrame, queries: DataFrame, pages: int = 10, k: int = 3) -> DataFrame:
    """Candidates of each query (query_id, doc_id, query_embedding) in order.

    Narrative hits on the first pages by vector, the first chunk of each heading phrase, and BM25 hits
    over narrative chunks; a chunk counts where it comes first.
    """
    body, narrative = chunks.drop("embedding"), F.coalesce(F.col("chunk_type") == "narrative", F.lit(False))
    front = search.vector_search(chunks.select("doc_id", "chunk_id", "page_numbers", "embedding"), queries.withColumn("pages", F.sequence(F.lit(1), F.lit(pages))), k, pages=True).select("query_id", "chunk_id", "rank")
    front = front.join(body, "chunk_id").filter(narrative).select("query_id", "chunk_id", F.lit(1).alias("source_order"), "rank")
    phrase = F.explode(F.array(*map(F.lit, rules.FACT_HEADINGS))).alias("phrase")
    where = F.lower(F.concat_ws("\n", "heading_path", "section_id"))
    heads = body.filter(F.coalesce(F.col("chunk_type") != "table", F.lit(True))).select("*", phrase).filter(where.contains(F.lower("phrase")))
    heads = ranked(heads, ["doc_id", "phrase"], [F.col(c) for c in ("page_number", "macro_id", "child_id", "chunk_id")], 1).drop("rank")
    numbers = F.array_position(F.array(*map(F.lit, rules.FACT_HEADINGS)), F.col("phrase")).cast("int")
    heads = queries.select("query_id", "doc_id").join(heads, "doc_id").select("query_id", "chunk_id", F.lit(2).alias("source_order"), numbers.alias("rank"))
    worded = queries.withColumn("query", F.lit(" ".join(rules.FACT_KEYWORDS)))
    lexical = search.bm25_search(search.bm25_index(body.filter(narrative)), worded, k, positive=True).select("query_id", "chunk_id", F.lit(3).alias("source_order"), "rank")
    every = ranked(union(front, heads, lexical).withColumnRenamed("rank", "place"), ["query_id", "chunk_id"], [F.col("source_order"), F.col("place")], 1).drop("rank")
    return every.join(body, "chunk_id")


def fallback_answers(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, status, answer: the first currency words outside tables, for default_currency only."""
    text = F.col("text_content")
    value = F.when(text.contains("Canadian dollars"), "Canadian dollars").when(text.contains("U.S. dollars") | text.contains("US dollars"), "U.S. dollars")
    usable = F.when(~F.coalesce(F.col("chunk_type") == "table", F.lit(False)), value)
    best = candidates.withColumn("value", usable).groupBy("query_id").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.struct("source_order", "place"))).alias("value"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("pages"))
    rows = queries.join(best, "query_id", "left").withColumn("value", F.when(F.col("fact_name") == "default_currency", F.col("value")))
    pages = F.concat(F.lit("["), F.array_join(F.coalesce("pages", F.array().cast("array<int>")).cast("array<string>"), ", "), F.lit("]"))
    answer = F.when(F.col("value").isNotNull(), F.concat("fact_name", F.lit(": "), "value", F.lit(" [C1]"))).otherwise(F.concat(F.lit("not found. Searched pages: "), pages))
    return rows.select("query_id", "fact_name", F.when(F.col("value").isNotNull(), "found").otherwise("not_found").alias("status"), answer.alias("answer"))
