"""Query classification and text flags: ordered rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.textnorm import any_pattern, any_phrase


def page_numbers(query: Column) -> Column:
    """Sorted distinct pages named by a query; a reversed range names none, nor does a number beyond an int."""
    single = [F.transform(F.regexp_extract_all(query, F.lit(f"(?i){p}"), F.lit(1)), lambda x: x.try_cast("int")) for p in rules.LOCATION[:2]]
    lows, highs = (F.regexp_extract_all(query, F.lit(f"(?i){rules.LOCATION[2]}"), F.lit(g)) for g in (1, 2))
    ranges = F.flatten(F.zip_with(lows, highs, lambda a, b: F.when(a.try_cast("int") <= b.try_cast("int"), F.sequence(a.try_cast("int"), b.try_cast("int"))).otherwise(F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*single, ranges))))


def coverage_type(query: Column) -> Column:
    numeric = any_pattern(query, [r"\bitems of note\b"]) & any_pattern(query, [r"\bnet income\b", r"\baggregate impact\b", r"\baggregate\b"])
    rules_ = F.when(any_pattern(query, rules.POINTER_TERMS), "pointer").when(numeric, "numeric_list").when(any_pattern(query, rules.LIST_TERMS), "list")
    return rules_.when(any_pattern(query, rules.ATTRIBUTE_TERMS), "attribute").otherwise("list")


def classify(queries: DataFrame) -> DataFrame:
    """Adds pages, intent, coverage_type, status_filter."""
    q = F.col("query")
    pointer, closed = any_pattern(q, rules.POINTER_TERMS), any_pattern(q, rules.CLOSED_TERMS)
    coverage = any_pattern(q, rules.COVERAGE_TERMS) | any_pattern(q, rules.ATTRIBUTE_TERMS)
    rows = queries.withColumn("pages", page_numbers(q))
    located = F.size("pages") > 0
    kind = F.when(located, F.lit(None)).when(pointer, "pointer").when(closed, "list").when(coverage, coverage_type(q))
    return rows.withColumns({"intent": F.when(located, "location").when(pointer | closed | coverage, "coverage").otherwise("semantic"), "coverage_type": kind, "status_filter": F.when(~located & ~pointer & closed, "closed")})


def section_target(query: Column) -> Column:
    """(label, anchor) of the first section target that a query names, or null."""
    out = F.lit(None)
    for label, pattern, anchor in reversed(rules.SECTION_TARGETS):
        out = F.when(any_pattern(query, [pattern]), F.struct(F.lit(label).alias("label"), F.lit(anchor).alias("anchor"))).otherwise(out)
    return out


def is_litigation(query: Column) -> Column:
    return any_pattern(query, rules.LITIGATION_TERMS)


def expanded(query: Column) -> Column:
    return F.concat_ws(" ", query, *map(F.lit, rules.EXPANSION))


def explicit_note(query: Column) -> Column:
    return any_pattern(query, rules.EXPLICIT_NOTE)


def filters_tables(query: Column) -> Column:
    """Whether tables are left out for a query."""
    return any_pattern(query, [r"\bitems of note\b", r"\bsignificant events\b"]) & ~explicit_note(query)


def is_table(kind: Column, text: Column) -> Column:
    return F.coalesce(kind == "table", F.lit(False)) | text.startswith("[TABLE]")


def impact_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rules.IMPACT))


def text_flags(lower: Column, raw: Column) -> dict[str, Column]:
    """Boolean flags of an anchor candidate's text (lower-case) and its chunk text."""
    signal = lower.contains("items of note") | lower.contains("specified items") | (lower.contains("reconciliation") & lower.contains("net income")) | lower.contains("impact on reported net income")
    aggregate = any_phrase(lower, rules.AGGREGATE)
    return {
        "front_matter": any_phrase(lower, rules.FRONT_MATTER),
        "reconciliation_signal": signal,
        "aggregate_phrase": aggregate,
        "reference_only": any_phrase(lower, rules.REFERENCE_ONLY) & ~((impact_count(raw) >= 2) | aggregate),
        "adjusted_definition": any_phrase(lower, rules.ADJUSTED) & (any_phrase(lower, rules.RATIO_TERMS) | ~signal),
    }


def anchor_rejections(candidates: DataFrame) -> DataFrame:
    """Adds `reasons` to candidates (query, chunk columns, coverage_type): why each can't be an items-of-note anchor."""
    raw = F.col("text_content")
    lower = F.lower(F.concat_ws(" ", "heading_path", "section_id", "text_content"))
    flags, impacts = text_flags(lower, raw), impact_count(raw)
    numeric, free = F.coalesce(F.col("coverage_type") == "numeric_list", F.lit(False)), ~explicit_note(F.col("query"))
    itemised = (impacts >= 2) | flags["aggregate_phrase"]
    other_note = lower.rlike(r"\bnote\s+\d+\b") & ~lower.rlike(r"items of note\s+\d+")
    checks = [
        ("reject_chunk_type", ~F.col("chunk_type").isin("narrative", "heading") | raw.startswith("[TABLE]")),
        ("missing_positive_phrase", ~any_phrase(lower, rules.POSITIVE)),
        ("front_matter_reference", numeric & flags["front_matter"]),
        ("reject_adjusted_measures_definition", numeric & flags["adjusted_definition"]),
        ("missing_reconciliation_signal", numeric & ~flags["reconciliation_signal"]),
        ("reject_reconciliation_reference_only", numeric & flags["reference_only"]),
        ("missing_itemization_or_aggregate", numeric & ~itemised),
        ("negative_phrase", free & any_phrase(lower, rules.NEGATIVE)),
        ("negative_note_reference", free & other_note),
    ]
    return candidates.withColumn("reasons", F.filter(F.array(*(F.when(c, name) for name, c in checks)), lambda r: r.isNotNull()))
