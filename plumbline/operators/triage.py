"""Page triage: text density, layout complexity, image coverage, reasons, decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.textnorm import strip

LOW_TEXT, HIGH_IMAGE, HIGH_LAYOUT = 50, 0.35, 0.6


def text_metrics(text: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Length of the stripped text, and its share of the area (0 without an area)."""
    n, area = F.length(strip(text)), width * height
    return n.alias("text_length"), F.when(area > 0, n / area).otherwise(0.0).alias("text_density")


def layout_complexity(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Short lines and line density of each page (doc_id, page_number, width, height), 0 without words."""
    lines = words.groupBy("doc_id", "page_number", "block_no", "line_no").count()
    per = lines.groupBy("doc_id", "page_number").agg(F.count("*").alias("lines"), F.sum(F.when(F.col("count") <= 3, 1).otherwise(0)).alias("short"))
    density = F.least(F.lit(1.0), F.col("lines") / F.greatest(F.col("width") * F.col("height") / 100000.0, F.lit(1.0)) / 3.0)
    score = F.least(F.lit(1.0), 0.6 * F.col("short") / F.col("lines") + 0.4 * density)
    return pages.join(per, ["doc_id", "page_number"], "left").withColumn("layout_complexity", F.coalesce(score, F.lit(0.0))).drop("lines", "short")


def image_coverage(pixels: DataFrame, bright: int = 245) -> DataFrame:
    """Share of pixels of RGB rows (doc_id, page_number, samples binary) with a channel below `bright`."""
    import numpy as np

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            share = [float((np.frombuffer(s, np.uint8).reshape(-1, 3) < bright).any(axis=1).mean()) if s else 0.0 for s in part["samples"]]
            yield part[["doc_id", "page_number"]].assign(image_coverage=share)

    return pixels.mapInPandas(run, "doc_id string, page_number int, image_coverage double")


def reasons(text_length: Column, coverage: Column, complexity: Column) -> Column:
    found = F.array(F.when(text_length < LOW_TEXT, "low_text"), F.when(coverage > HIGH_IMAGE, "high_image_coverage"), F.when(complexity > HIGH_LAYOUT, "high_layout_complexity"))
    return F.filter(found, lambda r: r.isNotNull())


def decide(pages: DataFrame) -> DataFrame:
    codes = reasons(F.col("text_length"), F.col("image_coverage"), F.col("layout_complexity"))
    return pages.withColumn("reason_codes", codes).withColumn("triage_decision", F.when(F.size("reason_codes") > 0, "di_required").otherwise("native_only"))


def force_pages(pages: DataFrame, forced: DataFrame) -> DataFrame:
    """Pages listed in `forced` (doc_id, page_number) need layout analysis, with reason force_di once."""
    rows = pages.join(forced.select("doc_id", "page_number", F.lit(True).alias("forced")).distinct(), ["doc_id", "page_number"], "left")
    hit = F.coalesce("forced", F.lit(False))
    return rows.withColumn("reason_codes", F.when(hit, F.array_union("reason_codes", F.array(F.lit("force_di")))).otherwise(F.col("reason_codes"))).withColumn("triage_decision", F.when(hit, "di_required").otherwise(F.col("triage_decision"))).drop("forced")


def disable_layout(pages: DataFrame) -> DataFrame:
    """Layout analysis switched off: pages that need it say so once; decisions stay."""
    need = F.col("triage_decision") == "di_required"
    return pages.withColumn("reason_codes", F.when(need, F.array_union("reason_codes", F.array(F.lit("di_disabled")))).otherwise(F.col("reason_codes"))).withColumn("di_json_path", F.lit(None).cast("string"))


def summary(pages: DataFrame) -> DataFrame:
    """Pages by decision for each document and in total."""
    return pages.rollup("doc_id").agg(F.count_if(F.col("triage_decision") == "di_required").alias("di_required"), F.count_if(F.col("triage_decision") == "native_only").alias("native_only"))
