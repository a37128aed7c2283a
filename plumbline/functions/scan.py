"""Running aggregates over the pages of a document, in two levels, so that no task sees a whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of a range.
RANGE = 1024
_OVER = {"max": F.max, "min": F.min, "sum": F.sum}


def _joined(kind: str, a: Column, b: Column) -> Column:
    return {"max": F.greatest, "min": F.least}[kind](a, b) if kind != "sum" else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def before(pages: DataFrame, kinds: dict[str, str], at_once: int = RANGE) -> DataFrame:
    """doc_id, page_number and, for each column of kinds (max, min or sum), its aggregate over the document's earlier pages.

    One row a page. Pages are summed up by ranges of page numbers, ranges are scanned by document, pages within
    their range; a scan's task holds at most a range of pages, or one row for each range. Nulls count for nothing.
    """
    rows = pages.withColumn("range_", F.floor(F.col("page_number") / at_once))
    ranges = rows.groupBy("doc_id", "range_").agg(*(_OVER[k](c).alias(c) for c, k in kinds.items()))
    earlier = Window.partitionBy("doc_id").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("doc_id", "range_", *(_OVER[k](c).over(earlier).alias(f"{c}_carried") for c, k in kinds.items()))
    within = Window.partitionBy("doc_id", "range_").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("doc_id", "page_number", "range_", *(_OVER[k](c).over(within).alias(c) for c, k in kinds.items()))
    return own.join(carried, ["doc_id", "range_"]).select("doc_id", "page_number", *(_joined(k, F.col(c), F.col(f"{c}_carried")).alias(c) for c, k in kinds.items()))
