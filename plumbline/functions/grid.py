"""Grid cells of boxes, in levels, so that boxes of any size lie in few cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the smallest cells, in page units; a level doubles it.
CELL = 32.0
#: Coordinates beyond count as this far.
FAR = 1e12


def _level(cell: float) -> Column:
    """The level at which a box spans five cells a side at most."""
    side = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.lit(cell))
    return F.greatest(F.ceil(F.log2(F.least(side, F.lit(FAR)) / (4 * cell))), F.lit(0)).cast("int")


def with_cells(boxes: DataFrame, top: int, cell: float = CELL) -> DataFrame:
    """A row for each cell (level_, cx_, cy_) that a box (x0, y0, x1, y1) touches at its own level_of_ and those above, up to top. Boxes with a null give none."""
    rows = boxes.withColumn("level_of_", _level(cell)).withColumn("level_", F.explode(F.sequence("level_of_", F.greatest(F.col("level_of_"), F.lit(top)))))
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("level_"))

    def span(a: str, b: str) -> Column:
        low, high = (F.floor(F.greatest(F.least(f(a, b), F.lit(FAR)), F.lit(-FAR)) / size).cast("long") for f in (F.least, F.greatest))
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.sequence(low, high))

    return rows.withColumn("cx_", F.explode(span("x0", "x1"))).withColumn("cy_", F.explode(span("y0", "y1")))


def top_level(*boxes: DataFrame, cell: float = CELL) -> int:
    return max(df.agg(F.coalesce(F.max(_level(cell)), F.lit(0))).first()[0] for df in boxes)
