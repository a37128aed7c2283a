"""Rows of vectors packed into pieces: one row of a piece holds up to a thousand vectors as bytes.

Comparing vectors in tiles moves and multiplies whole pieces; Spark deals pieces out by the keys of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1024


def whole(vector: str, scale: float = 1.0) -> Column:
    """Whether a vector is there and all of its components, times scale, are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Those rows of a list column, all of one length, as doubles."""
    return np.array(column.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), -1)


def pieces(rows: DataFrame, by: list[str], pack: Callable[[pa.RecordBatch, np.ndarray], dict], schema: str, size: int = PIECE) -> DataFrame:
    """Pieces of at most `size` rows that agree in the columns `by`, each made by pack(batch, row numbers).

    Rows of equal `by` should lie together, or pieces are small; no piece crosses an Arrow batch.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pd.DataFrame({c: batch.column(c).to_pandas() for c in by})
            made = [pack(batch, part) for own in keys.groupby(by, sort=False, dropna=False).indices.values() for part in np.split(own, range(size, len(own), size))]
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(cut, schema)
