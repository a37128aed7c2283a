"""Where a model comes in: token vectors of a text, pooled to one vector a text or a child of a macro window.

A model is anything with `vectors(text) -> (starts, ends, matrix)`: the offsets of its tokens and a vector for each,
made with the whole text in view. It is made by a factory, once in each Python worker, under a name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.chunking import TOKEN, _ddl
from plumbline.session import prepare


class Model(Protocol):
    def vectors(self, text: str) -> tuple[list[int], list[int], np.ndarray]: ...


_MADE: dict[str, Model] = {}


def model(name: str, make: Callable[[], Model]) -> Model:
    """The worker's model of that name; made at its first use."""
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


class WordShape:
    """A small deterministic model: a token's length, how many of its letters are e, and the length of the token before it.

    The last number is context, so equal tokens differ by what they follow. It serves checks and tests.
    """

    def vectors(self, text: str) -> tuple[list[int], list[int], np.ndarray]:
        spans = [m.span() for m in TOKEN.finditer(text)]
        size = [b - a for a, b in spans]
        rows = [(n, text.count("e", a, b), before) for (a, b), n, before in zip(spans, size, [0, *size], strict=False)]
        return [a for a, _ in spans], [b for _, b in spans], np.array(rows, float).reshape(-1, 3)


def embed_texts(rows: DataFrame, key: str, text: str, make: Callable[[], Model], name: str) -> DataFrame:
    """key and vector: the mean of a text's token vectors, not normalised; null where a text has no token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(name, make)
        for batch in batches:
            found = [own.vectors(t or "")[2] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x.mean(0).tolist() if len(x) else None for x in found], pa.list_(pa.float64()))], names=["key", "vector"])

    prepare(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vector array<double>").withColumnRenamed("key", key)


def child_vectors(pages: DataFrame, make: Callable[[], Model], name: str, child: int = 256, size: int = 8192, overlap: int = 256) -> DataFrame:
    """doc_id, page_number, macro_no, child_id, n_tokens, vector: late pooling in one pass over page texts.

    The model sees a macro window (`size` of its tokens, windows overlap) at once; a child's vector is the mean
    of its tokens' vectors from that pass. Windows are cut by the model's own tokens of the page.
    """
    step = size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(name, make)
        for batch in batches:
            at, rows = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                starts, ends, _ = own.vectors(text or "")
                n = len(starts)
                for macro, first in enumerate(range(0, n, step)):
                    if first and first >= n - overlap:
                        break
                    last = min(first + size, n)
                    seen = own.vectors(text[starts[first] : ends[last - 1]])[2]
                    for number in range(-(-len(seen) // child)):
                        part = seen[number * child : (number + 1) * child]
                        at.append(row)
                        rows.append((macro, number, len(part), part.mean(0).tolist()))
            keys = batch.take(pa.array(at, pa.int64())).select(["doc_id", "page_number"])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "page_number", "macro_no", "child_id", "n_tokens", "vector"])

    prepare(pages.sparkSession)
    return pages.select("doc_id", "page_number", "text").mapInArrow(run, f"{_ddl(pages, 'doc_id', 'page_number')}, macro_no int, child_id int, n_tokens long, vector array<double>")
