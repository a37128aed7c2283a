"""Vector search by blocks: exact within documents, and over whole tables by codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import code_products, first_k, half_up, quantised, stacked, units
from plumbline.session import prepare

#: Vectors and queries that meet in one product, about.
ROWS, ASKED = 8192, 2048
CODES = "ids array<string>, dim int, codes binary, scales binary, rests binary"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3, pages: bool = False, rows_at_once: int = ROWS, asked_at_once: int = ASKED) -> DataFrame:
    """query_id, doc_id, chunk_id, score: candidates for the k nearest chunks of each query's document, k of each block.

    A document's vectors are dealt into blocks of bounded size, and so are its queries; a block of each meets in
    one matrix product. With pages, only chunks on a query's pages count. Rows without a vector take no part.
    """
    prepare(vectors.sparkSession)
    vectors, queries = vectors.filter("embedding is not null"), queries.filter("query_embedding is not null")
    parts = lambda df, n, name: df.groupBy("doc_id").agg(F.ceil(F.count("*") / n).alias(name))
    sizes = parts(vectors, rows_at_once, "parts").join(parts(queries, asked_at_once, "asks"), "doc_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    left = queries.join(sizes, "doc_id").withColumn("ask", own("query_id", "asks")).withColumn("part", every("parts"))
    right = vectors.join(sizes, "doc_id").withColumn("part", own("chunk_id", "parts")).withColumn("ask", every("asks"))
    left = left.select("doc_id", "part", "ask", "query_id", "query_embedding", *(["pages"] if pages else []))
    right = right.select("doc_id", "part", "ask", "chunk_id", "embedding", *(["page_numbers"] if pages else []))

    def best(key, asked, rows):
        if not (asked.num_rows and rows.num_rows):
            return asked.select([]).append_column("query_id", asked.column("query_id").slice(0, 0)).append_column("doc_id", asked.column("doc_id").slice(0, 0)).append_column("chunk_id", rows.column("chunk_id").slice(0, 0)).append_column("score", pa.array([], pa.float64()))
        a, b = units(stacked(asked.column("query_embedding"))), units(stacked(rows.column("embedding")))
        d = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))
        order = np.argsort(np.argsort(np.array(rows.column("chunk_id").to_pylist(), object), kind="stable"))
        on = np.ones((len(a), len(b)), bool)
        if pages:
            held = rows.column("page_numbers").combine_chunks()
            flat, of = np.array(held.flatten().fill_null(-1)), np.repeat(np.arange(len(b)), np.array(held.value_lengths().fill_null(0)))
            for i, wanted in enumerate(asked.column("pages").to_pylist()):
                on[i] = np.bincount(of[np.isin(flat, [p for p in wanted or [] if p is not None])], minlength=len(b)) > 0
        step = max(1, (1 << 22) // max(1, len(b)))
        i, j, score = [], [], []
        for at in range(0, len(a), step):
            s = np.where(on[at : at + step], half_up(a[at : at + step] @ b.T), -np.inf)
            p, q = first_k(s, order, k)
            there = s[p, q] > -np.inf
            i, j, score = [*i, p[there] + at], [*j, q[there]], [*score, s[p, q][there]]
        i, j = np.concatenate(i), np.concatenate(j)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(i)), "doc_id": asked.column("doc_id").take(pa.array(i)), "chunk_id": rows.column("chunk_id").take(pa.array(j)), "score": np.concatenate(score)})

    by = ["doc_id", "part", "ask"]
    schema = f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(queries, 'doc_id')}, chunk_id {_kind(vectors, 'chunk_id')}, score double"
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, schema)


def encode(vectors: DataFrame) -> DataFrame:
    """Blocks of codes of the rows' vectors (chunk_id, embedding): a byte a component, a scale and a bound a vector. Write it once, search it often."""
    prepare(vectors.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column("embedding").value_lengths())
            for d in np.unique(lengths):
                for part in np.split(own := np.flatnonzero(lengths == d), range(4096, len(own), 4096)):
                    rows = batch.take(pa.array(part))
                    codes, scales, rests = quantised(stacked(rows.column("embedding")))
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([rows.column("chunk_id").to_pylist()], pa.list_(pa.string())), "dim": pa.array([d], pa.int32()), "codes": [codes.tobytes()], "scales": [scales.tobytes()], "rests": [rests.tobytes()]})

    return vectors.filter("embedding is not null").select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding").mapInArrow(code, CODES)


def candidates(codes: DataFrame, queries: DataFrame, k: int, others: bool = False, tiles: tuple[int, int] = (16, 1024)) -> DataFrame:
    """query_id, chunk_id, lower, upper: of each tile, the rows whose upper bound reaches the k-th lower bound.

    tiles: blocks of codes and queries that meet in one task. With others, a row is no neighbour of itself.
    """
    n, asked = codes.count(), queries.count()
    counts = [max(1, -(-a // b)) for a, b in zip((n, asked), tiles, strict=True)]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.filter("query_embedding is not null").select("query_id", "query_embedding", F.pmod(F.xxhash64("query_id"), F.lit(counts[1])).alias("ask")).withColumn("part", every(counts[0]))
    right = codes.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(counts[0]))).withColumn("ask", every(counts[1]))

    def tile(key, asked, blocks):
        x = stacked(asked.column("query_embedding"))
        own, scale, rest = quantised(x)
        names = np.array([str(v) for v in asked.column("query_id").to_pylist()], object)
        found = []
        low = np.full((len(x), k), -np.inf)
        for row in blocks.to_pylist():
            if row["dim"] != x.shape[1]:
                continue
            codes, ids = np.frombuffer(row["codes"], np.int8).reshape(-1, row["dim"]), np.array(row["ids"], object)
            about = code_products(own, codes) / scale[:, None] / np.frombuffer(row["scales"])[None, :]
            far = np.frombuffer(row["rests"])[None, :]
            error = rest[:, None] + far + rest[:, None] * far + 1e-5
            if others:
                about[names[:, None] == ids[None, :]] = -np.inf
            low = -np.sort(-np.concatenate([low, about - error], 1), axis=1)[:, :k]
            i, j = np.nonzero((about + error >= low[:, -1:]) & (about > -np.inf))
            found.append((i, ids[j], (about - error)[i, j], (about + error)[i, j]))
        if found:
            i, ids, lower, upper = (np.concatenate(v) for v in zip(*found, strict=True))
            keep = upper >= low[i, -1]
            found = [(i[keep], ids[keep], lower[keep], upper[keep])]
        i, ids, lower, upper = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0), np.zeros(0))
        return pa.table({"query_id": asked.column("query_id").take(pa.array(i, pa.int64())), "chunk_id": pa.array(ids, pa.string()), "lower": lower, "upper": upper})

    by = ["part", "ask"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, f"query_id {_kind(queries, 'query_id')}, chunk_id string, lower double, upper double")
