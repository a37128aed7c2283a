"""Top documents of many queries by lexical score, by reading impact-sorted lists from the front only (NRA).

Terms are maximal runs of ASCII letters, ASCII digits and characters beyond ASCII, A-Z lower-cased. All numbers
after a term's weight are whole: weight w = floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 75 + (25 n N) div L,
and a document scores the sum of w * ((10**9 tf) div (1000 tf + 12 m)) over the query's terms, repeats included.

One pass over the texts keeps, for each piece of documents, the counts of the queries' terms; statistics
are sums over all pieces. Then every task takes its documents in blocks: a block's lists, one for each term,
are sorted by impact and read in turn, twice as far each time. A document has a lower bound (what was read)
and an upper bound (plus the next impact of each list in which it was not met). Reading goes on until no
document outside can reach the k-th lower bound, ties included, and every document that can has equal bounds.
The k-th score so far also stands as a floor for the task's next blocks. Documents are never grouped by term,
so frequent terms and hot sources make no large task; a task gives k rows a query at most.

Queries are held by every task in chunks of about CHUNK_BYTES of text, one pass of pieces for each chunk.
Equal query texts are scored once. Null and empty texts have no terms: such queries get no rows, such documents
don't count. Repeated documents are ranked each; ties go to the smaller id, rows without an id come last
among equal scores. Whole texts count, however long. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import blocks, discard, staged

CHUNK_BYTES = 4 << 20
#: Postings of a block, about; lists are sorted in memory.
BLOCK = 1 << 21
#: First stretch read of each list.
STRETCH = 64
# A-Z to a-z; what separates terms to a space. Bytes beyond ASCII are parts of terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PIECES = "ids array<long>, sizes binary, at binary, terms binary, counts binary, n_docs long, n_terms long"


def text_terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def pieces_of(docs: DataFrame, vocabulary: dict[bytes, int], id_: str, text: str) -> DataFrame:
    """Documents with a term, by pieces: ids, numbers of terms, and counts of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            for part in blocks([batch], "text", 4 << 20):
                ids, sizes, at, terms, counts = [], [], [], [], []
                for i, x in zip(part.column("id").to_pylist(), part.column("text"), strict=True):
                    words = text_terms(x.as_py())
                    if not words:
                        continue
                    found = Counter(map(number.get, words))
                    found.pop(None, None)
                    at += [len(ids)] * len(found)
                    terms += found.keys()
                    counts += found.values()
                    ids.append(i)
                    sizes.append(len(words))
                if ids:
                    packed = {"sizes": sizes, "at": at, "terms": terms, "counts": counts}
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())), **{k: pa.array([np.array(v, np.int64).tobytes()]) for k, v in packed.items()}, "n_docs": [len(ids)], "n_terms": [sum(sizes)]})

    return docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(count, PIECES)


def _frequencies(pieces: DataFrame, n: int) -> np.ndarray:
    """Documents that hold each of the n terms."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column("terms"):
                df += np.bincount(np.frombuffer(x.as_py(), np.int64), minlength=n)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": held, "df": df[held]})

    found = pieces.select("terms").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(n, np.int64)
    df[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return df


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, floor: int = 0, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (of n) that can be among the first k, their exact scores, and how many entries were read.

    lists: documents and impacts above 0, impacts falling. Documents with a score below `floor` don't matter.
    """
    lower = np.zeros(n, np.int64)
    read = [0] * len(lists)
    while True:
        for t, (docs, impacts) in enumerate(lists):
            till = min(len(docs), max(stretch, 2 * read[t]))
            lower[docs[read[t] : till]] += impacts[read[t] : till]  # a document is in a list once
            read[t] = till
        ahead = [int(impacts[r]) if r < len(impacts) else 0 for (_, impacts), r in zip(lists, read, strict=True)]
        least = max(1, floor, int(np.partition(lower, n - k)[n - k]) if n >= k else 0)
        unseen = sum(ahead)
        if unseen < least:
            upper = lower + unseen
            for (docs, _), r, next_ in zip(lists, read, ahead, strict=True):
                if next_:
                    upper[docs[:r]] -= next_
            open_ = np.flatnonzero(upper >= least)
            if (upper[open_] == lower[open_]).all():
                return open_, lower[open_], sum(read)


def top_documents(pieces: DataFrame, queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query, id, score: of each task, the first k documents of each query (terms with their times)."""
    shared = pieces.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in asked]

        def block(held: list[tuple]) -> None:
            ids = pa.concat_arrays([h[0] for h in held])
            null, number = np.array(ids.is_null()), np.array(ids.fill_null(0))
            first = np.cumsum([0, *(len(h[0]) for h in held)])
            sizes, terms, counts = (np.concatenate([h[j] for h in held]) for j in (1, 3, 4))
            at = np.concatenate([h[2] + f for h, f in zip(held, first, strict=False)])
            norm = np.array([75 + 25 * int(s) * n_docs // n_terms for s in sizes], np.int64)
            unit = 1_000_000_000 * counts // (1000 * counts + 12 * norm[at])
            order = np.lexsort((-unit, terms))
            at, terms, unit = at[order], terms[order], unit[order]
            start = np.searchsorted(terms, np.arange(len(weight) + 1))
            for q, own in enumerate(asked):
                lists = [(at[start[t] : start[t + 1]], unit[start[t] : start[t + 1]] * (weight[t] * times)) for t, times in own.items() if weight[t] and start[t] < start[t + 1]]
                lists = [(d[: np.count_nonzero(x)], x[: np.count_nonzero(x)]) for d, x in lists]
                score, doc, none = best[q]
                found, exact, _ = resolve(lists, len(number), k, int(score[-1]) if len(score) == k else 0)
                score, doc, none = np.r_[score, exact], np.r_[doc, number[found]], np.r_[none, null[found]]
                order = np.lexsort((doc, none, -score))[:k]
                best[q] = score[order], doc[order], none[order]

        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                arrays = [np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in ("sizes", "at", "terms", "counts")]
                held.append((batch.column("ids")[row].values, *arrays))
                size += len(arrays[1]) + len(arrays[0])
                if size >= BLOCK:
                    block(held)
                    held, size = [], 0
        if held:
            block(held)
        for q, (score, doc, none) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_pydict({"query": np.full(len(score), q), "id": pa.array(doc, mask=none), "score": score})

    return pieces.select("ids", "sizes", "at", "terms", "counts").mapInArrow(run, "query long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_: str = "doc_id", text: str = "text", item: str = "item_id", asked: str = "text") -> DataFrame:
    """item, rank (from 1), id_, score: each item's first k documents with a score above 0."""
    spark = docs.sparkSession
    named = items.select(F.col(item).cast("long").alias("item"), F.col(asked).alias("asked")).filter("asked is not null")
    chunks = max(1, math.ceil((named.agg(F.sum(F.octet_length("asked"))).first()[0] or 0) / CHUNK_BYTES))
    out = []
    for chunk in range(chunks):
        rows = named.filter(F.pmod(F.xxhash64("asked"), F.lit(chunks)) == chunk).collect()
        texts = {x: q for q, x in enumerate(dict.fromkeys(r["asked"] for r in rows))}
        words = [Counter(text_terms(x)) for x in texts]
        vocabulary = {w: t for t, w in enumerate(dict.fromkeys(w for own in words for w in own))}
        pieces = staged(pieces_of(docs, vocabulary, id_, text), "pieces")
        size = pieces.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
        weights = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * int(df) + 1))) for df in _frequencies(pieces, len(vocabulary))], np.int64)
        best = top_documents(pieces, [{vocabulary[w]: c for w, c in own.items()} for own in words], weights, size["docs"], size["terms"], k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        asks = spark.createDataFrame([(texts[r["asked"]], r["item"]) for r in rows], "query long, item long")
        out.append(staged(asks.join(ranked, "query").select(F.col("item").alias(item), "rank", F.col("id").alias(id_), "score"), "ranked"))
        discard(pieces)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found
