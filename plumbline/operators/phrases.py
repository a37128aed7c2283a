"""All phrases of all queries in one pass over each text, by an automaton (Aho-Corasick)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import union
from plumbline.session import prepare

#: Code points of the phrases of one automaton, about; more phrases take more passes.
CHARS = 4 << 20


def _automaton(phrases: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in phrases:
        if p:
            found.add_word(p, p)
    found.make_automaton()
    return found


def occurring(rows: DataFrame, key: str, text: Column, phrases: DataFrame, chars: int = CHARS) -> DataFrame:
    """key, phrase: which of the phrases (column phrase) each text holds, each once.

    Texts and phrases are compared as they are; lower both for any case. A text is scanned once for all phrases of
    a pass; the phrases of a pass are held by every task, about `chars` code points of them. The empty phrase
    is in every text that isn't null.
    """
    spark = prepare(rows.sparkSession)
    wanted = phrases.select(F.col("phrase").cast("string").alias("phrase")).filter("phrase is not null").distinct()
    passes = max(1, -(-int(wanted.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0]) // chars))
    texts = rows.select(F.col(key).alias("key"), text.alias("text")).filter("text is not null")
    kind = rows.schema[key].dataType.simpleString()
    out = []
    for part in range(passes):
        own = [r["phrase"] for r in wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == part).collect()]
        shared = spark.sparkContext.broadcast(own)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found, every = _automaton(shared.value), "" in shared.value
            for batch in batches:
                at, names = [], []
                for row, t in enumerate(batch.column("text").to_pylist()):
                    hits = {p for _, p in found.iter(t)} if len(found) else set()
                    hits |= {""} if every else set()
                    at += [row] * len(hits)
                    names += hits
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(names, pa.string())], names=["key", "phrase"])

        out.append(texts.mapInArrow(scan, f"key {kind}, phrase string"))
    return union(*out).withColumnRenamed("key", key)
