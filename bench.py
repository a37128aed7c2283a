"""Times headline queries and prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: local cores."""

from __future__ import annotations

import importlib.util
import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = ("t1_t2_t4_triage", "l9_l10_spans", "c4_c5_c6_c7_chunks", "r1_vector_search", "r7_bm25_search", "r11_r12_hybrid", "q12_q13_plans", "f1_f6_facts", "y2_y5_list_items", "v2_verify_items")


def main() -> None:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from plumbline import queries
    from plumbline.operators import search, segments
    from plumbline.sources import corpus, tables

    took: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name, make) -> float:
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
        return took[name]

    spark.read.parquet(f"{SF}/documents.parquet").count()
    pages = corpus.pages(spark, SF).count()
    rates["ingest_pages_per_s"] = round(pages / timed("flagship", lambda: queries.flagship(spark, SF)), 1)
    for name in HEADLINES:
        timed(name, lambda name=name: queries.QUERIES[name](spark, SF))

    # search rates over stored chunks and index, by batch size
    rows = queries.chunk_rows(spark, SF).persist()
    vectors = rows.select("doc_id", "chunk_id", "page_numbers", "embedding")
    index = tuple(x.persist() for x in search.bm25_index(rows))
    rates["index_chunks_per_s"] = round(rows.count() / max(1e-9, _time(lambda: [x.count() for x in index])), 1)
    at = tables.scratch(spark, "index")
    rates["segment_chunks_per_s"] = round(rows.count() / _time(lambda: segments.add(rows, at)), 1)
    grown = segments.open_index(spark, at)
    asked = queries.query_rows(spark, SF).persist()
    n = asked.count()
    for batch in (1, 10, 200):
        part = asked.orderBy("query_id").limit(min(batch, n)).select("*", F.explode(F.sequence(F.lit(1), F.lit(max(1, batch // n)))).alias("copy"))
        part = part.withColumn("query_id", F.col("query_id") * 1000 + F.col("copy")).drop("copy").persist()
        part.count()
        for name, make in (("vector", lambda part=part: search.vector_search(vectors, part)), ("bm25", lambda part=part: search.bm25_search(index, part)), ("skipping", lambda part=part: segments.search(grown, part, keep=tables.written)), ("hybrid", lambda part=part: search.hybrid_search(vectors, index, part))):
            rates[f"{name}_queries_per_s_batch_{batch}"] = round(batch / _time(lambda make=make: make().write.format("noop").mode("overwrite").save()), 2)
    spark.catalog.clearCache()

    if importlib.util.find_spec("plumbline.llm"):
        from plumbline.llm import queries as llm

        for name, query in llm.QUERIES.items():
            timed(name, lambda query=query: query(spark, SF))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": SF}))


def _time(run) -> float:
    began = time.time()
    run()
    return time.time() - began


if __name__ == "__main__":
    main()
