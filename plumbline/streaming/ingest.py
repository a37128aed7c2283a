"""Incremental ingest: micro-batches of pages and chunks into keyed tables, safe to replay.

A table is a log of runs, folders run=<first>-<last> of batch numbers. A batch writes a run of its own rows, one row
a key, and nothing else, so the bytes written follow the batch; a replay writes the same folder again. After every
fourth, sixteenth, ... batch the runs of the last 4, 16, ... batches are merged into one, so that a row is
written about log(batches) times and few runs are read. Reading takes the runs that lie in no other complete
run and, of each key, the row of the last batch (or of the first, where the first wins).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.frames import union
from plumbline.operators import triage
from plumbline.operators.search import ranked
from plumbline.sources import tables

FANOUT = 4


@dataclass(frozen=True)
class Keyed:
    """Which columns make a key, whether the last batch wins or the first, and what wins within a batch."""

    keys: tuple[str, ...]
    last: bool
    order: str
    falling: bool = False

    def within(self) -> Column:
        return F.desc(self.order) if self.falling else F.asc(self.order)


PAGES = Keyed(("doc_id", "page_number"), True, "text", True)
CHUNKS = Keyed(tuple(tables.CHUNK_KEY), False, "chunk_id")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def runs(spark: SparkSession, path: str, before: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The complete runs (of batches before one) that count, in order, and those that lie in another complete run."""
    fs, at = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [tuple(map(int, n[4:].split("-"))) for n in names if n.startswith("run=") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]
    found = [r for r in found if before is None or r[1] < before]
    inside = [r for r in found if any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]
    return sorted(set(found) - set(inside)), sorted(inside)


def _folder(path: str, run: tuple[int, int]) -> str:
    return f"{path}/run={run[0]:012d}-{run[1]:012d}"


def _resolved(spark: SparkSession, path: str, some: list[tuple[int, int]], keyed: Keyed) -> DataFrame:
    rows = union(*(spark.read.parquet(_folder(path, r)).withColumn("run_", F.lit(r[0])) for r in some))
    return ranked(rows, list(keyed.keys), [F.desc("run_") if keyed.last else F.asc("run_")], 1).drop("rank", "run_")


def read_table(spark: SparkSession, path: str, keyed: Keyed) -> DataFrame:
    """One row a key. Columns are those of the first run."""
    return _resolved(spark, path, runs(spark, path)[0], keyed)


def append(batch: DataFrame, batch_id: int, path: str, keyed: Keyed) -> None:
    """Writes a batch as a run, merges runs where their number is due, and removes those that were merged before this batch."""
    spark = batch.sparkSession
    fs, _ = _fs(spark, path)
    for old in runs(spark, path, batch_id)[1]:
        fs.delete(_fs(spark, _folder(path, old))[1], True)
    ranked(batch, list(keyed.keys), [keyed.within()], 1).drop("rank").write.mode("overwrite").parquet(_folder(path, (batch_id, batch_id)))
    size = FANOUT
    while (batch_id + 1) % size == 0:
        first = batch_id + 1 - size
        counted = runs(spark, path, batch_id + 1)[0]
        if any(r[0] <= first and batch_id <= r[1] for r in counted):  # a replay: merged before
            break
        some = [r for r in counted if r[0] >= first]
        _resolved(spark, path, some, keyed).write.mode("overwrite").parquet(_folder(path, (first, batch_id)))
        size *= FANOUT


def ingest_pages(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, files: int = 1):
    """Pages (doc_id, page_number, text, width, height, image_coverage, layout_complexity) → triage → last write wins."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    judged = triage.decide(pages.withColumns(dict(zip(("text_length", "text_density"), triage.text_metrics(F.col("text"), F.col("width"), F.col("height")), strict=True))))
    return judged.writeStream.foreachBatch(lambda batch, number: append(batch, number, table, PAGES)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_chunks(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, files: int = 1):
    """Chunks → insert if absent on (doc_id, macro_id, child_id), first wins."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return rows.writeStream.foreachBatch(lambda batch, number: append(batch, number, table, CHUNKS)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
