"""Tables: registration, keyed writes, contracts, lookups, versions, integrity. Parquet has no MERGE: these give the rows to write."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.frames import union
from plumbline.operators.search import bm25_index, ranked

# Fixed value: the URL namespace of name-based UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
CHUNK_KEY = ["doc_id", "macro_id", "child_id"]
CHUNK_TYPES, DECISIONS, SOURCES = ["narrative", "table", "heading", "boilerplate"], ["native_only", "di_required"], ["di", "native"]

POLYGONS = "polygons array<struct<page_number:int,polygon:array<struct<x:double,y:double>>>>"
DOCUMENTS = "doc_id string, filename string, sha256 string, page_count int, created_at timestamp"
PAGES = "doc_id string, page_number int, triage_metrics struct<text_length:int,text_density:double,image_coverage_ratio:double,layout_complexity_score:double>, triage_decision string, reason_codes array<string>, di_json_path string"
CHUNKS = f"chunk_id string, doc_id string, page_numbers array<int>, macro_id int, child_id int, chunk_type string, text_content string, char_start int, char_end int, heading_path string, section_id string, source_type string, embedding array<float>, embedding_model string, embedding_dim int, {POLYGONS}"
FACTS = f"doc_id string, fact_name string, value string, status string, confidence double, source_chunk_id string, page_numbers array<int>, evidence_excerpt string, {POLYGONS}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or, on one machine without it, below /tmp."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its plan ends here, and a lost executor costs no stage before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_uuid(sha: Column) -> Column:
    """UUID version 5 of a content digest in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(sha, "UTF-8")))
    variant = F.lpad(F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128))), 2, "0")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def register(new: DataFrame, existing: DataFrame, content: str = "text", order: str = "doc_id") -> DataFrame:
    """New rows whose content is new: the first of each digest that `existing` (sha256) doesn't have."""
    rows = new.withColumn("sha256", F.sha2(F.col(content), 256))
    return ranked(rows, ["sha256"], [F.col(order)], 1).drop("rank").join(existing.select("sha256"), "sha256", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of both, the new one where keys meet; `order` says which of several new rows is last."""
    both = union(old.withColumn("batch_", F.lit(0)), new.withColumn("batch_", F.lit(1)))
    return ranked(both, keys, [F.desc("batch_"), *(order or [])], 1).drop("rank", "batch_")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of `new` to append: first of each key, keys that `old` lacks."""
    return ranked(new, keys, order, 1).drop("rank").join(old.select(*keys), keys, "left_anti")


def keep_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return ranked(rows, keys, [F.desc(seq)], 1).drop("rank")


def fill_chunk_type(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk_type", F.coalesce("chunk_type", F.when(F.col("text_content").startswith("[TABLE]"), "table").otherwise("narrative")))


def not_yet_chunked(docs: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    return docs if force else docs.join(chunks.select("doc_id"), "doc_id", "left_anti")


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Forced reprocessing: rows of the new documents take the place of all their old ones."""
    return union(old.join(new.select("doc_id").distinct(), "doc_id", "left_anti"), new)


def schema_errors(tables: dict[str, tuple[DataFrame, str]]) -> list[str]:
    """Missing columns and wrong types of all tables together; a schema is DDL."""
    out = []
    for name, (df, ddl) in sorted(tables.items()):
        wanted = T.StructType.fromDDL(ddl)
        have = {f.name: f.dataType for f in df.schema}
        out += [f"{name}.{f.name}: missing" for f in wanted if f.name not in have]
        out += [f"{name}.{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in wanted if f.name in have and have[f.name] != f.dataType]
    return out


def schema_report(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per table: table_name, n_rows, and its errors in one text, empty where it keeps its contract."""
    rows = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit("; ".join(schema_errors({name: (df, ddl)}))).alias("errors")) for name, (df, ddl) in sorted(tables.items())]
    return union(*rows)


def check_schemas(tables: dict[str, tuple[DataFrame, str]]) -> None:
    if found := schema_errors(tables):
        raise ValueError("schema contract: " + "; ".join(found))


def violations(rows: DataFrame, required: list[str], enums: dict[str, list[str]], dim: tuple[str, int] | None = None) -> DataFrame:
    """Adds `violations`: null required fields, values outside enumerations, a vector of the wrong length."""
    checks = [F.when(F.col(c).isNull(), f"{c}: null") for c in required]
    checks += [F.when(~F.col(c).isin(values), f"{c}: value") for c, values in enums.items()]
    if dim:
        checks.append(F.when(F.size(dim[0]) != dim[1], f"{dim[0]}: length"))
    return rows.withColumn("violations", F.filter(F.array(*checks), lambda v: v.isNotNull()))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def corpus_version(chunks: DataFrame, created: str = "created_at") -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.concat_ws(":", F.count("*").cast("string"), F.max(created).cast("string")).alias("corpus_version"))


def index_state(versions: DataFrame, index: DataFrame) -> DataFrame:
    """fresh, stale or missing for each document."""
    rows = versions.join(index.select("doc_id", F.col("corpus_version").alias("indexed")), "doc_id", "left")
    return rows.withColumn("state", F.when(F.col("indexed").isNull(), "missing").when(F.col("indexed") == F.col("corpus_version"), "fresh").otherwise("stale"))


def require_fresh(states: DataFrame) -> None:
    """Raises if any document's index is stale or missing (ten are named)."""
    bad = states.filter("state <> 'fresh'").select("doc_id", "state").limit(10).collect()
    if bad:
        raise ValueError("lexical index: " + ", ".join(f"{r.doc_id} {r.state}" for r in bad))


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    return children.join(parents.select("doc_id"), "doc_id", "left_anti")


def cascade(children: DataFrame, kept: DataFrame) -> DataFrame:
    return children.join(kept.select("doc_id"), "doc_id", "left_semi")


def facts_of(docs: DataFrame, facts: DataFrame) -> DataFrame:
    return docs.join(facts, "doc_id", "left")


def _save_part(part: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    part.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}")
    return part.sparkSession.read.parquet(f"{path}/{name}").drop("bucket")


def save_index(index: tuple[DataFrame, ...], path: str, buckets: int = 16) -> None:
    """Writes the parts of a lexical index, partitioned by a bucket of the document."""
    for name, part in zip(("postings", "terms", "chunks"), index, strict=True):
        _save_part(part, path, name, buckets)


def index_written(chunks: DataFrame, path: str, buckets: int = 16) -> tuple[DataFrame, ...]:
    """The index of chunks, saved as `save_index` does, but part by part: postings are made once, and weights from the written ones."""
    return bm25_index(chunks, lambda part, name: _save_part(part, path, name, buckets))


def load_index(spark, path: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{path}/{name}").drop("bucket") for name in ("postings", "terms", "chunks"))


def newest_first(docs: DataFrame, created: str = "created_at") -> DataFrame:
    return docs.orderBy(F.desc(created), "doc_id")


def numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with `place`, from 0: numbers within the tasks of the sort, and a running total of one count a task."""
    of_task = F.monotonically_increasing_id()
    own = written(rows.withColumns({"task_": F.shiftright(of_task, 33), "own_": of_task.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    earlier = Window.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("task_").count().select("task_", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start_"))
    return own.join(starts, "task_").withColumn("place", F.col("start_") + F.col("own_")).drop("task_", "own_", "start_")
