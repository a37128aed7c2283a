"""Helpers shared by the operators: table access and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import prepare

FILTER_BITS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and there is one machine (tests), a local one of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("plumbline.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("plumbline.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    It cuts the lineage: a lost executor costs the running stage, not the stages before. The
    table stays until it is discarded, or whoever owns the shared folder clears it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.staged_path = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: all that was made of them must be written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes of text each; one longer text makes a batch alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def same_file(path: str) -> str:
    """path, or where this worker has the file of that name, if it is elsewhere there."""
    return path if os.path.exists(path) else tokenizer_path(os.path.basename(path))


def _filter_bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each id (ids are hashes: their own parts serve)."""
    return ids & (FILTER_BITS - 1), (ids >> 32) & (FILTER_BITS - 1)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size (1 MB) over hashed ids; it saves work and never decides a result."""
    bits = ids.select(F.explode(F.expr(f"array({column} & {FILTER_BITS - 1}, shiftright({column}, 32) & {FILTER_BITS - 1})")).alias("bit"))
    found = bits.groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words


def maybe_in(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    a, b = _filter_bits(ids)
    return ((words[a >> 6] >> (a & 63)) & (words[b >> 6] >> (b & 63)) & 1).astype(bool)
