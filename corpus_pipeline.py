"""From raw documents to training sequences: classify, filter, drop near copies, cut repeats, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of `documents`. Its rows can't be given by SQL (the first two stages fit models,
the last depends on how rows lie in tasks); tests hold the near-copy, repeat and packing stages against
plain versions, and the models against plain scoring (tests/llm).

Rows without a text count as empty: the base rules drop them. Rows without an id are kept or dropped by
their text like any other. Repeated rows are judged alike in the first two stages; the third keeps one of
them. Columns besides the text, whatever their names, go with their rows; the fourth stage sets n_chars
anew. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import jaccard_join, packing, quality_classifier, quality_rules, suffix_dedup
from plumbline.llm.common import staged, table, tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is good."""
    return quality_classifier.keep_predicted(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no anomaly."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id."""
    return jaccard_join.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes, and those of more than 50 words, that also stand elsewhere; n_chars is that of the rest."""
    return suffix_dedup.without_repeats(docs, units=(suffix_dedup.BYTES, suffix_dedup.WORDS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
