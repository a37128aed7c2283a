"""Views of the test tables in the shape of the data model. The SQL is portable, so checks can use it too.

`pages`: documents as pages of documents of their source, at most BLOCK pages each. `finance_chunks`,
`finance_queries`: whole rows of `documents` and `benchmark`, most of them after a sentence with the
vocabulary that the rule tables react to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import chunking, layout
from plumbline.session import prepare
from plumbline.sources.tables import written

#: Documents of a source are cut by id, so that no window over a document grows with the table.
BLOCK = 4096
_BLOCK_NO = f"CAST(floor(doc_id / {BLOCK}) AS BIGINT)"
PAGES = f"""SELECT concat(source, '.', CAST({_BLOCK_NO} AS STRING)) AS doc_id,
    CAST(row_number() OVER (PARTITION BY source, {_BLOCK_NO} ORDER BY doc_id) AS INT) AS page_number, text, doc_id AS page_id FROM documents"""

_AMOUNT = "CAST(1 + page_id % 9 AS STRING)"
CHUNKS = f"""
SELECT doc_id, concat('c-', CAST(page_id AS STRING)) AS chunk_id, page_number, page_id,
    CAST(page_number - 1 AS INT) AS macro_id, CAST(page_id % 3 AS INT) AS child_id,
    CASE WHEN page_id % 12 IN (3, 9) THEN 'table' WHEN page_id % 12 = 8 THEN 'heading' ELSE 'narrative' END AS chunk_type,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 12 = 4 THEN 'report/Basis of presentation' WHEN page_id % 3 = 0 THEN 'report/Note 21/Significant legal proceedings' WHEN page_id % 3 = 1 THEN 'report/Items of note' ELSE 'report/Significant events' END AS heading_path,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'Significant legal proceedings' WHEN page_id % 3 = 1 THEN 'Items of note' ELSE 'Significant events' END AS section_id,
    concat(CASE CAST(page_id % 12 AS INT)
        WHEN 0 THEN concat('Items of note: 1) FDIC special assessment ($0.', {_AMOUNT}, ' billion after tax) 2) Acquisition-related intangibles ($0.', {_AMOUNT}, ' billion after tax). Aggregate impact $0.', CAST(2 * (1 + page_id % 4) AS STRING), ' billion.')
        WHEN 1 THEN concat('Adjusted measures are non-GAAP measures. Common shareholders'' equity divided by assets, ratio ', {_AMOUNT}, '%.')
        WHEN 2 THEN 'Items of note. See the Glossary for definitions and cross-reference.'
        WHEN 3 THEN '[TABLE] Items of note consolidated financial statements'
        WHEN 4 THEN concat('All amounts are in Canadian dollars unless otherwise stated. For the year ended October 31, 20', CAST(10 + page_id % 15 AS STRING), ' under IFRS.')
        WHEN 5 THEN concat('Smith v. Royal Bank of Commerce was settled for $', {_AMOUNT}, ' million. The Fresco matter was discontinued. The Cerberus matter is open.')
        WHEN 6 THEN concat('The range of reasonably possible losses is from nil to approximately $0.', {_AMOUNT}, ' billion. Litigation: the Frayce class action was closed.')
        WHEN 7 THEN 'Results are adjusted to exclude the impact of items of note. For additional information, see the reconciliation.'
        WHEN 8 THEN 'Note 21 Significant legal proceedings'
        WHEN 9 THEN '[TABLE] Note 12 Derivative instruments'
        WHEN 10 THEN concat('All amounts are in U.S. millions. Consolidated GAAP statements, page ', CAST(page_number AS STRING), '.')
        ELSE '' END, CASE WHEN page_id % 12 = 11 THEN '' ELSE chr(10) END, text) AS text_content
FROM pages"""

QUERIES = """
SELECT CAST(item_id AS BIGINT) AS query_id, concat('src', CAST(item_id % 20 AS STRING), '.', CAST(item_id % (SELECT 1 + CAST(floor(max(doc_id) / 4096) AS BIGINT) FROM documents) AS STRING)) AS doc_id,
    concat(CASE CAST(item_id % 16 AS INT)
        WHEN 0 THEN concat('See page ', CAST(1 + item_id % 40 AS STRING), ' for details')
        WHEN 1 THEN 'list all significant events'
        WHEN 2 THEN 'Which matters are explicitly closed and what closed them'
        WHEN 3 THEN 'What is the CET1 ratio?'
        WHEN 4 THEN 'List the items of note affecting 2024 net income and the aggregate impact'
        WHEN 5 THEN 'Where can I find the discussion of significant events?'
        WHEN 6 THEN 'What is the aggregate range of reasonably possible losses? total amount'
        WHEN 7 THEN concat('pages ', CAST(2 + item_id % 5 AS STRING), '-', CAST(4 + item_id % 3 AS STRING))
        WHEN 8 THEN 'pages 5-3'
        WHEN 9 THEN 'S&P 500 total return'
        WHEN 10 THEN 'list me all litigation events'
        WHEN 11 THEN 'What is the default currency?'
        WHEN 12 THEN 'Note 12 derivative instruments, items of note'
        WHEN 13 THEN 'every legal proceedings exposure in note 21'
        WHEN 14 THEN 'Which units and which reporting period?'
        ELSE '' END, CASE WHEN item_id % 16 = 15 THEN '' ELSE ' ' END, text) AS query
FROM benchmark"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    prepare(spark)
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def pages(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """All pages; with asked (doc_id), those of its documents: a semi-join before anything is sorted or shuffled.

    What a query wants of one document (scores, places, sections) comes from that document alone, so a batch
    of queries needs its own documents whole and no others.
    """
    tables(spark, sf_dir, "documents")
    if asked is None:
        return spark.sql(PAGES)
    name = F.expr(f"concat(source, '.', CAST({_BLOCK_NO} AS STRING))")
    own = spark.table("documents").withColumn("name_", name).join(asked.select(F.col("doc_id").alias("name_")), "name_", "left_semi").drop("name_")
    own.createOrReplaceTempView("documents_asked")
    return spark.sql(PAGES.replace("FROM documents", "FROM documents_asked"))


def finance_chunks(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    pages(spark, sf_dir, asked).createOrReplaceTempView("pages_of_sources")
    return spark.sql(CHUNKS.replace("FROM pages", "FROM pages_of_sources"))


def finance_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "benchmark", "documents")
    return spark.sql(QUERIES)


def whole_chunks(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """The rows of finance_chunks as pages, cut into chunks."""
    rows = finance_chunks(spark, sf_dir, asked).select("doc_id", "page_number", "page_id", F.col("text_content").alias("text"))
    # Headings and tables read the lines five times: they are made once.
    lines = written(layout.leveled(layout.page_lines(rows)), "lines")
    spans = written(layout.spans(lines, layout.table_islands(lines)), "spans")
    found = chunking.chunks(spans, 512, 32, 64)
    return found.withColumn("chunk_id", F.concat_ws("-", "doc_id", "macro_id", "child_id")).join(rows.select("doc_id", "page_number", "page_id"), ["doc_id", "page_number"])
