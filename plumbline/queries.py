"""Queries over the test tables, one or more for each operator, and the same in portable SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import rules_sql as sql
from plumbline.functions import rules, textnorm
from plumbline.functions.frames import union
from plumbline.operators import chunking, evidence, facts, intents, layout, search, triage
from plumbline.operators.vectors import encode
from plumbline.plans import retrieval
from plumbline.session import prepare
from plumbline.sources import corpus, tables
from plumbline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Portable SQL of the views that the checks build on.
WITH = f"""WITH pages_of AS ({corpus.PAGES}),
chunks AS ({corpus.CHUNKS.replace("FROM pages", "FROM pages_of")}),
queries AS ({corpus.QUERIES}),
lines AS (SELECT doc_id, page_number, line_no, trim(raw, E' \\t\\r\\n\\f') AS line FROM (
    SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM pages_of) WHERE trim(raw, E' \\t\\r\\n\\f') <> ''),
leveled AS (SELECT *, CASE WHEN length(line) < 3 THEN NULL
    WHEN regexp_matches(line, '(?i)\\bMD&A\\b') OR regexp_matches(line, '(?i)Management''?s Discussion and Analysis') OR regexp_matches(line, '(?i)^Note\\s+\\d+') THEN 1
    WHEN regexp_matches(line, '(?i)\\b(Significant events|Items of note|Significant legal proceedings)\\b') THEN 2
    WHEN regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '[\\p{{Ll}}\\p{{Lt}}]') AND length(line) <= 80 THEN 1
    WHEN line LIKE '%:' AND length(line) <= 80 THEN 2
    WHEN regexp_matches(line, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches(line, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}][\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches(line, '(^|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}])\\p{{Ll}}') AND length(line) <= 80 THEN 2
    WHEN regexp_matches(line, '^\\d+(\\.\\d+)*\\s+\\S') AND length(line) <= 100 THEN 2 END AS level FROM lines),
grouped AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, line_no) AS g,
    CASE WHEN level IS NOT NULL THEN page_number * 1000000 + line_no END AS place, CASE WHEN level IS NOT NULL THEN regexp_replace(line, '\\s+', ' ', 'g') END AS head FROM leveled),
stacked AS (SELECT *, first_value(place IGNORE NULLS) OVER w AS p0, first_value(head IGNORE NULLS) OVER w AS h0, last_value(place IGNORE NULLS) OVER w AS p1, last_value(head IGNORE NULLS) OVER w AS h1
    FROM grouped WINDOW w AS (PARTITION BY doc_id, g ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
headed AS (SELECT doc_id, page_number, line_no, line, level, concat_ws('/', doc_id, h0, CASE WHEN p1 <> p0 THEN h1 END) AS heading_path, coalesce(h1, doc_id) AS section_id FROM stacked),
bars AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS island FROM lines WHERE line LIKE '% | %'),
islands AS (SELECT doc_id, page_number, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_rows,
    list('| ' || array_to_string([trim(c) FOR c IN string_split(regexp_replace(line, '^\\||\\|$', '', 'g'), '|') IF trim(c) <> ''], ' | ') || ' |' ORDER BY line_no) AS shown,
    list(len([c FOR c IN string_split(regexp_replace(line, '^\\||\\|$', '', 'g'), '|') IF trim(c) <> '']) ORDER BY line_no)[1] AS width
    FROM bars GROUP BY doc_id, page_number, island HAVING count(*) >= 2),
tables_ AS (SELECT doc_id, page_number, first_line, last_line, n_rows, shown[1] || chr(10) || '| ' || array_to_string([x FOR x IN list_transform(range(width), lambda i: '---')], ' | ') || ' |' || chr(10) || array_to_string(shown[2:], chr(10)) AS markdown FROM islands),
words AS (SELECT doc_id, page_number, line_no, unnest(string_split_regex(line, '\\s+')) AS word, generate_subscripts(string_split_regex(line, '\\s+'), 1) - 1 AS word_no FROM lines),
{sql.bm25("", "chunks", "queries")},
{sql.lexical("", "", "queries", 9)},
vectors AS (SELECT c.doc_id, c.chunk_id, [CAST(page_number AS INTEGER)] AS page_numbers, e.embedding FROM chunks c JOIN embeddings e ON e.vec_id = c.page_id % (SELECT count(*) FROM embeddings)),
vqueries AS (SELECT q.*, e.embedding AS query_embedding FROM queries q JOIN embeddings e ON e.vec_id = q.query_id % (SELECT count(*) FROM embeddings)),
vscored AS (SELECT q.query_id, q.doc_id, v.chunk_id, v.page_numbers, round(list_cosine_similarity(v.embedding::DOUBLE[], q.query_embedding::DOUBLE[]), 6) AS score FROM vqueries q JOIN vectors v USING (doc_id)),
{sql.nearest("", "queries", 9)},
{sql.fused("", 3)},
{sql.ROUTED},
{sql.FLAGS},
{sql.facts()}
"""


def query(name: str, text: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if text:
            ORACLES[name] = text if plain else WITH + text
        return f

    return add


def joined(c: Column | str) -> Column:
    """An array as text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), ",")


def page_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the page lines with boxes on a grid of 10 by 12 units."""
    rows = layout.page_lines(corpus.pages(spark, sf)).select("doc_id", "page_number", "line_no", F.posexplode(F.split("line", "\\s+")).alias("word_no", "word"))
    x = (F.col("word_no") * 10).cast("double")
    y = (F.col("line_no") * 12).cast("double")
    return rows.select("doc_id", "page_number", x.alias("x0"), y.alias("y0"), (x + 9).alias("x1"), (y + 11).alias("y1"), "word", F.floor(F.col("line_no") / 5).cast("int").alias("block_no"), "line_no", "word_no")


def chunk_rows(spark: SparkSession, sf: str, asked: DataFrame | None = None) -> DataFrame:
    """Chunks (of asked documents) with pages, polygons and a vector from `embeddings`."""
    return with_places(corpus.finance_chunks(spark, sf, asked), spark, sf, F.col("page_id"))


def asked_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of the documents that queries ask, written: the whole corpus is read once to find them."""
    return tables.written(corpus.finance_chunks(spark, sf, corpus.finance_queries(spark, sf)), "asked")


def asked_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `chunk_rows` of the documents that queries ask."""
    return with_places(asked_chunks(spark, sf), spark, sf, F.col("page_id"))


def with_places(rows: DataFrame, spark: SparkSession, sf: str, key: Column) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = F.lit(vectors.count())
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    p, q = F.col("page_number"), F.col("page_id") % 50
    polygon = F.array(point(q, p), point(q + 10, p), point(q + 10, p + 5), point(q, p + 5))
    rows = rows.withColumn("page_numbers", F.array("page_number")).withColumn("polygons", F.array(F.struct("page_number", polygon.alias("polygon"))))
    return rows.join(vectors.select(F.col("vec_id").alias("vec"), "embedding"), F.pmod(key, n) == F.col("vec")).drop("vec")


def query_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with vectors from all of `embeddings`."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("query_embedding"))
    return corpus.finance_queries(spark, sf).join(vectors, F.pmod(F.col("query_id"), F.lit(vectors.count())) == F.col("vec")).drop("vec")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


# 2.1 tables


@query("s1_register", "SELECT doc_id, sha256(text) AS sha256 FROM documents d WHERE doc_id % 3 <> 0 AND doc_id = (SELECT min(doc_id) FROM documents e WHERE e.doc_id % 3 <> 0 AND e.text = d.text) AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)", plain=True)
def s1_register(spark: SparkSession, sf: str) -> DataFrame:
    old = docs(spark, sf).filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256"))
    return tables.register(docs(spark, sf).filter("doc_id % 3 <> 0"), old).select("doc_id", "sha256")


@query("s2_document_ids", """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(sha256(text))) AS h FROM documents)""", plain=True)
def s2_document_ids(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tables.doc_uuid(F.sha2("text", 256)).alias("uuid"))


@query("s3_upsert_pages", "SELECT doc_id, page_number, CASE WHEN page_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM pages_of WHERE page_id % 2 = 0 OR page_id % 4 = 0 OR page_id % 3 = 0 AND page_id % 4 = 0")
def s3_upsert_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.pages(spark, sf).select("doc_id", "page_number", "page_id")
    old = rows.filter("page_id % 2 = 0").withColumn("version", F.lit("old"))
    return tables.upsert(old, rows.filter("page_id % 4 = 0").withColumn("version", F.lit("new")), ["doc_id", "page_number"]).select("doc_id", "page_number", "version")


@query("s4_insert_chunks", "SELECT doc_id, macro_id, child_id, min(chunk_id) AS chunk_id FROM chunks c WHERE page_id % 3 = 1 GROUP BY doc_id, macro_id, child_id")
def s4_insert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.finance_chunks(spark, sf)
    new = union(rows.filter("page_id % 3 <> 2"), rows.filter("page_id % 3 = 1"))
    return tables.insert_absent(rows.filter("page_id % 3 <> 1"), new, tables.CHUNK_KEY, [F.col("chunk_id")]).select("doc_id", "macro_id", "child_id", "chunk_id")


@query("s6_lookups", "SELECT p.doc_id, count(*) AS n_pages, max(page_number) AS last_page, sum(CASE WHEN chunk_type = 'table' THEN 1 ELSE 0 END)::BIGINT AS n_tables FROM pages_of p JOIN chunks c USING (doc_id, page_number) GROUP BY p.doc_id")
def s6_lookups(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.pages(spark, sf).join(corpus.finance_chunks(spark, sf).select("doc_id", "page_number", "chunk_type"), ["doc_id", "page_number"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max("page_number").alias("last_page"), F.count_if(F.col("chunk_type") == "table").alias("n_tables"))


@query("s6_facts_of", "SELECT d.doc_id, count(r.value) AS n_facts, string_agg(r.fact_name || '=' || r.value, ';' ORDER BY r.fact_name) AS facts FROM (SELECT DISTINCT doc_id FROM pages_of) d LEFT JOIN resolved r USING (doc_id) GROUP BY d.doc_id")
def s6_facts(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.facts_of(corpus.pages(spark, sf).select("doc_id").distinct(), facts.extract_facts(chunk_rows(spark, sf)))
    named = F.when(F.col("value").isNotNull(), F.struct("fact_name", F.concat_ws("=", "fact_name", "value").alias("shown")))
    every = F.array_sort(F.array_compact(F.collect_list(named)))
    return found.groupBy("doc_id").agg(F.count("value").alias("n_facts"), F.nullif(F.array_join(F.transform(every, lambda x: x["shown"]), ";"), F.lit("")).alias("facts"))


def layout_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as layout JSON of one page, parsed: a table on its page twice, on the next page of even documents, and without a place on a third."""
    pages = docs(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("int").alias("n"), "text")
    y = lambda i: i.cast("double") * 12
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("content"), F.array(F.lit(0.0), y(i), F.lit(99.0), y(i) + 10).alias("polygon")))
    box = F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))
    at = lambda page, polygon: F.struct(page.alias("pageNumber"), polygon.alias("polygon"))
    regions = F.array(at(F.lit(1), box), at(F.lit(1), box), at(F.when(F.col("n") % 2 == 0, 2).otherwise(1), box), at(F.lit(3), F.array().cast("array<double>")))
    cell = F.array(F.struct(F.lit(0).alias("rowIndex"), F.lit(0).alias("columnIndex"), F.col("doc_id").alias("content")))
    shape = "struct<pages:array<struct<pageNumber:int,lines:array<struct<content:string,polygon:array<double>>>>>,tables:array<struct<cells:array<struct<rowIndex:int,columnIndex:int,content:string>>,boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>>>"
    text = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("pageNumber"), lines.alias("lines"))).alias("pages"), F.array(F.struct(cell.alias("cells"), regions.alias("boundingRegions"))).alias("tables")))
    return pages.select("doc_id", F.from_json(text, shape).alias("j")).select("doc_id", "j.*")


@query("s7_layout_json", f"SELECT doc_id::VARCHAR AS doc_id, 1 AS page_number, line_no::INTEGER AS line_no, md5(trim(raw, {sql.SPACE})) AS line_md5, 2 AS n_points FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)", plain=True)
def s7_layout(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = layout.layout_json(layout_rows(spark, sf))
    return lines.select("doc_id", "page_number", "line_no", F.md5("line").alias("line_md5"), F.size("points").alias("n_points"))


@query("l4_table_on_page", "SELECT doc_id::VARCHAR AS doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE [1] END) AS page_number, doc_id::VARCHAR AS cell FROM documents", plain=True)
def l4_tables(spark: SparkSession, sf: str) -> DataFrame:
    _, found = layout.layout_json(layout_rows(spark, sf))
    return found.select("doc_id", "page_number", F.col("cells")[0]["content"].alias("cell"))


@query("s9_row_contract", "SELECT chunk_id, concat_ws(',', CASE WHEN heading_path IS NULL THEN 'heading_path: null' END, CASE WHEN section_id IS NULL THEN 'section_id: null' END, CASE WHEN chunk_type NOT IN ('narrative', 'heading', 'boilerplate') THEN 'chunk_type: value' END) AS violations FROM chunks")
def s9_row_contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.violations(chunk_rows(spark, sf), ["chunk_id", "heading_path", "section_id"], {"chunk_type": ["narrative", "heading", "boilerplate"]}, ("embedding", 64))
    return rows.select("chunk_id", joined("violations").alias("violations"))


@query("s10_chunk_type_backfill", "SELECT chunk_id, CASE WHEN page_id % 2 = 0 THEN chunk_type WHEN text_content LIKE '[TABLE]%' THEN 'table' ELSE 'narrative' END AS chunk_type FROM chunks")
def s10_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.finance_chunks(spark, sf).withColumn("chunk_type", F.when(F.col("page_id") % 2 == 0, F.col("chunk_type")))
    return tables.fill_chunk_type(rows).select("chunk_id", "chunk_type")


@query("s11_keep_last", "SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY source, lang", plain=True)
def s11_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keep_last(docs(spark, sf), ["source", "lang"], "doc_id").select("source", "lang", "doc_id")


@query("s12_skip_chunked", "SELECT doc_id FROM documents WHERE doc_id % 7 NOT IN (2, 3)", plain=True)
def s12_skip_chunked(spark: SparkSession, sf: str) -> DataFrame:
    return tables.not_yet_chunked(docs(spark, sf).select("doc_id"), docs(spark, sf).filter("doc_id % 7 in (2, 3)"))


@query("s12_forced_chunks", "SELECT doc_id, chunk_id, 'old' AS version FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE page_id % 20 = 3) UNION ALL SELECT doc_id, chunk_id, 'new' FROM chunks WHERE page_id % 20 = 3")
def s12_forced(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a page of every twentieth id are chunked again, to that page alone: their old rows go."""
    rows = corpus.finance_chunks(spark, sf)
    new = rows.filter("page_id % 20 = 3").select("doc_id", "chunk_id", F.lit("new").alias("version"))
    return tables.replace_documents(rows.select("doc_id", "chunk_id", F.lit("old").alias("version")), new)


@query("s13_corpus_version", "SELECT source AS doc_id, count(*) || ':' || max(doc_id) AS corpus_version, CASE WHEN source = 'src1' THEN 'missing' WHEN source IN ('src2', 'src3') THEN 'stale' ELSE 'fresh' END AS state FROM documents GROUP BY source", plain=True)
def s13_corpus_version(spark: SparkSession, sf: str) -> DataFrame:
    versions = tables.corpus_version(docs(spark, sf).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("created_at")))
    index = versions.filter("doc_id <> 'src1'").withColumn("corpus_version", F.when(F.col("doc_id").isin("src2", "src3"), "0:0").otherwise(F.col("corpus_version")))
    return tables.index_state(versions, index).select("doc_id", "corpus_version", "state")


@query("s6_newest_first", "SELECT row_number() OVER (ORDER BY doc_id // 10 DESC, doc_id) - 1 AS place, doc_id FROM documents", plain=True)
def s6_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their places, newest first; ten come at a time."""
    rows = docs(spark, sf).select("doc_id", F.expr("doc_id div 10").alias("created_at"))
    return tables.numbered(tables.newest_first(rows)).select("place", "doc_id")


@query("s8_schema_report", """SELECT 'documents' AS table_name, count(*) AS n_rows, '' AS errors FROM documents UNION ALL SELECT 'embeddings', count(*), 'embeddings.model: missing' FROM embeddings
    UNION ALL SELECT 'labels', count(*), 'labels.quality: int, not string; labels.toxic: int, not double' FROM labels UNION ALL SELECT 'pages', count(*), '' FROM pages""", plain=True)
def s8_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """Four tables against contracts, of which two are wrong on purpose."""
    contracts = {"documents": "doc_id bigint, text string, lang string", "pages": "page_id bigint, url string, html string", "labels": "doc_id bigint, quality string, toxic double", "embeddings": "vec_id bigint, model string"}
    return tables.schema_report({name: (prepare(spark).read.parquet(f"{sf}/{name}.parquet"), ddl) for name, ddl in contracts.items()})


@query("s14_integrity", "SELECT chunk_id, CASE WHEN page_id % 5 = 1 THEN 'orphan' ELSE 'kept' END AS state FROM chunks")
def s14_integrity(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.finance_chunks(spark, sf).select(F.col("page_id").alias("doc_id"), "chunk_id")
    parents = docs(spark, sf).filter("doc_id % 5 <> 1").select("doc_id")
    return union(tables.orphans(rows, parents).withColumn("state", F.lit("orphan")), tables.cascade(rows, parents).withColumn("state", F.lit("kept"))).select("chunk_id", "state")


# 2.2 triage


def triaged(spark: SparkSession, sf: str) -> DataFrame:
    pages = corpus.pages(spark, sf).withColumn("width", F.lit(612.0)).withColumn("height", F.when(F.col("page_id") % 11 == 0, 0.0).otherwise(792.0))
    pages = pages.withColumns(dict(zip(("text_length", "text_density"), triage.text_metrics(F.col("text"), F.col("width"), F.col("height")), strict=True)))
    pages = triage.layout_complexity(page_words(spark, sf), pages.withColumn("image_coverage", (F.col("page_id") % 10) / 10))
    return triage.decide(pages.withColumn("layout_complexity", F.round("layout_complexity", 6)))


TRIAGE = """, page_stats AS (SELECT p.doc_id, p.page_number, p.page_id, length(trim(text, E' \\t\\r\\n\\f\\x0b')) AS text_length, 612.0 AS w, CASE WHEN page_id % 11 = 0 THEN 0.0 ELSE 792.0 END AS h FROM pages_of p),
line_sizes AS (SELECT doc_id, page_number, line_no, count(*) AS n FROM words GROUP BY ALL),
layouts AS (SELECT doc_id, page_number, count(*) AS lines, sum(CASE WHEN n <= 3 THEN 1 ELSE 0 END) AS short FROM line_sizes GROUP BY ALL),
metrics AS (SELECT s.*, CASE WHEN w * h > 0 THEN round(text_length / (w * h)::DOUBLE, 9) ELSE 0.0 END AS text_density, (page_id % 10) / 10.0 AS image_coverage,
    round(coalesce(least(1.0, 0.6 * short / lines + 0.4 * least(1.0, lines / greatest(w * h / 100000.0, 1.0) / 3.0)), 0.0)::DOUBLE, 6) AS layout_complexity FROM page_stats s LEFT JOIN layouts USING (doc_id, page_number)),
decided AS (SELECT *, concat_ws(',', CASE WHEN text_length < 50 THEN 'low_text' END, CASE WHEN image_coverage > 0.35 THEN 'high_image_coverage' END, CASE WHEN layout_complexity > 0.6 THEN 'high_layout_complexity' END) AS reason_codes FROM metrics)
"""


@query("t1_t2_t4_triage", TRIAGE + "SELECT page_id, text_length::INTEGER AS text_length, text_density::DOUBLE AS text_density, layout_complexity, reason_codes, CASE WHEN reason_codes = '' THEN 'native_only' ELSE 'di_required' END AS triage_decision FROM decided")
def t_triage(spark: SparkSession, sf: str) -> DataFrame:
    return triaged(spark, sf).select("page_id", "text_length", F.round("text_density", 9).alias("text_density"), "layout_complexity", joined("reason_codes").alias("reason_codes"), "triage_decision")


@query("t5_t6_force_and_disable", TRIAGE + "SELECT page_id, concat_ws(',', CASE WHEN reason_codes <> '' THEN reason_codes END, CASE WHEN page_number = 3 THEN 'force_di' END, CASE WHEN reason_codes <> '' OR page_number = 3 THEN 'di_disabled' END) AS reason_codes, CASE WHEN reason_codes = '' AND page_number <> 3 THEN 'native_only' ELSE 'di_required' END AS triage_decision FROM decided")
def t_force(spark: SparkSession, sf: str) -> DataFrame:
    rows = triaged(spark, sf)
    return triage.disable_layout(triage.force_pages(rows, rows.filter("page_number = 3"))).select("page_id", joined("reason_codes").alias("reason_codes"), "triage_decision")


# Three bytes of a text are a pixel; a byte below 110 is one whose two hexadecimal digits come before 6E.
@query("t3_image_coverage", "SELECT doc_id, page_number, coalesce(list_avg([CASE WHEN least(p[1:2], p[3:4], p[5:6]) < '6E' THEN 1.0 ELSE 0.0 END FOR p IN regexp_extract_all(hex(encode(text)), '.{6}')]), 0.0)::DOUBLE AS image_coverage FROM pages_of")
def t3_image_coverage(spark: SparkSession, sf: str) -> DataFrame:
    pixels = corpus.pages(spark, sf).select("doc_id", "page_number", F.encode("text", "UTF-8").alias("samples"))
    return triage.image_coverage(pixels.withColumn("samples", F.expr("substring(samples, 1, int(length(samples) div 3 * 3))")), 110)


@query("t7_summary", TRIAGE + "SELECT doc_id, sum(CASE WHEN reason_codes <> '' THEN 1 ELSE 0 END)::BIGINT AS di_required, sum(CASE WHEN reason_codes = '' THEN 1 ELSE 0 END)::BIGINT AS native_only FROM decided GROUP BY ROLLUP (doc_id)")
def t7_summary(spark: SparkSession, sf: str) -> DataFrame:
    return triage.summary(triaged(spark, sf))


# 2.3 layout


@query("l1_words_to_lines", "SELECT doc_id, page_number, line_no::INTEGER AS line_no, string_agg(word, ' ' ORDER BY word_no) AS line, (max(word_no) * 10 + 9)::DOUBLE AS x1 FROM words GROUP BY ALL")
def l1_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.words_to_lines(page_words(spark, sf)).select("doc_id", "page_number", "line_no", "line", "x1")


@query("l2_outside_tables", "SELECT doc_id, page_number, count(*) AS n_words FROM words WHERE NOT (word_no * 10 <= 35 AND word_no * 10 + 9 >= 15 AND line_no * 12 <= 30 AND line_no * 12 + 11 >= 12 AND page_number % 2 = 0) GROUP BY ALL")
def l2_outside(spark: SparkSession, sf: str) -> DataFrame:
    box = corpus.pages(spark, sf).filter("page_number % 2 = 0").select("doc_id", "page_number", *(F.lit(v).alias(n) for n, v in (("x0", 15.0), ("y0", 12.0), ("x1", 35.0), ("y1", 30.0))))
    return layout.outside_tables(page_words(spark, sf), box).groupBy("doc_id", "page_number").agg(F.count("*").alias("n_words"))


@query("l3_cells_to_markdown", "SELECT o_orderkey, '| ' || string_agg(CASE WHEN l_linenumber % 2 = 1 THEN 'line ' || l_linenumber ELSE '' END || ' | ' || l_partkey, CASE WHEN false THEN '' ELSE ' |' || chr(10) || '| ' END ORDER BY l_linenumber, l_partkey) || ' |' AS body FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey", plain=True)
def l3_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order as a table, by line number and, where lines share one, by part."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("row_index", F.row_number().over(search.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1)
    first = lines.filter("l_linenumber % 2 = 1").select("l_orderkey", "row_index", F.lit(0).alias("column_index"), F.concat(F.lit(" line "), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("content"), F.lit(1).alias("seq"))
    old = lines.select("l_orderkey", "row_index", F.lit(1).alias("column_index"), F.lit("overwritten").alias("content"), F.lit(1).alias("seq"))
    new = lines.select("l_orderkey", "row_index", F.lit(1).alias("column_index"), F.col("l_partkey").cast("string").alias("content"), F.lit(2).alias("seq"))
    done = layout.cells_to_markdown(union(first, old, new), ["l_orderkey"])
    return done.select(F.col("l_orderkey").alias("o_orderkey"), F.regexp_replace("markdown", "\\n\\| --- \\| --- \\|", "").alias("body"))


@query("l5_polygons", "SELECT c_custkey, 2 AS n_points, least(c_custkey, c_nationkey)::DOUBLE AS x0, greatest(c_custkey, c_nationkey)::DOUBLE AS x1, 4 AS corners FROM customer", plain=True)
def l5_polygons(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    points = layout.flat_to_points(F.array(*(F.col(c).cast("double") for c in ("c_custkey", "c_acctbal", "c_nationkey", "c_acctbal", "c_custkey"))))
    box = layout.points_to_box(points)
    return rows.select("c_custkey", F.size(points).alias("n_points"), box["x0"].alias("x0"), box["x1"].alias("x1"), F.size(layout.box_to_points(box["x0"], box["y0"], box["x1"], box["y1"])).alias("corners"))


@query("l6_l7_l8_headings", "SELECT doc_id, page_number, line_no::INTEGER AS line_no, coalesce(level, 0)::INTEGER AS level, heading_path, section_id FROM headed")
def l6_headings(spark: SparkSession, sf: str) -> DataFrame:
    return layout.heading_stack(layout.page_lines(corpus.pages(spark, sf))).select("doc_id", "page_number", "line_no", F.coalesce("level", F.lit(0)).alias("level"), "heading_path", "section_id")


SPANS = """, all_spans AS (SELECT doc_id, page_number, 0 AS kind, line_no AS ordinal, line AS text, heading_path, section_id FROM headed
    UNION ALL SELECT t.doc_id, t.page_number, 1, first_line, '[TABLE] ' || heading_path || chr(10) || markdown, heading_path, section_id FROM tables_ t
    JOIN (SELECT doc_id, page_number, arg_max(heading_path, line_no) AS heading_path, arg_max(section_id, line_no) AS section_id FROM headed GROUP BY ALL) USING (doc_id, page_number)),
spans AS (SELECT doc_id, page_number, row_number() OVER w AS span_no, coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS char_start, text, heading_path, section_id, kind = 1 AS is_table
    FROM all_spans WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY kind, ordinal))
"""


@query("l9_l10_spans", SPANS + "SELECT doc_id, page_number, span_no::INTEGER AS span_no, char_start, (char_start + length(text))::INTEGER AS char_end, is_table, heading_path, md5(text) AS text_md5 FROM spans")
def l9_spans(spark: SparkSession, sf: str) -> DataFrame:
    lines = layout.page_lines(corpus.pages(spark, sf))
    return layout.spans(lines, layout.table_islands(lines)).select("doc_id", "page_number", "span_no", "char_start", "char_end", "is_table", "heading_path", F.md5("text").alias("text_md5"))


@query("l11_page_text", "SELECT doc_id, page_number, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM lines GROUP BY ALL")
def l11_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_text(layout.spans(layout.page_lines(corpus.pages(spark, sf)))).select("doc_id", "page_number", F.md5("text").alias("text_md5"))


@query("l12_table_islands", "SELECT doc_id, page_number, first_line::INTEGER AS first_line, last_line::INTEGER AS last_line, n_rows, md5(markdown) AS markdown_md5 FROM tables_")
def l12_islands(spark: SparkSession, sf: str) -> DataFrame:
    return layout.table_islands(layout.page_lines(corpus.pages(spark, sf))).select("doc_id", "page_number", "first_line", "last_line", "n_rows", F.md5("markdown").alias("markdown_md5"))


# 2.4 chunks


TOKENS = """, parts AS (SELECT doc_id, page_number, unnest(regexp_extract_all(ptext, '[^\\t\\n\\f\\r ]+[\\t\\n\\f\\r ]*')) AS part, generate_subscripts(regexp_extract_all(ptext, '[^\\t\\n\\f\\r ]+[\\t\\n\\f\\r ]*'), 1) - 1 AS pos
    FROM (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY line_no) AS ptext FROM lines GROUP BY ALL)),
toks AS (SELECT doc_id, page_number, pos, coalesce(sum(length(part)) OVER (PARTITION BY doc_id, page_number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(rtrim(part, E' \\t\\r\\n\\f')) AS n FROM parts),
counts AS (SELECT doc_id, page_number, count(*) AS n FROM toks GROUP BY ALL),
macros AS (SELECT doc_id, page_number, n, unnest(range(0, n, 480)) AS first FROM counts),
windows AS (SELECT doc_id, page_number, first, least(first + 512, n) - 1 AS last, first // 480 AS macro_no FROM macros WHERE first = 0 OR first < n - 32),
children AS (SELECT w.doc_id, w.page_number, macro_no, (pos - first) // 64 AS child_id, min(s) AS char_start, max(s + t.n) AS char_end, count(*) AS n_tokens
    FROM windows w JOIN toks t ON t.doc_id = w.doc_id AND t.page_number = w.page_number AND pos BETWEEN first AND last GROUP BY ALL)
"""


@query("c1_c2_c3_windows", TOKENS + "SELECT doc_id, page_number, macro_no::INTEGER AS macro_no, child_id::INTEGER AS child_id, char_start::INTEGER AS char_start, char_end::INTEGER AS char_end, n_tokens FROM children")
def c_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.page_children(layout.page_text(layout.spans(layout.page_lines(corpus.pages(spark, sf)))), 64, 512, 32)


@query("c2_macro_windows", TOKENS + "SELECT doc_id, page_number, macro_no::INTEGER AS macro_no, first::INTEGER AS first, last::INTEGER AS last FROM windows")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    tokens = chunking.page_tokens(layout.page_text(layout.spans(layout.page_lines(corpus.pages(spark, sf)))))
    return chunking.macro_windows(tokens, 512, 32).select("doc_id", "page_number", "macro_no", "first", "last")


@query("c4_c5_c6_c7_chunks", SPANS + TOKENS + """, lined AS (SELECT c.doc_id, c.page_number, macro_no, child_id, any_value(c.char_start) AS char_start, any_value(c.char_end) AS char_end,
    arg_min(heading_path, span_no) AS heading_path FROM children c JOIN spans s ON s.doc_id = c.doc_id AND s.page_number = c.page_number AND NOT is_table AND s.char_start < c.char_end AND s.char_start + length(text) > c.char_start GROUP BY ALL),
kinds AS (SELECT doc_id, page_number, 1 AS kind, macro_no AS ordinal, child_id, char_start, char_end, heading_path FROM lined UNION ALL SELECT doc_id, page_number, 0, span_no, 0, char_start, char_start + length(text), heading_path FROM spans WHERE is_table)
SELECT doc_id, page_number, (dense_rank() OVER (PARTITION BY doc_id ORDER BY page_number, kind, ordinal) - 1)::INTEGER AS macro_id, child_id::INTEGER AS child_id, char_start::INTEGER AS char_start, char_end::INTEGER AS char_end, heading_path FROM kinds""")
def c_chunks(spark: SparkSession, sf: str) -> DataFrame:
    lines = layout.page_lines(corpus.pages(spark, sf))
    spans = tables.written(layout.spans(lines, layout.table_islands(lines)), "spans")
    return chunking.chunks(spans, 512, 32, 64).select("doc_id", "page_number", "macro_id", F.col("child_id").cast("int"), "char_start", "char_end", "heading_path")


@query("c5_chunk_type", f"SELECT chunk_id, {sql.KIND} AS kind FROM (SELECT chunk_id, trim(text_content, {sql.SPACE}) AS t FROM chunks)")
def c5_type(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.finance_chunks(spark, sf).select("chunk_id", chunking.chunk_type(F.col("text_content")).alias("kind"))


@query("c8_late_pooling", "SELECT label, i::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 5) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i", plain=True)
def c8_pooling(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.late_pooling(spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.col("embedding").cast("array<double>").alias("vector")), ["label"])
    return rows.select("label", F.posexplode("vector").alias("dim", "x")).select("label", (F.col("dim") + 1).alias("dim"), F.round("x", 5).alias("x"))


HASHED = """, tokens_ AS (SELECT chunk_id, md5(unnest(list_filter(string_split_regex(lower(text_content), '\\s+'), lambda t: t <> ''))) AS h FROM chunks),
slots AS (SELECT chunk_id, CAST('0x' || h[1:5] AS INTEGER) % 16 AS at, sum(CASE WHEN h[6] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END) AS x FROM tokens_ GROUP BY ALL)
"""


@query("c9_hash_vectors", HASHED + "SELECT c.chunk_id, string_agg(coalesce(x, 0)::INTEGER, ',' ORDER BY i) AS vector FROM chunks c CROSS JOIN range(16) r(i) LEFT JOIN slots s ON s.chunk_id = c.chunk_id AND s.at = i GROUP BY c.chunk_id")
def c9_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return search.hash_vectors(corpus.finance_chunks(spark, sf), dim=16).select("chunk_id", joined(F.col("vector").cast("array<int>")).alias("vector"))


# 2.5 retrieval


@query("r1_vector_search", "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM vtop WHERE rank <= 3")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_search(asked_rows(spark, sf).select("doc_id", "chunk_id", "page_numbers", "embedding"), query_rows(spark, sf), 3).select("query_id", "chunk_id", "score", "rank")


@query("r2_vector_search_on_pages", "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vscored WHERE page_numbers[1] BETWEEN 2 AND 9) WHERE rank <= 3")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    queries = query_rows(spark, sf).withColumn("pages", F.sequence(F.lit(2), F.lit(9)))
    return search.vector_search(asked_rows(spark, sf).select("doc_id", "chunk_id", "page_numbers", "embedding"), queries, 3, pages=True).select("query_id", "chunk_id", "score", "rank")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk of page 1 + query_id % 7 of each query's document, as its anchor."""
    rows = asked_rows(spark, sf).drop("embedding")
    return corpus.finance_queries(spark, sf).select("query_id", "doc_id", (1 + F.col("query_id") % 7).cast("int").alias("page_number")).join(rows, ["doc_id", "page_number"]).withColumn("page_window", F.col("query_id") % 2 == 0)


ANCHORS = ", anchor AS (SELECT q.query_id, c.* FROM queries q JOIN chunks c ON c.doc_id = q.doc_id AND c.page_number = 1 + q.query_id % 7), section AS (SELECT DISTINCT a.query_id, c.chunk_id FROM anchor a JOIN chunks c ON c.doc_id = a.doc_id AND (c.heading_path = a.heading_path OR c.section_id = a.section_id)), near AS (SELECT a.query_id, c.chunk_id FROM anchor a JOIN chunks c ON c.doc_id = a.doc_id AND c.page_number BETWEEN greatest(a.page_number - 2, 1) AND a.page_number + 2), macro AS (SELECT a.query_id, c.chunk_id FROM anchor a JOIN chunks c ON c.doc_id = a.doc_id AND c.macro_id = a.macro_id)\n"


@query("r3_by_section", ANCHORS + "SELECT * FROM section")
def r3(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.by_section(asked_rows(spark, sf).drop("embedding"), anchors(spark, sf)).select("query_id", "chunk_id")


@query("r4_by_page_window", ANCHORS + "SELECT * FROM near")
def r4(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.by_page_window(asked_rows(spark, sf).drop("embedding"), anchors(spark, sf)).select("query_id", "chunk_id")


@query("r5_by_macro", ANCHORS + "SELECT * FROM macro")
def r5(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.by_macro(asked_rows(spark, sf).drop("embedding"), anchors(spark, sf)).select("query_id", "chunk_id")


@query("q7_expansion_cascade", ANCHORS + "SELECT query_id, chunk_id, 'section' AS method FROM section UNION ALL SELECT query_id, chunk_id, 'macro_id' FROM macro WHERE query_id NOT IN (SELECT query_id FROM section)")
def q7(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.expand(asked_rows(spark, sf).drop("embedding"), anchors(spark, sf)).select("query_id", "chunk_id", "method")


@query("r6_bm25_index", "SELECT doc_id, term, round(idf, 6) AS idf FROM idf")
def r6(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25_index(corpus.finance_chunks(spark, sf))[1].withColumn("idf", F.round("idf", 6))


@query("r7_bm25_search", "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM lexical WHERE rank <= 3")
def r7(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25_search(search.bm25_index(asked_chunks(spark, sf)), corpus.finance_queries(spark, sf), 3).select("query_id", "chunk_id", "score", "rank")


@query("s15_saved_index", "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM lexical WHERE rank <= 3")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """The index written, read back and searched."""
    at = tables.scratch(spark, "index")
    index = tables.index_written(tables.written(corpus.finance_chunks(spark, sf), "chunks"), at)
    return search.bm25_search(index, corpus.finance_queries(spark, sf), 3).select("query_id", "chunk_id", "score", "rank")


PHRASED = ", pasked AS (SELECT query_id, doc_id, term, count(*) AS times FROM (SELECT query_id, doc_id, unnest(['significant', 'legal', 'proceedings', 'contingent', 'liabilities', 'note', '21']) AS term FROM queries) GROUP BY ALL), pscored AS (SELECT query_id, p.chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / avg_len))), 6) AS score FROM pasked a JOIN postings p USING (doc_id, term) JOIN idf USING (doc_id, term) JOIN sizes s ON s.doc_id = a.doc_id AND s.chunk_id = p.chunk_id JOIN docs_ d ON d.doc_id = a.doc_id GROUP BY ALL), pranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pscored WHERE score > 0)\n"


def _anchor_phrases(spark: SparkSession, sf: str, k: int) -> DataFrame:
    queries = corpus.finance_queries(spark, sf).withColumn("phrases", F.array(*map(F.lit, rules.LITIGATION_ANCHORS)))
    return search.best_phrase_anchor(search.bm25_index(asked_chunks(spark, sf)), queries, k).select("query_id", "chunk_id", "score", "rank")


@query("r8_best_anchor", PHRASED + "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM pranked WHERE rank = 1")
def r8(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_phrases(spark, sf, 1)


@query("r9_anchor_candidates", PHRASED + "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM pranked WHERE rank <= 25")
def r9(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_phrases(spark, sf, 25)


@query("r10_phrase_candidates", "SELECT query_id, chunk_id, rank::INTEGER AS rank FROM (SELECT q.query_id, c.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY page_number, macro_id, child_id, c.chunk_id) AS rank FROM queries q JOIN chunks c USING (doc_id) WHERE contains(lower(concat_ws(' ', heading_path, text_content)), 'items of note') OR contains(lower(concat_ws(' ', heading_path, text_content)), 'adjusted net income')) WHERE rank <= 25")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    queries = corpus.finance_queries(spark, sf).select("query_id", "doc_id", F.array(F.lit("Items of note"), F.lit("adjusted net income")).alias("phrases"))
    return search.phrase_candidates(asked_chunks(spark, sf), queries).select("query_id", "chunk_id", "rank")


@query("r11_r12_hybrid", "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM fused")
def r12(spark: SparkSession, sf: str) -> DataFrame:
    rows = asked_rows(spark, sf)
    return search.hybrid_search(rows.select("doc_id", "chunk_id", "page_numbers", "embedding"), search.bm25_index(rows), query_rows(spark, sf), 3).select("query_id", "chunk_id", "score", "rank")


PLAIN = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> ''))"


@query("r13_rerank", f"SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior)::INTEGER AS rank FROM (SELECT f.query_id, f.chunk_id, f.rank AS prior, round(CASE WHEN len({PLAIN.format('query')}) = 0 THEN 0.0 ELSE len(list_intersect({PLAIN.format('query')}, {PLAIN.format('text_content')}))::DOUBLE / len({PLAIN.format('query')}) END, 6) AS rerank_score FROM lexical f JOIN queries q USING (query_id) JOIN chunks c ON c.chunk_id = f.chunk_id)")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    rows = asked_chunks(spark, sf)
    hits = search.bm25_search(search.bm25_index(rows), corpus.finance_queries(spark, sf), 9).select("query_id", "chunk_id", "rank")
    found = hits.join(rows.select("chunk_id", "text_content"), "chunk_id").join(corpus.finance_queries(spark, sf).select("query_id", "query"), "query_id")
    return search.rerank(found).select("query_id", "chunk_id", "rerank_score", "rank")


@query("r14_approximate_search", "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id::VARCHAR) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 3", plain=True)
def r14(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    queries = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return search.code_search(tables.written(encode(vectors), "codes"), vectors, queries, others=True)


# 2.6 routing and plans


@query("q1_q2_q3_classify", "SELECT query_id, array_to_string(pages, ',') AS pages, intent, coverage_type, status_filter FROM routed")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    return intents.classify(corpus.finance_queries(spark, sf)).select("query_id", joined("pages").alias("pages"), "intent", "coverage_type", "status_filter")


@query("q4_q5_q6_targets", "SELECT query_id, target, litigation, expanded, explicit_note, filters_tables FROM routed")
def q4(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return corpus.finance_queries(spark, sf).select("query_id", intents.section_target(q)["label"].alias("target"), intents.is_litigation(q).alias("litigation"), intents.expanded(q).alias("expanded"), intents.explicit_note(q).alias("explicit_note"), intents.filters_tables(q).alias("filters_tables"))


@query("q8_table_filter", "SELECT query_id, chunk_id FROM routed JOIN chunks USING (doc_id) WHERE NOT (filters_tables AND (chunk_type = 'table' OR text_content LIKE '[TABLE]%'))")
def q8(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.filter_tables(corpus.finance_queries(spark, sf).join(asked_chunks(spark, sf), "doc_id")).select("query_id", "chunk_id")


@query("q10_q11_text_flags", "SELECT chunk_id, impacts, signal AS reconciliation_signal, front_matter, aggregate_phrase, reference_only, adjusted_definition FROM flagged")
def q10(spark: SparkSession, sf: str) -> DataFrame:
    flags = intents.text_flags(F.lower(F.concat_ws(" ", "heading_path", "section_id", "text_content")), F.col("text_content"))
    names = ("reconciliation_signal", "front_matter", "aggregate_phrase", "reference_only", "adjusted_definition")
    return corpus.finance_chunks(spark, sf).select("chunk_id", intents.impact_count(F.col("text_content")).alias("impacts"), *(flags[n].alias(n) for n in names))


@query("q9_items_of_note_anchor", f"""SELECT query_id, first(chunk_id ORDER BY page_number, macro_id, child_id, chunk_id) AS chunk_id FROM routed q JOIN flagged c USING (doc_id) WHERE q.coverage_type = 'numeric_list'
    AND {sql.any_phrase("lower(concat_ws(' ', heading_path, text_content))", ["Items of note", "FDIC special assessment"])} AND len({sql.reasons("true", "NOT q.explicit_note")}) = 0 GROUP BY query_id""")
def q9(spark: SparkSession, sf: str) -> DataFrame:
    queries = intents.classify(corpus.finance_queries(spark, sf)).filter("coverage_type = 'numeric_list'")
    phrases = F.array(F.lit("Items of note"), F.lit("FDIC special assessment"))
    rows = search.phrase_candidates(asked_chunks(spark, sf), queries.select("query_id", "doc_id", phrases.alias("phrases")), None)
    return retrieval.items_of_note_anchor(rows.join(queries.select("query_id", "query", "coverage_type"), "query_id"))[0].select("query_id", "chunk_id")


@query("q12_q13_plans", sql.PLANS + "SELECT query_id, rank::INTEGER AS rank, method, chunk_id FROM planned")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.run_plans(asked_rows(spark, sf), query_rows(spark, sf))[0].select("query_id", "rank", "method", "chunk_id")


@query("q13_plan_status", sql.PLANS + sql.STATUS)
def q13_status(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.run_plans(asked_rows(spark, sf), query_rows(spark, sf))[1].select("query_id", "intent", "coverage_type", "anchor_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "status", "decisions")


@query("q14_debug_record", "SELECT query_id, array_to_string(list_sort(list_distinct(list(page_number))), ',') AS pages, coalesce(array_to_string(list_sort(list_distinct(list(heading_path) FILTER (heading_path IS NOT NULL))), ','), '') AS headings, string_agg(rank || ' ' || chunk_id || ' ' || md5(substring(text_content, 1, 160)), ',' ORDER BY rank) AS top_chunks FROM (SELECT l.query_id, l.rank, c.* FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 3) GROUP BY query_id")
def q14(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.from_json("top_chunks", "array<struct<rank:int,chunk_id:string,snippet:string>>")
    top = F.array_join(F.transform(shown, lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["chunk_id"], F.md5(x["snippet"]))), ",")
    return retrieval.debug_record(results(spark, sf)).select("query_id", joined("pages").alias("pages"), joined("headings").alias("headings"), top.alias("top_chunks"))


@query("q15_neighbours", "SELECT chunk_id, md5(coalesce(array_to_string(list(CASE WHEN chunk_type = 'narrative' THEN text_content END) OVER (PARTITION BY doc_id, section_id ORDER BY page_number, macro_id, child_id, chunk_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), chr(10)), '')) AS evidence_md5 FROM chunks")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.with_neighbours(corpus.finance_chunks(spark, sf)).select("chunk_id", F.md5("evidence").alias("evidence_md5"))


# 2.7 facts


@query("f1_f6_facts", "SELECT doc_id, fact_name, value, status, source_chunk_id FROM resolved")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return facts.extract_facts(chunk_rows(spark, sf)).select("doc_id", "fact_name", "value", "status", "source_chunk_id")


@query("s5_upsert_facts", "SELECT doc_id, fact_name, CASE WHEN status = 'found' THEN 'new' ELSE 'old' END AS version FROM resolved")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts.extract_facts(chunk_rows(spark, sf)).select("doc_id", "fact_name", "status")
    return tables.upsert(rows.withColumn("version", F.lit("old")), rows.filter("status = 'found'").withColumn("version", F.lit("new")), ["doc_id", "fact_name"]).select("doc_id", "fact_name", "version")


@query("f7_excerpt", "SELECT doc_id, substring(string_split(trim(text, E' \\t\\r\\n\\f'), chr(10))[1], 1, 200) AS excerpt FROM documents", plain=True)
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", facts.excerpt(F.col("text")).alias("excerpt"))


@query("f8_f9_cached_facts", f"SELECT q.query_id, q.fact_name, CASE WHEN r.status = 'found' AND r.source_chunk_id IS NOT NULL THEN q.fact_name || ': ' || r.value || ' [C1]' END AS answer FROM (SELECT * FROM (SELECT *, {sql.FACT_NAME} AS fact_name FROM queries) WHERE fact_name IS NOT NULL) q LEFT JOIN resolved r USING (doc_id, fact_name)")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return facts.cached_answers(corpus.finance_queries(spark, sf), facts.extract_facts(asked_rows(spark, sf))).select("query_id", "fact_name", "answer")


@query("f10_f11_fallback", sql.FALLBACK)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    queries = query_rows(spark, sf).withColumn("fact_name", facts.fact_name(F.col("query"))).filter("fact_name is not null")
    return facts.fallback_answers(queries.select("query_id", "fact_name"), facts.fallback_candidates(asked_rows(spark, sf), queries.select("query_id", "doc_id", "query_embedding")))


# 2.8 and 2.9 evidence


def results(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    rows = asked_chunks(spark, sf).withColumn("page_numbers", F.array("page_number"))
    hits = search.bm25_search(search.bm25_index(rows), corpus.finance_queries(spark, sf), k).select("query_id", "chunk_id", "rank")
    return hits.join(rows, "chunk_id")


def per_page(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk as the only result of a query of its own."""
    return chunk_rows(spark, sf).drop("embedding").withColumn("query_id", F.col("page_id")).withColumn("rank", F.lit(1))


@query("y1_normalise", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '([0-9A-Za-z_])-\\s*\\n\\s*([0-9A-Za-z_])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM documents", plain=True)
def y1(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(textnorm.join_hyphens(F.col("text"))).alias("text_md5"))


@query("y2_y5_list_items", ", each AS (SELECT page_id AS query_id, 1 AS rank, chunk_id, text_content FROM chunks), " + sql.items("each") + "SELECT query_id, item_no::INTEGER AS item_no, raw, display FROM items")
def y5(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.list_items(per_page(spark, sf)).select("query_id", "item_no", "raw", "display")


@query("y6_format_list", ", top AS (SELECT l.query_id, l.rank, c.chunk_id, text_content FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 3), " + sql.items("top") + """SELECT query_id, 'Items found' || chr(10) || string_agg('- ' || display || ' | raw: ' || raw || ' (chunk_id=' || i.chunk_id || ', pages=' || page_number || ')', chr(10) ORDER BY item_no) AS answer FROM items i JOIN chunks c ON c.chunk_id = i.chunk_id GROUP BY query_id""")
def y6(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.format_list(evidence.list_items(results(spark, sf)))


@query("y7_searched_scope", "SELECT query_id, array_to_string(list_sort(list_distinct(list(coalesce(heading_path, section_id, 'unknown')))), ', ') AS sections, array_to_string(list_sort(list_distinct(list(page_number))), ',') AS pages FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 3 GROUP BY query_id")
def y7(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.searched_scope(results(spark, sf))


@query("y8_mode", "SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'deterministic' WHEN 2 THEN 'needs_model' ELSE CASE WHEN query_id % 5 >= 3 THEN 'deterministic' ELSE 'needs_model' END END AS mode FROM queries")
def y8(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ("deterministic", "llm_fallback", "llm_always", "other"))), (F.col("query_id") % 4 + 1).cast("int"))
    return corpus.finance_queries(spark, sf).select("query_id", evidence.resolve_mode(mode, F.col("query_id") % 5).alias("mode"))


@query("y9_source_blocks", "SELECT query_id, string_agg('[C' || rank || '] ' || text_content, chr(10) || chr(10) ORDER BY rank) AS sources FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 3 GROUP BY query_id")
def y9(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.source_blocks(results(spark, sf))


@query("y10_closed_matters", f"SELECT query_id, lower(regexp_extract(sentence, {sql.quoted(rules.CLOSED_WORDS)}, 1)) AS how FROM (SELECT page_id AS query_id, unnest(string_split(regexp_replace(text_content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM chunks) WHERE regexp_matches(sentence, {sql.quoted(sql.bounded(rules.CLOSED_WORDS))})")
def y10(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.closed_matters(per_page(spark, sf)).select("query_id", "how")


@query("y11_amounts", f"SELECT page_id AS query_id, len(parts)::BIGINT AS n_items, list_sum(parts)::DOUBLE AS total, stated::DOUBLE AS stated, list_sum(parts) = stated AS adds_up FROM (SELECT page_id, {sql.amounts()} FROM chunks) WHERE len(parts) > 0")
def y11(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.amounts(per_page(spark, sf)).select("query_id", "n_items", F.col("total").cast("double").alias("total"), F.col("stated").cast("double").alias("stated"), "adds_up")


@query("y12_v4_attribute_spans", f"SELECT page_id AS query_id, regexp_extract(lower(text_content), {sql.quoted(rules.NUMERIC_SPAN)}, 0) AS span FROM chunks WHERE regexp_extract(lower(text_content), {sql.quoted(rules.NUMERIC_SPAN)}, 0) <> ''")
def y12(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.attribute_spans(per_page(spark, sf)).select("query_id", "span")


@query("y13_pointer", "SELECT query_id, 'See ' || coalesce(nullif(regexp_extract(text_content, '(?i)Note \\d+', 0), ''), heading_path, 'the cited section') || ' [C1]' AS answer FROM (SELECT q.query_id, c.* FROM queries q JOIN chunks c ON c.doc_id = q.doc_id AND c.page_number = 1 + q.query_id % 7)")
def y13(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.pointer_answers(anchors(spark, sf)).select("query_id", "answer")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each chunk: its first words cited from it, or from the chunk before."""
    rows = per_page(spark, sf)
    words = F.array_join(F.slice(F.split(F.regexp_replace("text_content", "[^A-Za-z0-9 ]", ""), " +"), 1, 4), " ")
    cited = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("c-"), (F.col("page_id") - 1).cast("string"))).otherwise(F.col("chunk_id"))
    return rows.select("query_id", F.when(F.col("page_id") % 6 == 5, "no list here").otherwise(F.concat(F.lit("Items\n- "), words, F.lit(" | raw: x (chunk_id="), cited, F.lit(", pages=1)"))).alias("answer"))


ANSWERED = f""", answered AS (SELECT page_id AS query_id, 'c-' || CASE WHEN page_id % 4 = 0 THEN page_id - 1 ELSE page_id END AS chunk_id, trim(array_to_string(string_split_regex(regexp_replace(text_content, '[^A-Za-z0-9 ]', '', 'g'), ' +')[1:4], ' ')) AS item FROM chunks WHERE page_id % 6 <> 5),
judged AS (SELECT a.*, {PLAIN.format("item")} AS want, {PLAIN.format("coalesce(c.text_content, '')")} AS have FROM answered a LEFT JOIN chunks c USING (chunk_id)),
missing AS (SELECT *, len(want) > 0 AND len(list_intersect(want, have)) >= 0.7 * len(want) AS ok, CASE WHEN len(want) = 0 THEN '<no tokens>' ELSE array_to_string(list_sort(list_filter(want, lambda x: NOT list_contains(have, x))), ', ') END AS gone FROM judged)
"""


@query("v1_parse_items", ANSWERED + "SELECT query_id, 1 AS item_no, item, chunk_id FROM answered")
def v1(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.parse_items(answers(spark, sf)).select("query_id", "item_no", "item", "chunk_id")


@query("v2_verify_items", ANSWERED + """SELECT c.page_id AS query_id, CASE WHEN m.ok THEN 'YES' ELSE 'NO' END AS verdict, CASE WHEN m.ok IS NULL THEN 'Not found in retrieved evidence.' WHEN m.ok THEN 'All listed items meet normalized token coverage.' ELSE 'Missing tokens for ''' || item || ''': ' || gone END AS rationale
    FROM chunks c LEFT JOIN missing m ON m.query_id = c.page_id""")
def v2(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.verify_items(answers(spark, sf), corpus.finance_chunks(spark, sf)).select("query_id", "verdict", "rationale")


def cited_answers(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Answer: nil to approximately $0."), (1 + F.col("query_id") % 9).cast("string"), F.lit(" billion [C"), (F.col("query_id") % 5).cast("string"), F.lit("] [C9]"))
    return corpus.finance_queries(spark, sf).select("query_id", text.alias("answer"))


CITED = ", res AS (SELECT l.query_id, l.rank, c.* FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 3), cites AS (SELECT *, rank = query_id % 5 AS hit, query_id % 5 BETWEEN 1 AND 3 AS valid FROM res)\n"


@query("v3_cited_chunks", CITED + "SELECT query_id, chunk_id FROM cites WHERE hit OR NOT valid")
def v3(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.cited(cited_answers(spark, sf), results(spark, sf)).select("query_id", "chunk_id")


@query("v5_verify_attribute", CITED + "SELECT query_id, CASE WHEN bool_or((hit OR NOT valid) AND contains(trim(regexp_replace(regexp_replace(lower(text_content), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 'nil to approximately 0 ' || (1 + query_id % 9) || ' billion')) THEN 'YES' ELSE 'NO' END AS verdict FROM cites GROUP BY query_id")
def v5(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.verify_attribute(cited_answers(spark, sf), results(spark, sf))


@query("g1_g3_annotations", "SELECT page_id AS query_id, chunk_id, page_number AS page, (page_id % 50)::DOUBLE AS x, page_number::DOUBLE AS y, 10.0::DOUBLE AS width, 5.0::DOUBLE AS height, 1 AS annotation_no FROM chunks")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.annotations(per_page(spark, sf)).drop("color")


@query("g4_cited_chunk", CITED + "SELECT query_id, coalesce(max(CASE WHEN hit THEN chunk_id END), arg_min(chunk_id, rank)) AS chunk_id FROM cites GROUP BY query_id")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.cited_chunk(cited_answers(spark, sf), results(spark, sf))


# 2.10 streams


def streamed(spark: SparkSession, sf: str, rows: DataFrame, ingest_rows, keyed: ingest.Keyed) -> DataFrame:
    """A table that a stream makes of rows, which are written first, in several files, and read one file a batch."""
    source, table, state = (tables.scratch(spark, n) for n in ("source", "table", "state"))
    rows.repartition(5).write.parquet(source)
    ingest_rows(spark, source, rows.schema, table, state).awaitTermination()
    return ingest.read_table(spark, table, keyed)


@query("st1_ingest_pages", "SELECT doc_id, page_number, length(trim(text, E' \\t\\r\\n\\f\\x0b'))::INTEGER AS text_length, CASE WHEN length(trim(text, E' \\t\\r\\n\\f\\x0b')) < 50 OR page_id % 10 > 3 THEN 'di_required' ELSE 'native_only' END AS triage_decision FROM pages_of")
def st1(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.pages(spark, sf).select("doc_id", "page_number", "text", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), ((F.col("page_id") % 10) / 10).alias("image_coverage"), F.lit(0.0).alias("layout_complexity"))
    return streamed(spark, sf, union(rows, rows), ingest.ingest_pages, ingest.PAGES).select("doc_id", "page_number", "text_length", "triage_decision")


@query("st2_ingest_chunks", "SELECT doc_id, macro_id, child_id, chunk_id FROM chunks")
def st2(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.finance_chunks(spark, sf)
    return streamed(spark, sf, union(rows, rows), ingest.ingest_chunks, ingest.CHUNKS).select("doc_id", "macro_id", "child_id", "chunk_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to chunks with lineage, a BM25 index over them, and the best three chunks of each benchmark text."""
    lines = layout.page_lines(corpus.pages(spark, sf))
    spans = tables.written(layout.spans(lines, layout.table_islands(lines)), "spans")
    rows = chunking.chunks(spans, 512, 32, 64).withColumn("chunk_id", F.concat_ws("-", "doc_id", "macro_id", "child_id"))
    rows = tables.written(rows, "chunks")
    asked = corpus.finance_queries(spark, sf).join(spark.table("benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text"), "query_id").select("query_id", "doc_id", F.col("text").alias("query"))
    hits = search.bm25_search(search.bm25_index(rows), asked, 3)
    return hits.join(rows.drop("doc_id"), "chunk_id").select("query_id", "rank", "score", "chunk_id", "heading_path", "page_number", "char_start", "char_end")
