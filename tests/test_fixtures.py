"""Cases with known results: classification, anchors, plans, ranking, layout, facts, extraction, verification, streams."""

import random
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import queries
from plumbline.functions import textnorm
from plumbline.operators import chunking, evidence, facts, intents, layout, search, triage
from plumbline.plans import retrieval
from plumbline.sources import corpus, tables
from plumbline.streaming import ingest

NOTE_QUERY = "List the items of note affecting 2024 net income and the aggregate impact"


def one(spark, text, **columns):
    return spark.createDataFrame([(text,)], "t string").select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(
    ("query", "intent", "kind", "pages"),
    [
        ("See page 22 for details", "location", None, [22]),
        ("page 3 revenue", "location", None, [3]),
        ("list all significant events", "coverage", "list", []),
        ("list me all litigation events", "coverage", "list", []),
        ("Which matters are explicitly closed and what closed them", "coverage", "list", []),
        ("What is the CET1 ratio?", "semantic", None, []),
        ("List the items of note affecting 2024 net income and aggregate impact", "coverage", "numeric_list", []),
        ("Where can I find the discussion of significant events?", "coverage", "pointer", []),
        ("What is the aggregate range of reasonably possible losses?", "coverage", "attribute", []),
        ("page 3-5", "location", None, [3, 4, 5]),
        ("pages 5-3", "semantic", None, []),
        ("S&P 500 total return", "location", None, [500]),
    ],
)
def test_classification(spark, query, intent, kind, pages):
    r = intents.classify(spark.createDataFrame([(1, query)], "query_id long, query string")).first()
    assert (r.intent, r.coverage_type, r.pages) == (intent, kind, pages)
    assert r.status_filter == ("closed" if "closed" in query else None)


def chunk_frame(spark, rows):
    """(chunk_id, page, macro, child, type, text, heading, section)"""
    data = [("d", cid, page, [page], macro, child, kind, text, head, section) for cid, page, macro, child, kind, text, head, section in rows]
    return spark.createDataFrame(data, "doc_id string, chunk_id string, page_number int, page_numbers array<int>, macro_id int, child_id int, chunk_type string, text_content string, heading_path string, section_id string")


ANCHORS = [
    ("table", "[TABLE] Items of note consolidated financial statements", "reject_chunk_type"),
    ("table", "[TABLE] Note 12 Derivative instruments", "reject_chunk_type"),
    ("narrative", "Adjusted measures are non-GAAP measures. Common shareholders' equity divided by items of note", "reject_adjusted_measures_definition"),
    ("narrative", "Items of note. See the Glossary for definitions and cross-reference.", "front_matter_reference"),
    ("narrative", "Results are adjusted to exclude the impact of items of note. For additional information, see the reconciliation.", "reject_reconciliation_reference_only"),
    ("narrative", "Items of note section overview.", "missing_itemization_or_aggregate"),
    ("narrative", "Items of note: 1) FDIC special assessment ($0.3 billion after tax) 2) Acquisition-related intangibles ($0.1 billion after tax)", None),
]


def test_anchor_selection(spark):
    rows = chunk_frame(spark, [(f"c{i}", i + 1, i, 0, kind, text, None, None) for i, (kind, text, _) in enumerate(ANCHORS)])
    candidates = rows.withColumns({"query_id": F.lit(1), "query": F.lit(NOTE_QUERY), "coverage_type": F.lit("numeric_list"), "rank": F.col("page_number")})
    judged = {r.chunk_id: r.reasons for r in intents.anchor_rejections(candidates).collect()}
    for i, (_, _, reason) in enumerate(ANCHORS):
        assert (judged[f"c{i}"] == []) if reason is None else (reason in judged[f"c{i}"])
    chosen, audit = retrieval.items_of_note_anchor(candidates)
    assert [r.chunk_id for r in chosen.collect()] == ["c6"] and audit.count() == 7


@pytest.mark.parametrize(("text", "n"), [("LCR (12) was 118% (6) Adjusted measures are non-GAAP", 0), ("Ratios for 2020, 2021 and 2022 reflect", 0), ("($0.3 billion) and C$5", 2), ("3 million", 1)])
def test_impacts(spark, text, n):
    assert one(spark, text, n=intents.impact_count(F.col("t"))).n == n


def anchored(rows, page_window):
    return rows.filter("chunk_id = 'a'").withColumns({"query_id": F.lit(1), "page_window": F.lit(page_window)})


def test_expansion(spark):
    rows = chunk_frame(spark, [("a", 5, 5, 0, "narrative", "x", "r/S", "S"), ("b", 9, 9, 0, "narrative", "y", "r/S", None), ("c", 6, 6, 0, "narrative", "z", None, "T")])
    assert [(r.chunk_id, r.method) for r in retrieval.expand(rows, anchored(rows, True)).orderBy("rank").collect()] == [("a", "section"), ("b", "section")]
    bare = rows.withColumns({"heading_path": F.lit(None).cast("string"), "section_id": F.lit(None).cast("string")})
    assert [(r.chunk_id, r.method) for r in retrieval.expand(bare, anchored(bare, True)).collect()] == [("a", "macro_id")]
    gone = retrieval.expand(bare.filter("chunk_id <> 'a'"), anchored(bare, True))
    assert [(r.chunk_id, r.method) for r in gone.collect()] == [("c", "page_window")]
    assert retrieval.expand(bare.filter("chunk_id <> 'a'"), anchored(bare, False)).count() == 0


def test_table_filter(spark):
    rows = chunk_frame(spark, [("t", 1, 0, 0, "table", "[TABLE] x", None, None), ("n", 1, 1, 0, "narrative", "y", None, None)])
    ids = lambda q: sorted(r.chunk_id for r in retrieval.filter_tables(rows.withColumn("query", F.lit(q))).collect())
    assert ids("items of note") == ["n"] and ids("Note 12 derivative instruments") == ["n", "t"]


def ranking(spark, ids):
    return spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id long, chunk_id string, rank int")


def test_fusion_and_rerank(spark):
    rows = search.fuse(ranking(spark, ["a", "b"]), ranking(spark, ["b", "c"]), 3, k=1).orderBy("rank").collect()
    assert [r.chunk_id for r in rows][0] == "b" and {r.chunk_id for r in rows} == {"a", "b", "c"}
    found = spark.createDataFrame([(1, "best answer", "nothing", "c1", 1), (1, "best answer", "the best answer", "c2", 2)], "query_id long, query string, text_content string, chunk_id string, rank int")
    assert [r.chunk_id for r in search.rerank(found).orderBy("rank").collect()] == ["c2", "c1"]


def test_bm25_of_saved_index(spark, tmp_path):
    rows = chunk_frame(spark, [("c1", 1, 0, 0, "narrative", "items of note", None, None), ("c2", 2, 1, 0, "narrative", "adjusted measures", None, None), ("c3", 3, 2, 0, "narrative", "risk metrics", None, None)])
    asked = spark.createDataFrame([(1, "d", "items note")], "query_id long, doc_id string, query string")
    index = search.bm25_index(rows)
    tables.save_index(index, str(tmp_path))
    order = lambda i: [r.chunk_id for r in search.bm25_search(i, asked, 2).orderBy("rank").collect()]
    assert order(index) == order(tables.load_index(spark, str(tmp_path))) and order(index)[0] == "c1"


def test_ivf_search_with_all_lists_is_exact(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.lit("d").alias("doc_id"))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.lit("d").alias("doc_id"))
    exact = {(r.query_id, r.chunk_id) for r in search.vector_search(vectors, asked, 3).collect()}
    assert exact == {(r.query_id, r.chunk_id) for r in search.ivf_search(vectors.drop("doc_id"), asked.drop("doc_id"), 3, probes=1).collect()}
    assert search.ivf_search(vectors.drop("doc_id").limit(0), asked.drop("doc_id"), 3).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_approximate_search_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    x = np.array(rows.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = set()
    for at in np.flatnonzero(rows.vec_id % 50 == 0):
        score = x @ x[at]
        score[at] = -2
        exact |= {(int(rows.vec_id[at]), str(rows.vec_id[i])) for i in np.argsort(-score)[:3]}
    near = {(r.query_id, r.chunk_id) for r in queries.QUERIES["r14_approximate_search"](spark, f"/root/testdata/{sf}").collect()}
    print(sf, len(exact & near) / len(exact))
    assert len(exact & near) / len(exact) >= 0.9


def test_queries_read_whole_texts(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(1000)) + " last"
    spark.createDataFrame([(i, text, "s") for i in range(1, 13)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, text) for i in range(1, 17)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus.whole_chunks(spark, str(tmp_path)).collect()
    assert len({r.chunk_id for r in rows}) == len(rows)
    for page in range(1, 13):
        mine = " ".join(r.text_content for r in rows if r.page_id == page).split()
        assert {f"w{i}" for i in range(1000)} | {"last"} <= set(mine)
    assert any("FDIC special assessment" in r.text_content for r in rows)
    assert all(r.text_content.endswith(text) for r in corpus.finance_chunks(spark, str(tmp_path)).collect())
    assert all(r.query.endswith(text) for r in corpus.finance_queries(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("name", ["r7_bm25_search", "r8_best_anchor", "r11_r12_hybrid", "r13_rerank", "y9_source_blocks", "q13_plan_status"])
def test_queries_index_their_own_documents_only(spark, tmp_path, monkeypatch, name):
    rows = [(4096 * (n % 3) + n, f"items of note w{n} w{n % 5}", "en", f"src{n % 4}", 9) for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "w0"), (1, "w1 note"), (7, "w3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(n, [float(n), 1.0], 1) for n in range(9)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, real = [], search.bm25_index
    monkeypatch.setattr(search, "bm25_index", lambda chunks: seen.append(chunks) or real(chunks))
    queries.QUERIES[name](spark, str(tmp_path)).collect()
    every = {(r.doc_id, r.chunk_id, r.text_content) for r in corpus.finance_chunks(spark, str(tmp_path)).collect()}
    assert {d for d, *_ in every} == {f"src{a}.{b}" for a in range(4) for b in range(3)}
    assert {(r.doc_id, r.chunk_id, r.text_content) for r in seen[0].collect()} == {r for r in every if r[0] in ("src0.0", "src1.1")}


def test_headings_and_spans(spark):
    pages = spark.createDataFrame([("demo", 1, "SECTION ONE\nThis is body text.\nItems of note\n a | b \n c | d \nend"), ("demo", 2, "more\n\nNote 3 x")], "doc_id string, page_number int, text string")
    lines = layout.page_lines(pages)
    rows = layout.spans(lines, layout.table_islands(lines)).orderBy("page_number", "span_no").collect()
    assert rows[1].heading_path == "demo/SECTION ONE" and rows[1].section_id == "SECTION ONE"
    assert rows[2].heading_path == "demo/SECTION ONE/Items of note"
    table = next(r for r in rows if r.is_table)
    assert table.text == "[TABLE] demo/SECTION ONE/Items of note\n| a | b |\n| --- | --- |\n| c | d |"
    assert [r.heading_path for r in rows if r.page_number == 2] == ["demo/SECTION ONE/Items of note", "demo/Note 3 x"]
    text = {r.page_number: r.text for r in layout.page_text(layout.spans(lines, layout.table_islands(lines))).collect()}
    assert all(text[r.page_number][r.char_start : r.char_end] == r.text for r in rows)


def test_cells_of_every_order(spark, tmp_path):
    spark.createDataFrame([(1, 1, 7), (20000, 1, 8), (10**9, 2, 9)], "l_orderkey long, l_linenumber long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.o_orderkey: r.body for r in queries.QUERIES["l3_cells_to_markdown"](spark, str(tmp_path)).collect()}
    assert got == {1: "| line 1 | 7 |", 20000: "| line 1 | 8 |", 10**9: "|  | 9 |"}


@pytest.mark.parametrize("step", [1, -1])
def test_lines_of_one_number_go_by_part(spark, tmp_path, step):
    lines = [(1, 1 + n // 3, part) for n, part in enumerate([5, 9, 7, 3, 3, 8, 2])]
    spark.createDataFrame(lines[::step], "l_orderkey long, l_linenumber long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = "| line 1 | 5 |\n| line 1 | 7 |\n| line 1 | 9 |\n|  | 3 |\n|  | 3 |\n|  | 8 |\n| line 3 | 2 |"
    assert [r.body for r in queries.QUERIES["l3_cells_to_markdown"](spark, str(tmp_path)).collect()] == [want]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.sql("CREATE VIEW orders AS SELECT 1 AS o_orderkey")
    assert [r[1] for r in con.sql(queries.ORACLES["l3_cells_to_markdown"]).fetchall()] == [want]


def test_layout_json(spark):
    row = ("d", [(1, [("Hello", [0.0, 0.0, 5.0])])], [([(0, 0, "Header A"), (0, 1, " Header B"), (1, 0, "1"), (1, 1, "2")], [(1, [0.0, 0.0, 10.0, 0.0, 10.0, 5.0, 0.0, 5.0]), (2, [])])])
    schema = "doc_id string, pages array<struct<pageNumber:int,lines:array<struct<content:string,polygon:array<double>>>>>, tables array<struct<cells:array<struct<rowIndex:int,columnIndex:int,content:string>>,boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>>"
    lines, found = layout.layout_json(spark.createDataFrame([row], schema))
    assert [len(r.points) for r in lines.collect()] == [1]
    table = found.first()
    assert table.page_number == 1 and len(table.points) == 4 and found.count() == 1
    cells = found.select("doc_id", F.posexplode("cells").alias("seq", "c")).select("doc_id", F.col("c.rowIndex").alias("row_index"), F.col("c.columnIndex").alias("column_index"), F.col("c.content").alias("content"), "seq")
    assert layout.cells_to_markdown(cells, ["doc_id"]).first().markdown == "| Header A | Header B |\n| --- | --- |\n| 1 | 2 |"


@pytest.mark.parametrize("n", [1, 5, 8, 9, 17, 40])
def test_macro_windows(spark, n):
    tokens = spark.createDataFrame([("d", 1, n, i, 2 * i, 2 * i + 1) for i in range(n)], "doc_id string, page_number int, n int, pos int, start int, end int")
    got = sorted((r.first, r.last) for r in chunking.macro_windows(tokens, 8, 3).collect())
    want, start = [], 0
    while True:
        end = min(start + 8, n)
        want.append((start, end - 1))
        if end >= n:
            break
        start = end - 3
    assert got == want


def test_chunk_text_and_partitions(spark):
    rng = random.Random(0)
    text = "\n".join(" ".join(rng.choice(["alpha", "beta", "Gamma.", "x"]) for _ in range(rng.randrange(1, 30))) for _ in range(30))
    pages = spark.createDataFrame([("d", p, text[p:]) for p in range(1, 5)], "doc_id string, page_number int, text string")
    seen = []
    for n in (1, 16):
        spans = layout.spans(layout.page_lines(pages.repartition(n)))
        body = layout.page_text(spans)
        rows = chunking.chunks(spans, 64, 8, 16)
        known = {r.page_number: r.text for r in body.collect()}
        assert all(known[r.page_number][r.char_start : r.char_end] == r.text_content for r in rows.collect())
        seen.append(sorted(map(str, rows.collect())))
    assert seen[0] == seen[1]


@pytest.mark.parametrize(
    ("text", "name", "value"),
    [
        ("All amounts are in Canadian dollars unless otherwise stated.", "default_currency", "Canadian dollars"),
        ("All amounts are in U.S. dollars.", "default_currency", "U.S. dollars"),
        ("Revenue increased 5%.", "default_currency", None),
        ("All amounts are in Canadian millions unless noted.", "units", "millions"),
        ("Amounts in U.S. billions.", "units", None),
        ("All amounts are in millions except per-share data.", "units", "millions"),
        ("For the year ended October 31, 2024", "reporting_period", "October 31, 2024"),
        ("Q3 2024 revenue", "reporting_period", None),
    ],
)
def test_fact_values(spark, text, name, value):
    assert one(spark, text, v=facts.fact_values(F.col("t"))[name]).v == value


def test_fact_resolution(spark):
    rows = chunk_frame(spark, [("c1", 1, 0, 0, "narrative", "All amounts are in Canadian dollars.", None, None), ("c2", 5, 1, 0, "narrative", "All amounts are in U.S. dollars. IFRS", None, None)])
    got = {r.fact_name: r for r in facts.extract_facts(rows).collect()}
    assert len(got) == 5 and got["default_currency"].status == "ambiguous" and got["default_currency"].value is None and got["default_currency"].page_numbers == [1, 5]
    assert (got["accounting_framework"].value, got["accounting_framework"].source_chunk_id, got["units"].status) == ("IFRS", "c2", "not_found")
    asked = spark.createDataFrame([(1, "d", "default currency", [1.0]), (2, "d", "which accounting framework", [1.0])], "query_id long, doc_id string, query string, query_embedding array<double>")
    answers = {r.query_id: r.answer for r in facts.cached_answers(asked, facts.extract_facts(rows)).collect()}
    assert answers == {1: None, 2: "accounting_framework: IFRS [C1]"}
    page5 = chunk_frame(spark, [("h", 5, 0, 0, "narrative", "Canadian dollars are used", "r/Basis of presentation", None)]).withColumn("embedding", F.array(F.lit(1.0)))
    named = asked.withColumn("fact_name", facts.fact_name(F.col("query")))
    out = {r.query_id: r for r in facts.fallback_answers(named, facts.fallback_candidates(page5, asked)).collect()}
    assert out[1].status == "found" and out[1].answer == "default_currency: Canadian dollars [C1]" and out[2].status == "not_found"
    nothing = facts.fallback_answers(named, facts.fallback_candidates(page5.limit(0), asked)).collect()
    assert all(r.answer == "not found. Searched pages: []" for r in nothing)


def found(spark, *texts):
    return spark.createDataFrame([(1, i + 1, f"c{i + 1}", [i + 1], t) for i, t in enumerate(texts)], "query_id long, rank int, chunk_id string, page_numbers array<int>, text_content string")


def test_items_answer_and_verification(spark):
    rows = found(spark, "Note 21 - Litigation\nFresco matter details", "Cerberus matter details\nFrayce class action")
    shown = [r.display.lower() for r in evidence.list_items(rows).orderBy("item_no").collect()]
    assert all(any(name in d for d in shown) for name in ("fresco", "cerberus", "frayce")) and len(shown) == len(set(shown))
    answer = evidence.format_list(evidence.list_items(rows))
    assert evidence.verify_items(answer, rows).first().verdict == "YES"
    bad = spark.createDataFrame([(1, "- Other thing | raw: x (chunk_id=c1, pages=1)"), (2, "nothing")], "query_id long, answer string")
    verdicts = {r.query_id: r for r in evidence.verify_items(bad, rows).collect()}
    assert verdicts[1].verdict == "NO" and "other" in verdicts[1].rationale and verdicts[2].verdict == "NO"


def test_attribute_and_citations(spark):
    rows = found(spark, "the range from nil to approximately $0.7 billion.", "else")
    ask = lambda a: spark.createDataFrame([(1, a)], "query_id long, answer string")
    assert evidence.verify_attribute(ask("Answer: nil to approximately $0.7 billion [C1]"), rows).first().verdict == "YES"
    assert evidence.verify_attribute(ask("Answer: nil to approximately $0.7 billion [C2]"), rows).first().verdict == "NO"
    assert evidence.verify_attribute(ask("Answer: $0.7 billion [C1]"), rows).first().verdict == "NO"
    assert evidence.cited_chunk(ask("x [C9] [C2]"), rows).first().chunk_id == "c2" and evidence.cited_chunk(ask("x"), rows).first().chunk_id == "c1"


def test_amounts_add_up(spark):
    text = "FDIC special assessment ($0.3 billion after tax) Acquisition-related intangibles ($0.1 billion after tax) Charge ($200 million). Aggregate impact $0.6 billion"
    r = evidence.amounts(found(spark, text)).first()
    assert (r.n_items, float(r.total), r.adds_up) == (3, 600.0, True)


def test_annotations(spark):
    polygon = [(None, [(1.0, 2.0), (11.0, 2.0), (11.0, 7.0)]), (2, [])]
    frame = spark.createDataFrame([(1, 1, "c", polygon)], "query_id long, rank int, chunk_id string, polygons array<struct<page_number:int,polygon:array<struct<x:double,y:double>>>>")
    r = evidence.annotations(frame).collect()
    assert len(r) == 1 and (r[0].page, r[0].x, r[0].y, r[0].width, r[0].height) == (1, 1.0, 2.0, 10.0, 5.0)


def test_triage(spark):
    rows = spark.createDataFrame([("d", 1, "x", 0.5, 0.7), ("d", 2, "y" * 60, 0.1, 0.1)], "doc_id string, page_number int, text string, image_coverage double, layout_complexity double").withColumn("text_length", F.length("text"))
    got = triage.decide(rows).orderBy("page_number").collect()
    assert got[0].reason_codes == ["low_text", "high_image_coverage", "high_layout_complexity"] and got[1].triage_decision == "native_only"
    pixels = spark.createDataFrame([("d", 1, bytearray([255, 255, 255, 255, 0, 255]))], "doc_id string, page_number int, samples binary")
    assert triage.image_coverage(pixels).first().image_coverage == 0.5


def test_contracts(spark):
    rows = spark.createDataFrame([("a",)], "doc_id string")
    assert len(tables.schema_errors({"documents": (rows, tables.DOCUMENTS)})) == 4
    with pytest.raises(ValueError, match="documents.filename"):
        tables.check_schemas({"documents": (rows, tables.DOCUMENTS)})
    with pytest.raises(ValueError, match="stale"):
        tables.require_fresh(spark.createDataFrame([("a", "stale")], "doc_id string, state string"))
    sha = "ab" * 32
    assert one(spark, sha, u=tables.doc_uuid(F.col("t"))).u == str(uuid.uuid5(uuid.NAMESPACE_URL, sha))


@pytest.mark.parametrize("text", ["Étude V.", "ABC", "Abc Def", "abc", "A1 B", "Mc Donald", "McD", "", "1.2 x", "Over The-Top", "ß"])
def test_case_rules(spark, text):
    r = one(spark, text, up=textnorm.is_upper(F.col("t")), title=textnorm.is_title(F.col("t")))
    assert (r.up, r.title) == (text.isupper(), text.istitle())


def test_streams_replay(spark, tmp_path):
    pages = spark.createDataFrame([("d", i % 7, f"text {i} " * 20, 10.0, 10.0, 0.0, 0.0) for i in range(20)], "doc_id string, page_number int, text string, width double, height double, image_coverage double, layout_complexity double")
    chunks = spark.createDataFrame([("d", i % 5, 0, f"c{i}") for i in range(10)], "doc_id string, macro_id int, child_id int, chunk_id string")
    for frame, run, name, n, keyed in ((pages, ingest.ingest_pages, "p", 7, ingest.PAGES), (chunks, ingest.ingest_chunks, "c", 5, ingest.CHUNKS)):
        frame.repartition(3).write.parquet(f"{tmp_path}/{name}-in")
        for checkpoint in ("one", "two"):  # the second run replays every batch
            run(spark, f"{tmp_path}/{name}-in", frame.schema, f"{tmp_path}/{name}-table", f"{tmp_path}/{name}-{checkpoint}").awaitTermination()
            assert ingest.read_table(spark, f"{tmp_path}/{name}-table", keyed).count() == n


def test_amounts_in_several_wordings(spark):
    text = "Results\nWe booked US$1,234.5 million of severance costs and a bank levy (C$0.2 billion).\nNo sign here (3 million)\nNet impact of $1,434.5 million"
    frame = spark.createDataFrame([(1, "c", text), (2, "d", "nothing")], "query_id long, chunk_id string, text_content string")
    (row,) = evidence.amounts(frame).collect()
    assert (row.query_id, row.n_items, float(row.total), float(row.stated), row.adds_up) == (1, 2, 1434.5, 1434.5, True)


def test_closed_matters_in_one_sentence_with_open_ones(spark):
    text = "The Fresco matter was settled while others stay open. Nothing else."
    frame = spark.createDataFrame([(1, 1, "c", text)], "query_id long, rank int, chunk_id string, text_content string")
    assert [r.how for r in evidence.closed_matters(frame).collect()] == ["settled"]


def test_index_written_part_by_part(spark, tmp_path):
    rows = spark.createDataFrame([("d", "c1", "a b A"), ("d", "c2", ""), ("d", "c3", None), ("e", "c4", "b é b")], "doc_id string, chunk_id string, text_content string")
    got = [sorted(map(tuple, x.collect()), key=str) for x in tables.index_written(rows, f"{tmp_path}/a")]
    assert got[0] == [("d", "c1", "a", 2), ("d", "c1", "b", 1), ("e", "c4", "b", 2), ("e", "c4", "é", 1)]
    tables.save_index(search.bm25_index(rows), f"{tmp_path}/b")
    assert got == [sorted(map(tuple, x.collect()), key=str) for x in tables.load_index(spark, f"{tmp_path}/b")]
    assert all("MapInArrow" not in x._jdf.queryExecution().optimizedPlan().toString() for x in tables.index_written(rows, f"{tmp_path}/c"))


def test_the_corpus_is_read_once_for_asked_chunks(spark, tmp_path):
    rows = [(n, f"note w{n}", "en", f"src{n % 4}", 9) for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "w0")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert not any("documents.parquet" in f for f in queries.asked_chunks(spark, str(tmp_path)).inputFiles())


def test_levels_are_made_once(spark):
    pages = spark.createDataFrame([("demo", 1, "SECTION ONE\nbody text here.\nItems of note\nx"), ("demo", 2, "more\n\nNote 3 x")], "doc_id string, page_number int, text string")
    lines = layout.page_lines(pages)
    made = layout.heading_stack(layout.leveled(lines))
    plain = layout.heading_stack(lines)
    assert made.columns == plain.columns and sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))


def test_excerpts_and_facts_without_their_texts(spark):
    rows = spark.createDataFrame([("d", "c1", " \n All amounts are in Canadian dollars.\nmore"), ("d", "c2", ""), ("e", "c3", None)], "doc_id string, chunk_id string, text_content string")
    assert [r[0] for r in rows.select(facts.excerpt(F.col("text_content"))).collect()] == ["All amounts are in Canadian dollars.", "", None]
    whole = rows.withColumns({"page_number": F.lit(1), "page_numbers": F.array(F.lit(1)), "macro_id": F.lit(0), "child_id": F.lit(0), "chunk_type": F.lit("narrative")})
    found = facts.extract_facts(whole)
    assert {(r.doc_id, r.fact_name, r.evidence_excerpt) for r in found.filter("status = 'found'").collect()} >= {("d", "default_currency", "All amounts are in Canadian dollars.")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 10 and "Generate" in plan and not any("text_content" in line for line in plan.split("\n") if "Aggregate [doc_id" in line and "fact_name" in line)
