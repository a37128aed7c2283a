"""Running aggregates by page ranges, headings over very many pages, and the lineage of children."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules, scan
from plumbline.functions.textnorm import any_pattern
from plumbline.operators import chunking, layout


@pytest.mark.parametrize("at_once", [1, 3, 1024])
def test_before_equals_a_loop(spark, at_once):
    rng = random.Random(0)
    rows = [(d, p, rng.choice([None, rng.randrange(50)]), rng.randrange(9)) for d in "ab" for p in rng.sample(range(60), 25)] + [("c", 5, 7, 1)]
    got = {(r.doc_id, r.page_number): (r.x, r.y, r.z) for r in scan.before(spark.createDataFrame([(d, p, x, x, z) for d, p, x, z in rows], "doc_id string, page_number int, x int, y int, z int").repartition(3), {"x": "max", "y": "min", "z": "sum"}, at_once).collect()}
    for d, p, _, _ in rows:
        earlier = [r for r in rows if r[0] == d and r[1] < p]
        known = [r[2] for r in earlier if r[2] is not None]
        assert got[(d, p)] == (max(known, default=None), min(known, default=None), sum(r[3] for r in earlier))
    assert len(got) == len(rows)


def plain_stack(doc, lines):
    """A loop over (page, line, text, level) in order, as the operator's docstring says."""
    stack, out = [], []
    for page, no, text, level in lines:
        if level == 1:
            stack = [text]
        elif level == 2:
            stack = [*stack[:1], text]
        out.append((page, no, "/".join([doc, *stack]), stack[-1] if stack else doc))
    return out


@pytest.mark.parametrize("at_once", [2, 1024])
def test_headings_equal_a_loop(spark, at_once):
    rng = random.Random(1)
    rows = []
    for page in rng.sample(range(1, 400), 120):
        for no in range(rng.randrange(1, 4)):
            rows.append((page, no, rng.choice(["plain text here.", "NOTE ONE", "NOTE TWO", "Items of note", "Significant events", "x", "more plain text."])))
    level = {"NOTE ONE": 1, "NOTE TWO": 1, "Items of note": 2, "Significant events": 2}
    want = plain_stack("d", [(p, n, t, level.get(t)) for p, n, t in sorted(rows)])
    frame = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, page_number int, line_no int, line string").repartition(5)
    got = sorted((r.page_number, r.line_no, r.heading_path, r.section_id) for r in layout.heading_stack(frame, at_once).collect())
    assert got == sorted(want)


def test_a_document_of_100_000_pages(spark):
    """Its lines are spread over many tasks; headings reach from the first page to the last."""
    pages = spark.range(100_000).select(F.lit("d").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_number"), F.lit(0).alias("line_no"), F.when(F.col("id") == 0, "FIRST HEADING").when(F.col("id") == 70_000, "Items of note").otherwise("plain text.").alias("line"))
    rows = layout.heading_stack(pages)
    found = {r.section_id: r.n for r in rows.groupBy("section_id").agg(F.count("*").alias("n")).collect()}
    assert found == {"FIRST HEADING": 70_000, "Items of note": 30_000}
    assert rows.filter("page_number = 100000").first().heading_path == "d/FIRST HEADING/Items of note"


def test_lineage_and_numbers_of_children(spark):
    """Each child has the heading and section of its first span with one; tables come first; numbers run over the document."""
    rng = random.Random(2)
    spans, texts = [], {}
    for page in (1, 2, 4):
        at, lines = 0, []
        for no in range(rng.randrange(5, 30)):
            text = " ".join(rng.choice(["alpha", "b", "Gamma."]) for _ in range(rng.randrange(1, 6)))
            lines.append((at, at + len(text), text, rng.choice(["", None, f"h{no}"]), rng.choice(["", f"s{no}"])))
            at += len(text) + 1
        texts[page] = lines
        spans += [("d", page, k + 1, a, False, t, h, s) for k, (a, _, t, h, s) in enumerate(lines)]
        if page != 2:
            spans.append(("d", page, len(lines) + 1, at, True, "[TABLE] x", "hx", "sx"))
    frame = spark.createDataFrame(spans, "doc_id string, page_number int, span_no int, char_start int, is_table boolean, text string, heading_path string, section_id string").repartition(4)
    rows = chunking.chunks(frame, 16, 4, 5).orderBy("macro_id", "child_id").collect()
    seen = []
    for r in rows:
        seen.append((r.page_number, r.macro_id))
        if r.chunk_type == "table":
            assert r.text_content == "[TABLE] x" and r.heading_path == "hx"
            continue
        under = [x for x in texts[r.page_number] if x[0] < r.char_end and x[1] > r.char_start]
        assert (r.heading_path, r.section_id, r.n_spans) == (next((x[3] for x in under if x[3]), None), next((x[4] for x in under if x[4]), None), len(under))
        assert "\n".join(x[2] for x in texts[r.page_number])[r.char_start : r.char_end] == r.text_content
    assert seen == sorted(seen) and sorted({m for _, m in seen}) == list(range(len({m for _, m in seen})))
    assert rows[0].chunk_type == "table" and chunking.chunks(frame.limit(0), 16, 4, 5).count() == 0


def test_lines_are_trimmed_as_in_sql(spark):
    """White space before a last line separator stays, as the SQL's trim leaves it."""
    texts = ["a \u2028", " \u0085", "\x0b b\t", " \f ", "c \u2029"]
    rows = layout.page_lines(spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, page_number int, text string"))
    assert {r.page_number: r.line for r in rows.collect()} == {0: "a \u2028", 1: "\u0085", 2: "b", 4: "c \u2029"}


def test_words_before_patterns_change_nothing(spark):
    texts = ["MD&A", "our md&a.", "xMD&A", "Significant  events", "SIGNIFICANT EVENTS", "note 12", None, "Items of notes", "\u0130tems of note", "I\u0307tems of note", "items of NOTE", "a.b axb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (rules.HEADING_ONE, rules.HEADING_TWO, [r"\ba.b\b"], []):
        plain = F.lit(False)
        for p in patterns:
            plain = plain | F.col("t").rlike(f"(?i){p}")
        assert rows.filter(~any_pattern(F.col("t"), patterns).eqNullSafe(plain)).count() == 0
