"""Models as plug points, phrases by one automaton, overlaps by grid cells."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import embedding, layout, phrases, search


def test_child_vectors_equal_a_loop(spark):
    """Means over a child's tokens, with what precedes them in their macro window as context."""
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["a", "bee", "eel\n", "tree", "xxxx"]) for _ in range(n)) for n in (0, 1, 7, 40, 61, 200)] + [None, " \n "]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, page_number int, text string").repartition(3)
    size, overlap, child = 20, 4, 6
    want = {}
    for page, t in enumerate(texts):
        words = (t or "").split()
        for macro, first in enumerate(range(0, len(words), size - overlap)):
            if first and first >= len(words) - overlap:
                break
            window = words[first : first + size]
            rows = [(len(w), w.count("e"), len(window[k - 1]) if k else 0) for k, w in enumerate(window)]
            for number in range(-(-len(window) // child)):
                want[(page, macro, number)] = np.mean(rows[number * child : (number + 1) * child], 0)
    got = {(r.page_number, r.macro_no, r.child_id): r.vector for r in embedding.child_vectors(pages, embedding.WordShape, "shape", child, size, overlap).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_a_model_is_made_once_in_a_worker(spark):
    class Counting:
        def __init__(self):
            self.made = float(int.from_bytes(os.urandom(6), "big"))

        def vectors(self, text):
            return [0], [1], np.array([[self.made]])

    rows = spark.createDataFrame([(i, "x") for i in range(400)], "k long, t string").repartition(40)
    made = {r.vector[0] for r in embedding.embed_texts(rows, "k", "t", Counting, "counting").collect()}
    assert 1 <= len(made) <= 16 < 40


def test_text_vectors(spark):
    got = {r.chunk_id: r.vector for r in embedding.embed_texts(spark.createDataFrame([("a", "bee a"), ("b", None), ("c", "")], "chunk_id string, t string"), "chunk_id", "t", embedding.WordShape, "shape").collect()}
    assert got == {"a": [2.0, 1.0, 1.5], "b": None, "c": None}


@pytest.mark.parametrize("chars", [4 << 20, 6])
def test_phrases_equal_contains(spark, chars):
    """Overlapping, nested, repeated, empty and null phrases; few characters a pass make several passes."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, ""]
    wanted = ["a", "ab", "abc", "bc", "c é", "ab", "", None, "zzz", "éa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, t string").repartition(3)
    got = {(r.chunk_id, r.phrase) for r in phrases.occurring(rows, "chunk_id", F.col("t"), spark.createDataFrame([(p,) for p in wanted], "phrase string"), chars).collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in wanted if t is not None and p is not None and p in t}


def test_phrase_candidates_by_query(spark):
    rows = spark.createDataFrame([("d", f"c{i}", i, 0, 0, "Head X" if i % 5 == 0 else None, f"text Items OF note {i % 3}") for i in range(20)], "doc_id string, chunk_id string, page_number int, macro_id int, child_id int, heading_path string, text_content string")
    asked = spark.createDataFrame([(1, "d", ["head x", "note 2"]), (2, "d", ["nothing"]), (3, "e", ["note"]), (4, "d", ["ITEMS of NOTE"])], "query_id long, doc_id string, phrases array<string>")
    got = {}
    for r in search.phrase_candidates(rows, asked, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    want = [f"c{i}" for i in range(20) if i % 5 == 0 or i % 3 == 2][:4]
    assert {q: [c for _, c in sorted(v)] for q, v in got.items()} == {1: want, 4: ["c0", "c1", "c2", "c3"]}


def boxes_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double, word string")


def test_outside_tables_equals_all_pairs(spark):
    """Boxes of all sizes, touching edges, corners at cell borders, negative places, repeated rows and nulls."""
    rng = random.Random(3)

    def box():
        x, y, w, h = (rng.choice([rng.uniform(-200, 800), 32.0 * rng.randrange(-4, 20)]) for _ in range(4))
        w, h = (abs(v) * rng.choice([0, 0.01, 0.1, 1, 20]) for v in (w, h))
        return x, y, x + w, y + h

    rows = [("d" if i % 2 else "e", i % 3, *box(), rng.choice(["w", None])) for i in range(300)]
    rows += [rows[0], rows[0], ("d", 0, None, 1.0, 2.0, 3.0, "null"), ("d", 0, 1e300, 0.0, 1e300, 1.0, "far")]
    tables = [("d" if i % 2 else "e", i % 3, *box(), "t") for i in range(25)] + [("d", 0, None, 0.0, 1.0, 1.0, "t")]

    def meets(a, b):
        return a[:2] == b[:2] and None not in (*a[2:6], *b[2:6]) and a[2] <= b[4] and a[4] >= b[2] and a[3] <= b[5] and a[5] >= b[3]

    want = sorted(map(str, (r for r in rows if not any(meets(r, t) for t in tables))))
    got = layout.outside_tables(boxes_frame(spark, rows).repartition(4), boxes_frame(spark, tables))
    assert sorted(str(tuple(r)) for r in got.collect()) == want and 0 < len(want) < len(rows)


def test_only_boxes_near_a_table_are_cut_into_cells(spark, monkeypatch):
    rows = [("d", page, 10.0 * n, 0.0, 10.0 * n + 9, 9.0, n) for page in (1, 2) for n in range(50)] * 2
    boxes = spark.createDataFrame([*rows, ("d", 1, None, 0.0, 9.0, 9.0, -1), ("d", 1, float("nan"), 0.0, 9.0, 9.0, -2), ("d", 1, 0.0, 0.0, float("nan"), 9.0, -3)], "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double, n int")
    seen, real = [], layout.grid.with_cells
    monkeypatch.setattr(layout.grid, "with_cells", lambda b, *a: seen.append(b) or real(b, *a))
    got = layout.outside_tables(boxes, spark.createDataFrame([("d", 1, 25.0, 0.0, 45.0, 9.0)], "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double"))
    assert sorted(r.n for r in got.collect()) == sorted([*(r[-1] for r in rows if not (r[1] == 1 and 2 <= r[-1] <= 4)), -1, -2])
    assert seen[0].count() == 8  # six, and two with a side that is no number


def test_a_page_of_100_000_boxes(spark):
    """Each tenth box lies in a table; the join makes about as many rows as there are boxes, not their product with the tables."""
    rows = spark.range(100_000).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("id") % 300 * 10.0).alias("x0"), (F.floor(F.col("id") / 300) * 10.0).alias("y0"), (F.col("id") % 300 * 10.0 + 8).alias("x1"), (F.floor(F.col("id") / 300) * 10.0 + 8).alias("y1"))
    tables = rows.filter("pmod(cast(x0 / 10 + y0 / 10 as long), 10) = 0").selectExpr("doc_id", "page_number", "x0 + 1 as x0", "y0 + 1 as y0", "x1 - 1 as x1", "y1 - 1 as y1")
    assert layout.outside_tables(rows, tables).count() == 100_000 - tables.count()
