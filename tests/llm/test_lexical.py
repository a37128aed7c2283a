"""Ranked lexical search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbline.llm import lexical_nra
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    counted = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 25 + (25 * c.total() * n) // terms
            s = sum(weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed=0):
    """Zipf-like words, copies, ties, repeated and id-less rows, odd characters, a very long text and a very long word."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "中文", "x y", "a\u0085b"]
    text = lambda n: " ".join(rng.choice(vocabulary[: 1 + int(64 * rng.random() ** 3)]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 10, 40]))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(50)] + [docs[3], docs[3], (None, docs[5][1]), (None, None), (900, None), (901, ""), (902, ".,; \n"), (903, "W1-W2_w3.W1"), (904, text(30000)), (905, "y" * 300000 + " w1")]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w1 w1 w1 W1 w2"), (34, docs[7][1]), (35, docs[7][1])]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("chunk", [4 << 20, 300])
def test_search_equals_plain_scores(spark, monkeypatch, chunk):
    """The second run takes the queries in several chunks (sizes are read in the driver)."""
    monkeypatch.setattr(lexical_nra, "CHUNK_BYTES", chunk)
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(6)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    assert found(lexical_nra.search(frame, asked)) == plain(docs, items)
    assert lexical_nra.search(frame, asked.limit(0)).collect() == [] and lexical_nra.search(frame.limit(0), asked).collect() == []


def test_reading_stops_early_and_is_exact():
    """Random lists: exact scores of the first k with all ties; fewer entries than all where the floor is high."""
    rng = np.random.default_rng(0)
    for trial in range(300):
        n, k, stretch = int(rng.integers(1, 60)), int(rng.integers(1, 8)), int(rng.integers(1, 5))
        lists = []
        for _ in range(rng.integers(0, 6)):
            docs = rng.permutation(n)[: rng.integers(1, n + 1)]
            lists.append((docs, np.sort(rng.integers(1, rng.choice([3, 50]), len(docs)))[::-1]))
        score = np.zeros(n, np.int64)
        for docs, impacts in lists:
            score[docs] += impacts
        floor = int(rng.choice([0, 0, score.max()]))
        open_, exact, read = lexical_nra.resolve(lists, n, k, floor, stretch)
        assert (score[open_] == exact).all()
        kth = max(1, floor, np.sort(score)[-k] if n >= k else 0)
        assert set(np.flatnonzero(score >= kth)) <= set(open_)
    docs = np.arange(5000)
    lists = [(docs, np.r_[1000, 900, np.ones(4998, int)]), (docs[::1], np.r_[800, 700, np.ones(4998, int)])]
    open_, exact, read = lexical_nra.resolve(lists, 5000, 2)
    assert sorted(exact)[-2:] == [1600, 1800] and read < 500


def test_floor_ends_hopeless_blocks():
    lists = [(np.arange(1000), np.arange(1000, 0, -1))]
    assert lexical_nra.resolve(lists, 1000, 5, floor=5000)[2] == lexical_nra.STRETCH


def test_query_equals_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert found(QUERIES["op12_lexical_search"](spark, SF)) == plain(docs, items)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_lexical_search", "op13_embedding_near"])
def test_query_equals_sql(spark, name):
    from oracle import compare, connect

    from plumbline.llm.queries import ORACLES

    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLES[name]).df()) == ""
