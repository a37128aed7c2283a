import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import jaccard_join
from plumbline.llm.components import components
from plumbline.llm.textblocks import shingle_sets


def plain_set(text, width=5):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def plain_components(docs):
    sets = [(i, plain_set(t)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(400)]


def corpus(seed=0):
    rng = random.Random(seed)
    docs = ["", None, " \n", "one", "One", "one two three", "a b c d e", "A B c d E", "x " * 300, "x " * 400]
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    for _ in range(25):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([5, 6, 12, 40, 150, 700]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))))
            if rng.random() < 0.3:
                docs.append(" ".join(base + passage))
    chain = [f"c{i}" for i in range(200)]
    docs += [" ".join(chain[i * 4 : i * 4 + 100]) for i in range(25)]  # links pass along the chain only
    docs += [" ".join(edited(rng, passage, 0.02)) for _ in range(60)]
    ids = list(range(5, 5 + 3 * len(docs), 3))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbcé \n\t")), max_size=40), min_size=1, max_size=6))
def test_shingle_sets(texts):
    got = shingle_sets([t.encode().lower() for t in texts])
    assert [len(s) for s in got] == [len(plain_set(t)) for t in texts]


@pytest.mark.parametrize(("seed", "partitions", "tile", "piece"), [(0, 1, 512, 4096), (1, 7, 512, 4096), (2, 4, 3, 4096), (3, 4, 3, 5)])
def test_jaccard_components(spark, seed, partitions, tile, piece):
    """Also with small tiles, and with a shingle's classes dealt out in many pieces: the sizes go to the workers with the functions."""
    docs = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, set_id string").repartition(partitions)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame, sizes=jaccard_join.Sizes(tile, piece, min(64, tile))).collect()}
    assert got == plain_components(docs)


def prefix_rows(spark, rows):
    return spark.createDataFrame(rows, "shingle long, set_id long, n int, place int").coalesce(1).sortWithinPartitions("shingle", "n", "set_id")


def test_a_hot_shingle_is_dealt_in_pieces_by_size(spark):
    """60 classes of one shingle in pieces of five: pieces follow each other by size, every pair that sizes allow meets in some key, pieces of one component don't."""
    rng = random.Random(4)
    rows = [(7, i, rng.randrange(10, 60), 0) for i in range(60)] + [(8, i, 20, 0) for i in range(3)]
    tiles = prefix_rows(spark, rows).mapInArrow(jaccard_join._banded(5), "shingle long, set_id long, n int, place int, piece int, leader long, leader_n int, leader_place int")
    placed = sorted((r.piece, r.n) for r in tiles.collect() if r.shingle == 7)
    assert placed[-1][0] >= 11 and [n for _, n in placed] == sorted(n for _, n in placed)
    size = {i: n for s, i, n, _ in rows if s == 7}
    for component in (lambda i: i, lambda i: i // 30, lambda i: 0):
        known = spark.createDataFrame([(i, component(i)) for i in range(60)], "set_id long, component long")
        keys = {}
        for r in jaccard_join._dealt(tiles, known).collect():
            keys.setdefault(r.key, []).append(r)
        met = {tuple(sorted((a.set_id, b.set_id))) for own in keys.values() for a in own for b in own if a.set_id != b.set_id and (a.side == b.side == 2 or a.side + b.side == 1)}
        must = {(i, j) for i in size for j in size if i < j and component(i) != component(j) and 4 * min(size[i], size[j]) >= 3 * max(size[i], size[j])}
        assert must <= met
        assert all(len(own) <= 10 for own in keys.values() if own[0].key not in (7, 8))
        if component(59) == 0:
            assert set(keys) == {8}


def test_twenty_thousand_classes_on_one_shingle(spark):
    """Texts that share their first five words only, with some near copies among them."""
    rng = random.Random(5)
    rows = []
    for i in range(20_000):
        words = ["a", "b", "c", "d", "e", *(f"x{i}y{k}" for k in range(rng.choice([1, 2, 30])))]
        rows.append((i, " ".join(words)))
    for i in range(0, 400, 8):
        rows.append((50_000 + i, rows[i][1] + " z" if len(rows[i][1].split()) > 30 else rows[i][1]))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(got[i] == i for i in range(20_000)) and all(got[50_000 + i] == i for i in range(0, 400, 8))


def test_a_very_long_text(spark):
    rng = random.Random(6)
    words = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, "y" * 300_000), (4, "y" * 300_000), (5, " ".join(words[::-1]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_jaccard_small_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = corpus(3)
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect()}
        assert got == plain_components(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_jaccard_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(none).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.jaccard_components(same).collect()) == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1)]
    assert [r.doc_id for r in jaccard_join.keep_first(same.filter("doc_id is not null")).collect()] == [1]


def test_a_corpus_of_copies(spark):
    """Rows of three texts only, and one shingle that very many classes share."""
    rows = [(i, ["a b c d e f g", "q w e r t y", None][i % 3]) for i in range(3000)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id % 3, r.component_id) for r in got if r.doc_id % 3 < 2} == {(0, 0), (1, 1)} and len(got) == 3000
    hot = [(i, f"a b c d e x{i}") for i in range(700)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(hot, "doc_id long, text string").repartition(5)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 700


def test_keep_first_with_repeated_and_null_ids(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, one), (1, two), (1, three), (2, two), (None, one), (None, three + " more"), (None, "d e f g h i"), (None, "d e f g h i"), (3, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in jaccard_join.keep_first(frame).collect()))
    assert kept == sorted([(1, one), (1, two), (1, three), (0, "d e f g h i"), (3, ""), (3, "")])


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randrange(1000, 3000)) for _ in range(500)] + [(9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {c for n, c in got.items() if n >= 1000} == {7}
