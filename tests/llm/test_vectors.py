"""Hard negatives and near vectors against plain all-pairs versions."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.llm import embedding_near, hard_negatives
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>, id long, n long, vector string"


def floors(v, scale=256.0):
    return [int(np.floor(scale * float(x))) for x in v]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)


def plain_negatives(rows, positives=5, negatives=3):
    """rows: (vec_id, label, vector) with labels as they count."""
    rows = [r for r in dict.fromkeys((i, y, tuple(np.float32(v).tolist())) for i, y, v in rows if i is not None and y is not None and usable(v))]
    ints = [floors(v) for _, _, v in rows]
    out = []
    for a, (i, y, v) in enumerate(rows):
        if i % 50:
            continue
        score = lambda k: sum(p * q for p, q in zip(ints[a], ints[k], strict=True))
        others = [(score(k), rows[k][0], rows[k][1]) for k in range(len(rows)) if len(rows[k][2]) == len(v)]
        others.sort(key=lambda x: (-x[0], x[1]))
        mine = [x for x in others if x[2] == y and x[1] != i][:positives]
        for s, j, _ in mine:
            hard = [x for x in others if x[2] != y and 50 * s <= 100 * x[0] <= 95 * s][:negatives]
            out += [(i, j, r, x[1], s, x[0]) for r, x in enumerate(hard, 1)]
    return sorted(out)


def found_negatives(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, y, None if v is None else [None if x is None else float(x) for x in v], 7, 8, "clash") for i, y, v in rows], SCHEMA)


def odd_vectors(seed=0, n=260, d=6):
    """Groups, ties, copies, repeated rows, nulls, other lengths, large components."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    rows = [(i, rng.choice([0, 1, 2, None]), [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + k, 1, rows[3][2]) for k in range(40)] + [rows[5], rows[5]]
    rows += [(1000, 1, None), (1050, 1, []), (1051, 1, [None] * d), (1052, 1, [float("nan")] * d), (1053, 1, [float("inf")] * d), (1054, 1, [0.0] * d), (None, 1, rows[3][2]), (1100, 2, [1.0, 2.0]), (1101, 2, [1.0, 2.5]), (1102, 0, [1.0, 1.9])]
    rows += [(2000 + k, k % 3, [rng.choice([1e4, 3e9, -2e7, 0.3]) for _ in range(d)]) for k in range(0, 101, 10)]
    rng.shuffle(rows)
    return rows


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for m, n, d, top in [(3, 7, 64, 150), (5, 5, 3, 32767), (2, 9, 768, 32767), (1, 1, 1, 0), (4, 3, 2, 5), (0, 3, 2, 5)]:
        a, c = rng.integers(-top, top + 1, (m, d)), rng.integers(-top, top + 1, (n, d))
        assert (hard_negatives.packed_products(a.astype(float), c.astype(float)) == a @ c.T).all()
        if m:
            assert (hard_negatives.wide_products(a.astype(float), c.astype(float)) == a @ c.T).all()
    huge = np.array([[2.0**70, -3.0], [1.0, 2.0]])
    assert hard_negatives.wide_products(huge, huge).tolist() == [[hard_negatives.MOST, 2**70 - 6], [hard_negatives.MOST, 5]] or hard_negatives.wide_products(huge, huge).tolist() == [[hard_negatives.MOST, hard_negatives.MOST], [hard_negatives.MOST, 5]]


@pytest.mark.parametrize("tile", [(32768, 8192), (64, 2)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, tile):
    """The second run has many tiles of each label: sizes are read where the plan is made, in the driver."""
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile[0])
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", tile[1])
    rows = odd_vectors()
    from pyspark.sql import functions as F

    got = found_negatives(hard_negatives.mine(frame(spark, rows).repartition(5), F.col("vec_id") % 50 == 0))
    assert got == plain_negatives(rows) and len(got) > 30
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []


def test_hard_negatives_query(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    want = plain_negatives([(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows])
    assert found_negatives(QUERIES["op11_hard_negatives"](spark, SF)) == want and want


def plain_near(rows, least=0.93):
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    x = [np.array(np.float32(v), float) if usable(v) and any(v) else None for _, _, v in rows]
    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and rows[a][1] is not None and rows[a][1] == rows[b][1] and len(x[a]) == len(x[b]):
                if x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= least:
                    links[a] += 1
                    links[b] += 1
                    up[root(a)] = root(b)
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[root(k)] = min(ids.get(root(k), r[0]), r[0])
    return sorted(((r[0], links[k], ids.get(root(k)), r[0] == ids.get(root(k))) for k, r in enumerate(rows)), key=str)


def found_near(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [1024, 6])
def test_near_vectors_equal_all_pairs(spark, size):
    """Pieces of six classes give many pieces and tiles of a label, and cut the copies of one vector."""
    rows = odd_vectors(1) + odd_vectors(2, 60, 3)
    assert found_near(embedding_near.near_copies(frame(spark, rows).repartition(4), size=size)) == plain_near(rows)
    assert embedding_near.near_copies(frame(spark, [])).collect() == []


def test_chain_of_vectors_is_one_component(spark):
    rows = [(500 - k, 3, [np.cos(k * 0.3), np.sin(k * 0.3)]) for k in range(20)]
    assert found_near(embedding_near.near_copies(frame(spark, rows), size=3)) == plain_near(rows)


def test_bounds_hold():
    """No pair escapes its bound, and few pairs need full precision."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    x = np.repeat(base, 5, 0) + rng.normal(size=(200, 64)) * rng.choice([0.01, 0.2, 0.27, 0.3], 200)[:, None]
    code, scale, rest = embedding_near.quantised(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    about = embedding_near.code_products(code, code) / scale[:, None] / scale[None, :]
    bound = rest[:, None] + rest[None, :] + rest[:, None] * rest[None, :]
    assert (np.abs(u @ u.T - about) <= bound + 1e-5).all() and bound.max() < 0.03
    side = {"codes": code, "scales": scale, "rests": rest, "vectors": x, "norms": np.linalg.norm(x, axis=1)}
    assert (embedding_near.tile_links(side, side, 0.93) == (u @ u.T >= 0.93)).all()
    long = rng.integers(-127, 128, (3, 5000)).astype(np.int8)
    assert (embedding_near.code_products(long, long) == long.astype(int) @ long.T.astype(int)).all()


def test_near_vectors_query(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert found_near(QUERIES["op13_embedding_near"](spark, SF)) == plain_near(rows)


def test_small_pieces_make_many_tiles(spark):
    """What the test of small pieces relies on: a label has more pieces than a group takes, so pairs of groups occur."""
    from pyspark.sql import functions as F

    some = frame(spark, [r for r in odd_vectors(1) if r[1] == 1 and usable(r[2]) and any(r[2])]).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"), F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("hash"))
    assert embedding_near._packed(some, 6).count() > embedding_near.SIDE
