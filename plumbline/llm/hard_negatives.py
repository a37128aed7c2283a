"""Hard negatives by exact integer inner products, many candidates in one product (Kronecker packing).

Components are whole numbers floor(scale * x). Several candidates' components, made positive by a bias, lie
in separated fields of one wide number; one multiplication by an anchor's component serves all of them, and
the sums of a field, less the bias terms, are the exact scores. A field is as wide as the largest sum can
be. Where two or more fields fit 53 bits the wide number is a double, exact below 2**53, and a matrix
product does a tile at once; components of 2**15 and more go through Python integers with a field for every
candidate of the piece. Scores beyond the range of a long over 100 are given as its ends.

Two passes: each anchor's positives among the rows of its label, then the negatives of each positive among
the rows of other labels. In both, pieces of anchors meet pieces of rows in tiles of bounded size, whatever
the labels' sizes are; a tile returns only the first few rows of each anchor.

Rows take no part if label, id or vector is null, or a component is null or not finite. Rows equal in id,
label and vector count once; different rows of one id are rows of their own, though none is another's
partner. Vectors of different length are not compared. Ties go to the smaller id. Empty tables, and
anchors without positives or negatives, give no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, staged
from plumbline.llm.vector_pieces import matrix, pieces, whole

#: Rows and anchors of a tile, about: pieces are dealt to tiles by a hash.
TILE_ROWS, TILE_ANCHORS = 32768, 8192
#: Bits of a whole number that a double holds exactly.
DOUBLE_BITS = 53
MOST = (2**63 - 1) // 100
PACKED = "label string, dim int, wide boolean, n int, ids binary, keys binary, data binary, positives binary"


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers (m, d) and (n, d) in doubles, as longs; several rows share each product."""
    (m, d), n = anchors.shape, len(rows)
    if not (m and n and d):
        return np.zeros((m, n), np.int64)
    low_a, low_c = -min(anchors.min(), 0), -min(rows.min(), 0)
    a, c = anchors + low_a, rows + low_c
    bits = max(1, int(d * a.max() * c.max()).bit_length())
    fields = max(1, DOUBLE_BITS // bits)
    wide = np.zeros((-(-n // fields), d))
    for f in range(fields):
        wide[: len(c[f::fields])] += np.ldexp(c[f::fields], bits * f)
    sums = (a @ wide.T).astype(np.int64)
    out = np.empty((m, n), np.int64)
    for f in range(fields):
        out[:, f::fields] = ((sums >> (bits * f)) & ((1 << bits) - 1))[:, : len(c[f::fields])]
    less = low_c * anchors.sum(1).astype(np.int64)[:, None] + low_a * rows.sum(1).astype(np.int64)[None, :] + int(d * low_a * low_c)
    return out - less.astype(np.int64)


def wide_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same for whole doubles of any size: a field for every row in one Python integer for each component."""
    a, c = [[int(x) for x in v] for v in anchors], [[int(x) for x in v] for v in rows]
    d = anchors.shape[1]
    low_a, low_c = max(0, *(-x for v in a for x in v)), max(0, *(-x for v in c for x in v))
    most = d * (max(x for v in a for x in v) + low_a) * (max(x for v in c for x in v) + low_c)
    width = max(1, -(-most.bit_length() // 8))
    wide = [int.from_bytes(b"".join((v[j] + low_c).to_bytes(width, "little") for v in c), "little") for j in range(d)]
    out = np.empty((len(a), len(c)), np.int64)
    sums = [sum(v) for v in c]
    for i, v in enumerate(a):
        fields = sum((x + low_a) * w for x, w in zip(v, wide, strict=True)).to_bytes(width * len(c), "little")
        less = low_c * sum(v) + d * low_a * low_c
        out[i] = [min(MOST, max(-MOST, int.from_bytes(fields[k * width : (k + 1) * width], "little") - less - low_a * s)) for k, s in enumerate(sums)]
    return out


def products(anchors: np.ndarray, rows: np.ndarray, wide: bool) -> np.ndarray:
    return wide_products(anchors, rows) if wide and len(anchors) and len(rows) and anchors.shape[1] else packed_products(anchors, rows)


def _packed(rows: DataFrame, scale: float) -> DataFrame:
    """Pieces of rows (id, key, label, vector[, positives]) of one label and length."""

    def pack(batch: pa.RecordBatch, part: np.ndarray) -> dict:
        x = np.floor(scale * matrix(batch.column("vector"), part))
        wide = bool(batch.column("wide")[int(part[0])].as_py())
        found = [(i, p["id"], p["score"], p["no"]) for i, own in enumerate(batch.column("positives").take(pa.array(part)).to_pylist()) for p in own] if "positives" in batch.schema.names else []
        numbers = lambda c: np.array(batch.column(c).take(pa.array(part)), np.int64).tobytes()
        return {"label": batch.column("label")[int(part[0])].as_py(), "dim": x.shape[1], "wide": wide, "n": len(part), "ids": numbers("id"), "keys": numbers("key"), "data": x.astype(np.float64 if wide else np.int16).tobytes(), "positives": np.array(found, np.int64).tobytes()}

    return pieces(rows, ["label", "dim", "wide"], pack, PACKED)


def _parts(table: pa.Table) -> dict[tuple[int, bool], list]:
    """By length and width: ids, keys, labels and the matrix of a tile's pieces by ascending id, and where each positive's anchor went."""
    found: dict[tuple[int, bool], list] = {}
    for row in table.to_pylist():
        own = found.setdefault((row["dim"], row["wide"]), [[], [], [], [], []])
        done = sum(map(len, own[0]))
        own[0].append(np.frombuffer(row["ids"], np.int64))
        own[1].append(np.frombuffer(row["keys"], np.int64))
        own[2].append(np.full(row["n"], row["label"], object))
        own[3].append(np.frombuffer(row["data"], np.float64 if row["wide"] else np.int16).astype(np.float64).reshape(row["n"], row["dim"]))
        own[4].append(np.frombuffer(row["positives"], np.int64).reshape(-1, 4) + [done, 0, 0, 0])
    for at, own in found.items():
        ids, keys, labels, data, positives = map(np.concatenate, own)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found[at] = [ids[order], keys[order], labels[order], data[order], np.column_stack([place[positives[:, 0]], positives[:, 1:]])]
    return found


def _scored(anchors: pa.Table, rows: pa.Table, most: int = 1 << 21):
    """Blocks of anchors and rows of a tile with their scores; rows ascend by id within a block."""
    own, theirs = _parts(anchors), _parts(rows)
    for (dim, wide), a in own.items():
        for (dim_, wide_), c in theirs.items():
            if dim != dim_:
                continue
            for j in range(0, len(c[0]), 8192):
                part = slice(j, j + 8192)
                step = max(1, most // len(c[0][part]))
                for i in range(0, len(a[0]), step):
                    yield a, slice(i, i + step), c, part, products(a[3][i : i + step], c[3][part], wide or wide_)


def _first(order: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Of row numbers in sorted order, those among the first k of their group."""
    own = group[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order[np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)])) < k]


POSITIVES = "anchor_id long, anchor_key long, id long, score long"
NEGATIVES = "anchor_id long, anchor_key long, no long, positive_id long, positive_score long, negative_id long, negative_score long"


def _table(names: list[str], parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table(dict(zip(names, (np.asarray(x, np.int64) for x in columns), strict=True)))


def _nearest(k: int):
    """The first k rows of each anchor in a tile of its own label."""

    def tile(key, anchors, rows):
        found = []
        for a, at, c, part, scores in _scored(anchors, rows):
            low = np.iinfo(np.int64).min
            scores[a[0][at][:, None] == c[0][part][None, :]] = low
            for _ in range(k):
                best = scores.argmax(1)
                value = scores[np.arange(len(best)), best]
                there = np.flatnonzero(value > low)
                found.append((a[0][at][there], a[1][at][there], c[0][part][best[there]], value[there]))
                scores[np.arange(len(best)), best] = low
        if found:
            ids, keys, others, value = map(np.concatenate, zip(*found, strict=True))
            keep = _first(np.lexsort((others, -value, keys)), keys, k)
            found = [(ids[keep], keys[keep], others[keep], value[keep])]
        return _table(["anchor_id", "anchor_key", "id", "score"], found)

    return tile


def _banded(k: int, low: int, high: int):
    """For each anchor and positive, the first k rows of other labels whose score lies in the band of the positive's."""

    def tile(key, anchors, rows):
        found = []
        for a, at, c, part, scores in _scored(anchors, rows):
            at = slice(at.start, min(at.stop, len(a[0])))
            asked = a[4][(a[4][:, 0] >= at.start) & (a[4][:, 0] < at.stop)]
            if not len(asked):
                continue
            bottom, top = -(-low * asked[:, 2] // 100), high * asked[:, 2] // 100
            least, most = np.full(at.stop - at.start, np.iinfo(np.int64).max), np.full(at.stop - at.start, np.iinfo(np.int64).min)
            np.minimum.at(least, asked[:, 0] - at.start, bottom)
            np.maximum.at(most, asked[:, 0] - at.start, top)
            i, j = np.nonzero((scores >= least[:, None]) & (scores <= most[:, None]))
            other = a[2][at][i] != c[2][part][j]
            i, j = i[other], j[other]
            value = scores[i, j]
            order = np.lexsort((j, -value, i))
            i, j, value = i[order], j[order], value[order]
            for no in range(int(asked[:, 3].max()) + 1):
                mine = asked[asked[:, 3] == no]
                to = np.full(at.stop - at.start, -1)
                to[mine[:, 0] - at.start] = np.arange(len(mine))
                lows, highs = -(-low * mine[:, 2] // 100), high * mine[:, 2] // 100
                own = to[i]
                inside = np.flatnonzero((own >= 0) & (value >= lows[own]) & (value <= highs[own]))
                keep = _first(inside, i, k)
                pos = mine[to[i[keep]]]
                rows_ = a[0][at][i[keep]], a[1][at][i[keep]]
                found.append((*rows_, pos[:, 3], pos[:, 1], pos[:, 2], c[0][part][j[keep]], value[keep]))
        if found:
            x = [np.concatenate(p) for p in zip(*found, strict=True)]
            group = np.unique(np.column_stack([x[1], x[2]]), axis=0, return_inverse=True)[1].ravel()
            keep = _first(np.lexsort((x[5], -x[6], group)), group, k)
            found = [tuple(v[keep] for v in x)]
        return _table(["anchor_id", "anchor_key", "no", "positive_id", "positive_score", "negative_id", "negative_score"], found)

    return tile


def _tiles(anchors: DataFrame, rows: DataFrame, keys: list[str], counts: tuple[Column, Column], tile, schema: str) -> DataFrame:
    """Each piece of anchors with each piece of rows of equal keys, in tiles; counts: tiles of anchors and of rows (columns of both)."""
    a_tiles, c_tiles = counts
    own = F.pmod(F.xxhash64("ids", "keys", "data"), F.col("of"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    a = anchors.withColumn("of", a_tiles).withColumn("a_tile", own).withColumn("c_tile", each(c_tiles)).select(*keys, "a_tile", "c_tile", *PACKED_NAMES)
    c = rows.withColumn("of", c_tiles).withColumn("c_tile", own).withColumn("a_tile", each(a_tiles)).select(*keys, "a_tile", "c_tile", *PACKED_NAMES)
    by = [*keys, "a_tile", "c_tile"]
    left, right = a.select(*(F.col(k).alias(f"by_{k}") for k in by), *PACKED_NAMES), c.select(*(F.col(k).alias(f"by_{k}") for k in by), *PACKED_NAMES)
    on = [f"by_{k}" for k in by]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(tile, schema)


PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def mine(rows: DataFrame, anchor: Column, id_: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors. An anchor's positives are its first rows of the same label. For each,
    the first rows of other labels with low * positive <= 100 * negative <= high * positive (scores; rank 1
    is the highest).
    """
    spark = rows.sparkSession
    wide = F.exists("vector", lambda x: F.abs(x.cast("double") * scale) >= 2.0**15 - 1)
    whole_rows = rows.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    whole_rows = whole_rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole("vector", scale)).distinct()
    keyed = whole_rows.withColumn("key", F.xxhash64("id", "label", "vector")).withColumn("dim", F.size("vector")).withColumn("wide", wide)
    size = keyed.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    if not size["a"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    parts = lambda n, at_once: max(1, math.ceil(n / at_once))
    packed = staged(_packed(keyed.repartitionByRange(parts(size["n"], 4 * 1024), "label", "id"), scale), "rows")
    anchors = keyed.filter("anchor")
    asked = staged(_packed(anchors.repartitionByRange(parts(size["a"], 4 * 1024), "label", "id"), scale), "anchors")
    labels = packed.groupBy("label").agg(F.ceil(F.sum("n") / TILE_ROWS).alias("c_tiles")).join(asked.groupBy("label").agg(F.ceil(F.sum("n") / TILE_ANCHORS).alias("a_tiles")), "label")
    near = _tiles(asked.join(labels, "label"), packed.join(labels, "label"), ["label"], (F.col("a_tiles"), F.col("c_tiles")), _nearest(positives), POSITIVES)
    best = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "id")
    near = near.withColumn("no", F.row_number().over(best) - 1).filter(F.col("no") < positives)
    near = near.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(F.collect_list(F.struct("id", "score", "no")).alias("positives"))

    banded = staged(_packed(anchors.join(near, ["id", "key"]).repartitionByRange(parts(size["a"], 4 * 1024), "label", "id"), scale), "anchors")
    counts = (F.lit(parts(size["a"], TILE_ANCHORS)), F.lit(parts(size["n"], TILE_ROWS)))
    far = _tiles(banded, packed, [], counts, _banded(negatives, low, high), NEGATIVES)
    order = Window.partitionBy("anchor_id", "anchor_key", "no").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    out = staged(far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(packed, asked, banded)
    return out
