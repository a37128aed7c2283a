"""Near copies among embeddings of one label, by quantised tile products with error bounds.

A vector at length 1 is quantised to whole numbers of -127 to 127; what is lost is a rest vector whose length
is kept, rounded up. For two vectors with rests of lengths e and f the cosine differs from that of the
quantised ones by at most e + f + e * f. A tile's products of whole numbers are exact; pairs surely below the
threshold fall away, pairs surely at or above it are links, and only the pairs between are computed again
from the full vectors in double precision.

Rows of one label and length lie together, sorted by vector: exact copies become one class with a number of
copies (a class may be cut in two; the parts then link as any vectors do). Classes form pieces, pieces meet in
tiles of bounded size, whatever a label's share is. A tile returns link counts by class, and in place of its
links a forest that joins the same classes; components follow by joins. No pair of a group is ever a row.

Every row gives a row. Null labels, null vectors, zero vectors and vectors with null or non-finite components
link with nothing: n_links 0, their own component, kept. Vectors of different length don't link. Repeated rows
are vectors of their own and link with each other; rows without an id link like others and can't name a
component unless it has no id (component_id is null then, and they are kept). Empty tables give no rows.
Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, staged
from plumbline.llm.components import components
from plumbline.llm.vector_pieces import matrix, pieces, whole

#: Pieces on each side of a tile.
SIDE = 8
#: Places of classes in a piece; a piece number and a place make a class's number.
PLACES = 1 << 16
#: What rounding in single precision can add to a product's error.
SLACK = 1e-5
PACKED = "label string, dim int, piece long, n int, vectors binary, codes binary, scales binary, rests binary, copies binary, members array<struct<id:long,place:int>>"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of -127 to 127, the scale of each row, and an upper bound of the length of what is lost."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = 127 / np.abs(u).max(1)
    code = np.rint(u * scale[:, None])
    rest = np.linalg.norm(u - code / scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return code.astype(np.int8), scale, rest


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of codes: 1024 components at a time, whose sums stay below 2**24, in single precision."""
    return sum((a[:, j : j + 1024].astype(np.float32) @ b[:, j : j + 1024].astype(np.float32).T).astype(np.float32 if a.shape[1] <= 1024 else np.float64) for j in range(0, a.shape[1], 1024))


def tile_links(a: dict, b: dict, least: float) -> np.ndarray:
    """Which rows of a link with which of b: boolean (m, n)."""
    about = code_products(a["codes"], b["codes"]) * (1 / a["scales"])[:, None].astype(np.float32) * (1 / b["scales"])[None, :].astype(np.float32)
    e, f = a["rests"][:, None].astype(np.float32), b["rests"][None, :].astype(np.float32)
    error = e + f + e * f + np.float32(SLACK)
    links = about - error >= least
    i, j = np.nonzero((about + error >= least) & ~links)
    for k in range(0, len(i), 1 << 14):
        p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        x, y = a["vectors"][p], b["vectors"][q]
        links[p, q] = np.einsum("ij,ij->i", x, y) / (a["norms"][p] * b["norms"][q]) >= least
    return links


def join_links(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of all nodes after links between nodes a and b are added; up has the roots so far, each the least of its group."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def _unpacked(row: dict) -> dict:
    n, d = row["n"], row["dim"]
    x = np.frombuffer(row["vectors"], np.float64).reshape(n, d)
    return {"node": row["piece"] * PLACES + np.arange(n), "vectors": x, "norms": np.linalg.norm(x, axis=1), "codes": np.frombuffer(row["codes"], np.int8).reshape(n, d), "scales": np.frombuffer(row["scales"]), "rests": np.frombuffer(row["rests"]), "copies": np.frombuffer(row["copies"], np.int64)}


def _tile(least: float):
    def tile(key, table):
        """Links between the pieces of the tile's two groups: (node, links, root); root is null where the tile joins it to nothing."""
        found = sorted(table.to_pylist(), key=lambda r: (r["group"], r["piece"]))
        sides = [_unpacked(r) for r in found]
        first = np.cumsum([0, *(len(s["node"]) for s in sides)])
        links, up = np.zeros(first[-1], np.int64), np.arange(first[-1])
        low, high = found[0]["low"], found[0]["high"]
        for p, a in enumerate(sides):
            for q in range(p, len(sides)):
                b = sides[q]
                if (found[p]["group"], found[q]["group"]) != (low, high):
                    continue
                near = tile_links(a, b, least)
                if p == q:
                    np.fill_diagonal(near, False)
                    links[first[p] : first[p + 1]] += near @ a["copies"]
                else:
                    links[first[p] : first[p + 1]] += near @ b["copies"]
                    links[first[q] : first[q + 1]] += a["copies"] @ near
                i, j = np.nonzero(near)
                up = join_links(up, i + first[p], j + first[q])
        node = np.concatenate([s["node"] for s in sides])
        there = np.flatnonzero(links > 0)
        return pa.table({"node": node[there], "links": links[there], "root": node[up[there]]})

    return tile


def _pack(batch: pa.RecordBatch, part: np.ndarray) -> dict:
    """A piece: copies that follow each other become one class, named by its least id."""
    x = matrix(batch.column("vector"), part)
    new = np.r_[True, (x[1:] != x[:-1]).any(1)]
    place = np.cumsum(new) - 1
    x = x[new]
    code, scale, rest = quantised(x)
    ids = batch.column("id").take(pa.array(part)).to_pylist()
    members = [{"id": i, "place": p} for i, p in zip(ids, place.tolist(), strict=True)]
    at = int(part[0])
    return {"label": batch.column("label")[at].as_py(), "dim": x.shape[1], "piece": batch.column("number")[at].as_py(), "n": len(x), "vectors": x.tobytes(), "codes": code.tobytes(), "scales": scale.tobytes(), "rests": rest.tobytes(), "copies": np.bincount(place).tobytes(), "members": members}


def _packed(some: DataFrame, size: int) -> DataFrame:
    """Pieces of rows (id, label, dim, hash, vector); numbers rise within a task and differ between tasks, a piece has that of its first row."""
    parts = max(1, -(-some.count() // (8 * size)))
    laid = some.repartitionByRange(parts, "label", "dim", "hash", F.xxhash64("id"), "id").sortWithinPartitions("label", "dim", "hash", "vector", F.asc_nulls_last("id"))
    return pieces(laid.withColumn("number", F.monotonically_increasing_id()), ["label", "dim"], _pack, PACKED, size)


def near_copies(rows: DataFrame, id_: str = "vec_id", label: str = "label", vector: str = "embedding", least: float = 0.93, size: int = 1024) -> DataFrame:
    """id_, n_links, component_id, kept for every row; `least` is the cosine from which two vectors link, `size` the classes of a piece."""
    named = rows.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    good = F.col("label").isNotNull() & whole("vector") & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    some = named.filter(good).withColumn("dim", F.size("vector")).withColumn("hash", F.xxhash64("vector"))
    packed = staged(_packed(some, size), "pieces")

    # Pieces of a label are dealt into groups of SIDE by a hash; a tile is a pair of groups.
    groups = packed.groupBy("label", "dim").agg(F.ceil(F.count("*") / SIDE).alias("groups"))
    dealt = packed.drop("members").join(groups, ["label", "dim"]).withColumn("group", F.pmod(F.xxhash64("piece"), F.col("groups")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))
    keyed = dealt.withColumn("other", other).withColumn("low", F.least("group", "other")).withColumn("high", F.greatest("group", "other")).drop("other", "groups")
    linked = staged(keyed.groupBy("label", "dim", "low", "high").applyInArrow(_tile(least), "node long, links long, root long"), "linked")

    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(linked.select("node", "root"), "node", "root")
    members = packed.select("piece", F.explode("members").alias("m")).select((F.col("piece") * PLACES + F.col("m.place")).alias("node"), F.col("m.id").alias("id"))
    own = members.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = own.join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(least_id, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = members.join(classes, "node").select("id", "n_links", "component_id")
    alone = named.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = staged(found.union(alone), "vectors")
    discard(packed, linked)
    return out.select(F.col("id").alias(id_), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
