"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard likeness of 0.75 or more.

Documents with equal sets are one class from the start, so copies never meet as pairs. For the rest:

1. Every text is cut into shingles once. A written table keeps each row's class, its bitmap and its
   prefix: two linked sets share one of the first n - ceil(0.75 n) + 1 shingles of each, in any common
   order. The order puts shingles that are frequent in a sample last (a bad sample costs time, never a
   link).
2. Tiles. A shingle's classes, sorted by size, make size bands: within one, sizes differ by a quarter at
   most. Every class is compared with a few leaders: three of those that come first in its size bands,
   and the one of its bands with the largest share of common shingles (of a group of edited copies, the
   least edited). Linked ones need no further comparison among themselves. Components are found.
3. Classes that share a shingle and are still in different components are compared tile by tile. A
   shingle with more than `Sizes.piece` classes is dealt out as pairs of pieces, each a group of its own, so
   that no task holds more than two pieces of a key. Hashed parity bitmaps, wider for larger sets, bound
   the overlap from above by their differing bits, as positions do; what passes is decided by exact
   intersection of the sorted arrays.

So no link between components is lost, and a group of near copies takes comparisons in proportion to
its size. Shingle arrays are made again only for texts of classes whose pairs pass the bitmaps.
Shingles and classes are 64-bit hashes throughout.

Null or empty texts, and those without words, have no shingles and link with nothing. A text with fewer
words than the width has its whole sequence as its only shingle. Repeated rows stay rows of one class. Very long
texts count whole, one at a time. An empty table gives no rows; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import blocks, discard, id_filter, maybe_in, staged
from plumbline.llm.components import components
from plumbline.llm.textblocks import mix, shingle_sets

WIDTH = 5
SAMPLE_ROWS, FREQUENT = 16_384, 50_000
LEAST_WORDS = 4
REMEMBERED = 100_000


@dataclass(frozen=True)
class Sizes:
    """Rows of a tile, of a piece of a hot shingle, and of keys that are compared all at once."""

    tile: int = 512
    piece: int = 4096
    few: int = 64



def likely(inter, a, b):
    """100 * inter >= 75 * union, in whole numbers."""
    return 7 * inter >= 3 * (a + b)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return shingle_sets([(x or "").encode("utf-8", "surrogatepass").lower() for x in texts.to_pylist()], WIDTH)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_sets(batch.column(0))).view(np.int64))], names=["shingle"])


def in_order(shingles: np.ndarray, often: np.ndarray, rank: np.ndarray, first: int) -> np.ndarray:
    """The first shingles of a set: those that are rare in the sample, then the others by their rank."""
    rare = shingles[~often]
    return rare[:first] if len(rare) >= first else np.concatenate([rare, shingles[often][np.argsort(rank[often], kind="stable")]])[:first]


def _classes(frequent):
    """doc_id, n, set_id, bits, text_key and prefix of each row; copies of a class within a task have no prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = frequent.value
        seen: set[int] = set()  # it saves work: copies that are read again go when tiles are made
        for batch in blocks(batches, "text"):
            sets = _sets(batch.column(2))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets)
            ends = np.cumsum(sizes)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat), dtype=np.uint64)])
            ids = set_ids(sums[ends] - sums[ends - sizes], sizes)
            if len(common):
                near = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                often, rank = common[near] == flat, counts[near]
            else:
                often, rank = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
            prefixes: list[bytes | None] = []
            for i, s, end, n in zip(ids.tolist(), sets, ends.tolist(), sizes.tolist(), strict=True):
                if not n or i in seen:
                    prefixes.append(None)
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(i)
                mine = slice(end - n, end)
                prefixes.append(in_order(s, often[mine], rank[mine], n + (-3 * n // 4) + 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(ids), pa.array([bitmap(s) for s in sets], pa.binary()), batch.column(1), pa.array(prefixes, pa.binary())], names=["doc_id", "n", "set_id", "bits", "text_key", "prefix"])

    return run


def set_ids(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of classes: a hash of the set's mixed sum and its size."""
    return mix(mix(sums) + sizes.astype(np.uint64)).view(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, set_id, n, place) of the classes' prefixes."""
    for batch in blocks(batches, "prefix", 1 << 19):
        sizes = np.array([len(p) // 8 for p in batch.column(2).to_pylist()])
        shingles = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        place = np.arange(len(shingles)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = [shingles, np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes).astype(np.int32), place.astype(np.int32)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["shingle", "set_id", "n", "place"])


def _runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Rows that are sorted by their first column, in pieces that end with a key; a key of over `most` rows is cut."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        held = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
        key = held[batch.schema.names[0]]
        at = int(np.searchsorted(key == key[-1], True)) if most is None or key[0] != key[-1] or len(key) < most else len(key)
        if at:
            yield {k: v[:at] for k, v in held.items()}
            held = {k: v[at:] for k, v in held.items()} if at < len(key) else None
    if held is not None:
        yield held


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before in one of these columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _banded(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Prefix rows, sorted by shingle and size, to rows of shared shingles with the leader (first class) of their size band.

    A shingle with very many rows comes in pieces of `most` rows, by size, each with leaders of its own; `piece` counts them.
    """

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "set_id", "n", "place", "piece", "leader", "leader_n", "leader_place"]
        key, pieces = None, 0  # the key that was cut, and its pieces so far
        for run in _runs(batches, most):
            shingle = run["shingle"]
            cut = len(shingle) >= most and shingle[0] == shingle[-1]
            shared = ~_starts(shingle)
            shared[:-1] |= shared[1:]
            part_of_more = np.full(len(shingle), cut) if key is None else (shingle == key) | cut
            at = np.flatnonzero(shared | part_of_more)
            at = at[np.lexsort((run["set_id"][at], run["n"][at], shingle[at]))]
            at = at[_starts(shingle[at], run["set_id"][at])]  # copies of a class are next to each other
            s, ids, n, place = (run[c][at] for c in names[:4])
            head = np.flatnonzero(_starts(s))
            size = np.diff(head, append=len(s))
            piece = (np.arange(len(s)) - np.repeat(head, size)) // most
            if key is not None:
                piece[s == key] += pieces
            keep = np.repeat(size > 1, size) | part_of_more[at]
            pieces = int(piece[-1]) + 1 if cut else 0
            key = shingle[-1] if cut else None
            head = np.flatnonzero(_starts(s, piece))
            lead = np.repeat(head, np.diff(head, append=len(s)))
            while (beyond := n > n[lead].astype(np.int64) * 4 // 3).any():  # the first row beyond its leader's band leads the next one
                first = beyond.copy()
                first[1:] &= ~(beyond[:-1] & (lead[1:] == lead[:-1]))
                lead = np.where(beyond, np.flatnonzero(first)[np.maximum(np.cumsum(first) - 1, 0)], lead)
            if keep.any():
                columns = (s, ids, n, place, piece.astype(np.int32), ids[lead], n[lead], place[lead])
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=names)

    return band


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in hashed bits, at least one bit a shingle (a power of two)."""
    width = 64 * max(LEAST_WORDS, 1 << max(0, (len(shingles) - 1).bit_length() - 6))
    bits = np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(raws: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of `words` words: wider ones are folded by parity."""
    out = np.empty((len(raws), words), np.uint64)
    for i, raw in enumerate(raws):
        row = np.frombuffer(raw, np.uint64)
        out[i] = row if len(row) == words else np.bitwise_xor.reduce(row.reshape(-1, words), axis=0)
    return out


def bound(differ: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap is at most this, where so many bits differ."""
    return (a + b - differ) // 2


def _arrays(words):
    """The sorted arrays of the classes whose texts' keys are in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are read once; a bound, not a rule
        for batch in batches:
            keep = maybe_in(words.value, batch.column(0).to_numpy())
            for i, key in zip(np.flatnonzero(keep).tolist(), batch.column(0).to_numpy()[keep].tolist(), strict=True):
                keep[i] = key not in seen
                if len(seen) < REMEMBERED:
                    seen.add(key)
            wanted = batch.filter(pa.array(keep))
            for part in blocks(iter([wanted]), "text"):
                sets = [s for s in _sets(part.column(1)) if len(s)]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                sums = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(sums, sizes)), pa.array(sizes.astype(np.int32)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "n", "arr"])

    return run


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their bitmaps don't rule out."""
    for batch in batches:
        n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        bits_a, bits_b = (batch.column(i).to_pylist() for i in (4, 5))
        keep = np.zeros(len(n_a), bool)
        for i, (x, y) in enumerate(zip(bits_a, bits_b, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) < len(y):
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
            elif len(y) < len(x):
                x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
            keep[i] = likely(bound(int(np.bitwise_count(x ^ y).sum()), n_a[i], n_b[i]), n_a[i], n_b[i])
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link, by exact intersection of their sorted arrays."""
    for batch in batches:
        n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        inter = np.zeros(len(n_a), np.int64)
        for i in range(len(n_a)):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))
            inter[i] = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
        keep = pa.array(likely(inter, n_a, n_b))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _both(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """Pairs with the size and a column of both sets."""
    left = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col(value).alias("value_b"))
    right = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col(value).alias("value_a"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "n_a", "n_b", "value_a", "value_b")


def verify(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link. Arrays are made again from the texts (text_key, text), for the classes of these pairs only."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    keys = classes.filter("prefix is not null").select("set_id", "text_key").join(ids, "set_id").select("text_key")
    words = texts.sparkSession.sparkContext.broadcast(id_filter(keys, "text_key"))
    arrays = texts.mapInArrow(_arrays(words), "set_id long, n int, arr binary")
    arrays = arrays.groupBy("set_id").agg(F.first("n").alias("n"), F.first("arr").alias("arr"))
    links = staged(_both(pairs, arrays, "arr").mapInArrow(_verified, "a long, b long"), "links")
    words.unpersist()
    return links


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those of keys whose classes lie in more than one component."""
    names = ["key", "set_id", "n", "place", "side", "component"]
    for run in _runs(batches):
        head = np.flatnonzero(_starts(run["key"]))
        some = np.minimum.reduceat(run["component"], head) != np.maximum.reduceat(run["component"], head)
        keep = np.repeat(some, np.diff(head, append=len(run["key"])))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(run[c][keep]) for c in names], names=names)


def _fits(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows (i no larger than j), those that sizes, positions and bitmaps don't rule out."""
    a, b = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64)
    ok = (rows["component"][i] != rows["component"][j]) & (4 * a >= 3 * b) & ((rows["side"][j] == 2) | (rows["side"][i] != rows["side"][j]))
    ok &= likely(np.minimum(a - rows["place"][i], b - rows["place"][j]), a, b)
    i, j, a, b = i[ok], j[ok], a[ok], b[ok]
    keep = np.zeros(len(i), bool)
    widths = np.array([len(x) // 8 for x in rows["bits"][i].tolist()], int)
    for width in np.unique(widths).tolist():  # the larger set's bitmap is no narrower: it is folded
        mine = np.flatnonzero(widths == width)
        (left, at_l), (right, at_r) = (np.unique(x[mine], return_inverse=True) for x in (i, j))
        x, y = folded(rows["bits"][left].tolist(), width), folded(rows["bits"][right].tolist(), width)
        step = max(1, (1 << 17) // width)
        for k in range(0, len(mine), step):
            part = mine[k : k + step]
            differ = np.bitwise_count(x[at_l[k : k + step]] ^ y[at_r[k : k + step]]).sum(1, dtype=np.int64)
            keep[part] = likely(bound(differ, a[part], b[part]), a[part], b[part])
    return i[keep], j[keep]


def _across(tile: int, few_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates between components within a key: rows by size, all keys of few rows at once, others tile by tile."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            order = np.lexsort((run["set_id"], run["n"], run["key"]))
            rows = {k: v[order] for k, v in run.items()}
            head = np.flatnonzero(_starts(rows["key"]))
            size = np.diff(head, append=len(order))
            left = np.repeat(head + size, size) - np.arange(len(order))  # rows of the key from here on
            few = np.repeat(size <= few_rows, size)
            pairs = (_fits(rows, i, i + d) for d in range(1, few_rows) if len(i := np.flatnonzero(few & (left > d))))
            for i, j in itertools.chain(pairs, *(_tile_pairs(rows, a, a + n, tile) for a, n in zip(head[size > few_rows].tolist(), size[size > few_rows].tolist(), strict=True))):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(rows["set_id"][i]), pa.array(rows["set_id"][j])], names=["a", "b"])

    return pair


def _tile_pairs(rows: dict[str, np.ndarray], first: int, end: int, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each tile of a key with itself and with the tiles before that its size band reaches."""
    for at in range(first, end, tile):
        stop = min(at + tile, end)
        low = first + int(np.searchsorted(rows["n"][first:end], -(-3 * int(rows["n"][at]) // 4)))
        for start in range(low, stop, tile):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(start, min(start + tile, stop)), np.arange(at, stop), indexing="ij"))
            yield _fits(rows, i[i < j], j[i < j])


def _dealt(tiles: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (key, set_id, n, place, side, component) to be compared within a key.

    A shingle in one piece is its own key. Of a shingle in more pieces, which follow each other by size, two whose
    size bands meet make a key, in which rows of side 0 meet rows of side 1, and only rows that reach the
    other piece's band go there; rows of a piece alone have side 2 and meet each other. Pieces that lie in one
    component already don't meet.
    """
    rows = tiles.select("shingle", "set_id", "n", "place", "piece")
    large = rows.filter("piece > 0").select("shingle").distinct()
    small = rows.join(large, "shingle", "left_anti").join(known, "set_id").select(F.col("shingle").alias("key"), "set_id", "n", "place", F.lit(2).alias("side"), "component")
    cut = rows.join(large, "shingle", "left_semi").join(known, "set_id")
    bands = cut.groupBy("shingle", "piece").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("c_low"), F.max("component").alias("c_high"))
    a, b = (bands.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in bands.columns[1:])) for side in "ab")
    meet = (F.col("a_piece") <= F.col("b_piece")) & (4 * F.col("a_high").cast("long") >= 3 * F.col("b_low").cast("long"))
    apart = F.least("a_c_low", "b_c_low") < F.greatest("a_c_high", "b_c_high")
    pairs = a.join(b, "shingle").filter(meet & apart).select("shingle", "a_piece", "b_piece", "a_high", "b_low")
    key = F.xxhash64("shingle", "a_piece", "b_piece").alias("key")

    def side(name: str, number: Column, reach: Column) -> DataFrame:
        found = cut.withColumnRenamed("piece", f"{name}_piece").join(pairs, ["shingle", f"{name}_piece"]).filter(reach)
        return found.select(key, "set_id", "n", "place", number.cast("int").alias("side"), "component")

    alone, n = F.col("a_piece") == F.col("b_piece"), F.col("n").cast("long")
    first = side("a", F.when(alone, 2).otherwise(0), alone | (4 * n >= 3 * F.col("b_low").cast("long")))
    second = side("b", F.lit(1), ~alone & (4 * F.col("a_high").cast("long") >= 3 * n))
    return small.unionByName(first).unionByName(second)


def _to_central(tiles: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class b with the best-connected class a among the size bands of its shingles."""
    first = F.col("n") + F.floor(-3 * F.col("n") / 4) + 1  # shingles of a class that were dealt
    share = tiles.groupBy("set_id").agg((F.count("*") / F.max(first)).alias("share"))
    rows = tiles.select("shingle", "set_id", "n", "place", F.floor(F.log(F.col("n")) / float(np.log(4 / 3))).alias("band")).join(share, "set_id")
    central = rows.groupBy("shingle", "band").agg(F.max(F.struct("share", "set_id", "n", "place")).alias("c"))
    near = rows.join(central, ["shingle", "band"]).filter(F.col("c.set_id") != F.col("set_id"))
    inter = F.least(F.col("c.n") - F.col("c.place"), F.col("n") - F.col("place"))
    near = near.filter(7 * inter >= 3 * (F.col("n") + F.col("c.n")))
    best = near.groupBy(F.col("set_id").alias("b")).agg(F.max(F.struct("c.share", "c.set_id")).alias("c"))
    return best.select(F.col("c.set_id").alias("a"), "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) for each row."""
    return _components(docs, id_col, text_col, sizes or Sizes())[0]


def _components(docs: DataFrame, id_col: str, text_col: str, sizes: Sizes) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of jaccard_components, and the staged tables that they are read from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = rows.select("text_key", "text")

    share = SAMPLE_ROWS / max(docs.count(), 1)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    often = sample.mapInArrow(_sampled, "shingle long").groupBy("shingle").count().filter("count >= 3").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toPandas()
    common = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    frequent = spark.sparkContext.broadcast((common[order], often["count"].to_numpy(np.int64)[order]))
    classes = staged(rows.mapInArrow(_classes(frequent), "doc_id long, n long, set_id long, bits binary, text_key long, prefix binary"), "classes")
    frequent.unpersist()
    signatures = classes.filter("n > 0").groupBy("set_id").agg(F.first("n").cast("int").alias("n"), F.first("bits").alias("bits"))

    prefixes = classes.filter("prefix is not null").select("set_id", "n", "prefix").mapInArrow(_prefixes, "shingle long, set_id long, n int, place int")
    dealt = prefixes.repartition("shingle").sortWithinPartitions("shingle", "n", "set_id")
    tiles = staged(dealt.mapInArrow(_banded(sizes.piece), "shingle long, set_id long, n int, place int, piece int, leader long, leader_n int, leader_place int"), "tiles")

    inter = F.least(F.col("leader_n") - F.col("leader_place"), F.col("n") - F.col("place"))
    led = tiles.filter((F.col("leader") != F.col("set_id")) & (7 * inter >= 3 * (F.col("n") + F.col("leader_n"))))
    some = led.groupBy(F.col("set_id").alias("b")).agg(F.array_distinct(F.array(F.min("leader"), F.max("leader"), F.min_by("leader", F.xxhash64("leader", "set_id")))).alias("a"))
    some = some.select(F.explode("a").alias("a"), "b").union(_to_central(tiles)).distinct()
    first = staged(_both(some, signatures, "bits").mapInArrow(_may_link, "a long, b long"), "pairs")
    links = verify(texts, classes, first)
    found = components(links)

    known = signatures.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("component"))
    mixed = _dealt(tiles, known).repartition("key").sortWithinPartitions("key").mapInArrow(_mixed, "key long, set_id long, n int, place int, side int, component long")
    mixed = staged(mixed, "mixed")
    signed = mixed.join(signatures.select("set_id", "bits"), "set_id").select("key", "set_id", "n", "place", "side", "component", "bits")
    across = signed.repartition("key").sortWithinPartitions("key").mapInArrow(_across(sizes.tile, sizes.few), "a long, b long").distinct()
    across = staged(across.join(first, ["a", "b"], "left_anti"), "pairs")
    discard(tiles, mixed)
    every = components(links.union(verify(texts, classes, across)))

    known = classes.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"))
    known = staged(known.join(every.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "known")
    # written, so that the join below deals both sides anew and a large component can be split
    lowest = staged(known.groupBy("component").agg(F.min("first_doc").alias("component_id")), "lowest")
    final = known.join(lowest, "component").select("set_id", "component_id")
    discard(first, across, links)
    joined = classes.filter("n > 0").select("doc_id", "n", "set_id").join(final, "set_id")
    alone = classes.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone), [classes, known, lowest]


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the least id, null ids last, and of rows with that same id one by its text.

    Rows are told apart by a hash of id and text, so ids may repeat or be null; of rows equal in both,
    which are always of one component, one stays. Rows without words link with nothing and all stay.
    """
    key = F.xxhash64("doc_id", "text").alias("row_key")
    found, read = _components(docs.select(key, "text"), "row_key", "text", Sizes())
    found = staged(found.filter("n_shingles > 0").select(F.col("doc_id").alias("row_key"), "component_id").distinct(), "found")
    discard(*read)
    places = docs.select(key, "doc_id").groupBy("row_key").agg(F.first("doc_id").alias("doc_id"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    first = found.join(places, "row_key").groupBy("component_id").agg(F.min(place).alias("place")).select("place.row_key")
    # copies of a row are dropped within each task before anything is shuffled
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = docs.select(key, F.struct(*docs.columns).alias("row"), worded.alias("worded"))
    kept = rows.filter("worded").dropDuplicates(["row_key"]).join(first, "row_key", "left_semi")
    return kept.select("row.*").unionByName(rows.filter("not worded").select("row.*"))
