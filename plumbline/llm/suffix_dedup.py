"""Suffix-array dedup: bytes of long strings that also start elsewhere are removed.

A sparse suffix array does the work. In every run of WINDOW possible starts, the start with the least
hash of its first bytes is an anchor; the choice depends on the string alone, so two equal strings of
LENGTH bytes have their anchor at the same offset. Strings are compared through rows of six tokens:
their first LEADS * 8 bytes as integers of the same order, a hash of the bytes that all candidate strings
of the row have in common (core), and a hash of all bytes that they reach (hull). Rows are
range-partitioned by leading tokens with splitters sampled by Spark, ties by place and by a number that
spreads the rows of one place, so that neither a string nor a text with very many copies is one task's;
the number of ranges follows the number of rows. Buckets sort by a multikey quicksort (a token is
compared only among rows equal in the tokens before it), and rows are compared with their neighbours,
the first and last rows of buckets across boundaries.

- Equal hulls: every string of the row is also elsewhere, and its bytes are covered.
- Equal cores, different hulls: some strings may be. One row of each such class goes on.
- Otherwise none is.

Three rounds do this: all strings of an anchor (suffixes), then runs of BLOCK strings, then single ones.
What goes on shrinks from round to round to the strings around the ends of repeats.

The same is done with words for bytes where that unit is asked for: strings of 51 words, whatever white
space is between them, with hashes of words for leading bytes. With several units each is judged on the
whole texts, and what any of them finds is removed.

Null or empty texts, and those shorter than LENGTH, lose nothing. Repeated rows match each other.
Results are carried by a hash of id and text, so rows equal in both get equal results, and a place of
such a text is kept once, however many rows have it. Equality is that of 64-bit hashes of core and hull
together (in the last round, of both halves of a string). Other columns are ignored or, where they are
asked for, carried in a struct of their own, so that no name clashes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import blocks, id_filter, maybe_in, shuffle_partitions, staged
from plumbline.llm.textblocks import Block, WordBlock, mix

LENGTH, WINDOW, GRAM, LEADS = 400, 200, 8, 4
BLOCK, RANGE_ROWS = 25, 500_000


@dataclass(frozen=True)
class Unit:
    """What strings are made of: how long they are, how many starts share an anchor, what chooses it, the starts of a second-round run.

    size: bytes that one takes, about; it sets the number of ranges only.
    """

    length: int
    window: int
    gram: int
    run: int
    size: int
    read: Callable[[list[bytes]], Block]


BYTES = Unit(LENGTH, WINDOW, GRAM, BLOCK, 1, Block)
WORDS = Unit(51, 26, 4, 5, 4, WordBlock)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` keys, the place of its least (the first of equals), from runs of twice the size each time."""
    n = len(keys) - width + 1
    least = (keys & ~np.uint64(0xFFFFFFFF)) | np.arange(len(keys), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return (np.minimum(least[:n], least[width - reach : width - reach + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(block: Block, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place of the anchor in the block, and its first and last own start, for all anchors."""
    texts = np.flatnonzero(block.ends - block.starts >= unit.length)
    if not len(texts):
        return (np.zeros(0, np.int64),) * 4
    n = len(block) - unit.gram + 1
    least = window_minima(mix((block.sums[unit.gram : unit.gram + n] - block.sums[:n]) * block.down[:n]), unit.window)
    out = []
    for t in texts.tolist():
        a, b = int(block.starts[t]), int(block.ends[t]) - unit.length + 1
        own = least[a:b]
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(own) - 1]])
        out.append((np.full(len(first), t), own[first], first + a, last + a))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def tokens(block: Block, text: np.ndarray, at: np.ndarray, low: np.ndarray | int, high: np.ndarray | int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Core and hull of the strings that start low to high places before `at`, and the hull's ends.

    The core is the same for all texts that hold one of these strings; the hull ends with the text.
    """
    core = block.hashes(at - low, at + length - high) + np.asarray(low, np.uint64)
    a, b = np.maximum(at - high, block.starts[text]), np.minimum(at + length - low, block.ends[text])
    return core, block.hashes(a, b) ^ mix(((at - a) * 4 * length + (b - at)).astype(np.uint64)), a, b


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order by columns; each column is sorted only among rows that are equal in all before it."""
    order = np.argsort(columns[0], kind="stable")
    tied = np.zeros(len(order), bool)
    run = np.zeros(len(order), np.int64)
    for before, column in zip(columns, columns[1:], strict=False):
        # runs of rows equal so far, by place in the order
        new = np.ones(len(order), bool)
        new[1:] = before[order[1:]] != before[order[:-1]]
        new[1:] |= run[1:] != run[:-1]
        run = np.cumsum(new)
        tied[:] = False
        tied[1:] = ~new[1:]
        tied[:-1] |= ~new[1:]
        some = np.flatnonzero(tied)
        if not len(some):
            break
        order[some] = order[some][np.lexsort((column[order[some]], run[some]))]
    return order


def leading(block: Block, starts: np.ndarray) -> list[np.ndarray]:
    """The first bytes from each place (or hashes of words), as integers."""
    return block.leading(starts, LEADS)


_TOKENS = [*(f"lead{i}" for i in range(LEADS)), "core", "hull"]
_COLUMNS = [*_TOKENS, "key", "at"]
_ROWS = ", ".join(f"{c} long" for c in _COLUMNS) + ", copy int"
_FOUND = "core long, hull long, key long, at long, settled boolean, more boolean, task long, last boolean, edge boolean"


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a bucket; yields rows that are settled or go on, and its first and last row as edges."""
    parts = [[batch.column(i).to_numpy() for i in range(len(_COLUMNS))] for batch in batches if batch.num_rows]
    if not parts:
        return
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    del parts
    order = multikey_order(columns[: len(_TOKENS)])
    columns = [c[order] for c in columns[LEADS:]]
    core, hull = (c[1:] == c[:-1] for c in columns[:2])
    none = np.zeros(1, bool)
    same, near = core & hull, core & ~hull
    settled = np.concatenate([none, same]) | np.concatenate([same, none])
    more = np.concatenate([none, near]) | np.concatenate([near, none])
    task = TaskContext.get().partitionId()

    def rows(pick: np.ndarray, last: list[bool], edge: bool) -> pa.RecordBatch:
        arrays = [*(c[pick] for c in columns), settled[pick], more[pick], np.full(len(pick), task)]
        return pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(last, pa.bool_()), pa.array([edge] * len(pick), pa.bool_())], names=["core", "hull", "key", "at", "settled", "more", "task", "last", "edge"])

    yield rows(np.array([0, len(core)]), [False, True], True)
    # of equal places of equal texts one row goes on, with what any of them has
    found = np.flatnonzero(settled | more)
    key, at = (c[found] for c in columns[2:])
    sort = np.lexsort((at, key))
    found, key, at = found[sort], key[sort], at[sort]
    new = np.ones(len(found), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    if len(found):
        first = np.flatnonzero(new)
        settled[found[first]], more[found[first]] = (np.logical_or.reduceat(x[found], first) for x in (settled, more))
        found = found[first]
    for i in range(0, len(found), 50_000):
        yield rows(part := found[i : i + 50_000], [False] * len(part), False)


def ranged(rows: DataFrame, about: int) -> DataFrame:
    """The rows (about so many) in ranges of the order of suffixes; equal rows may lie in several."""
    return rows.repartitionByRange(max(2, shuffle_partitions(rows), about // RANGE_ROWS), *_COLUMNS, "copy")


def compared(rows: DataFrame, name: str, about: int) -> DataFrame:
    """key, at, settled, more of the rows (about so many) that have an equal core elsewhere; a row may come twice."""
    found = staged(ranged(rows, about).mapInArrow(_bucket, _FOUND), name)
    # two rows a bucket, whatever the input: the last of each against the first of the next
    order = Window.orderBy("task", "last")
    other = [F.when(F.col("last"), F.lead(c).over(order)).otherwise(F.lag(c).over(order)).alias(f"other_{c}") for c in ("core", "hull")]
    edges = found.filter("edge").select("key", "at", "core", "hull", "settled", "more", *other)
    edges = edges.select("key", "at", F.expr("settled or coalesce(core = other_core and hull = other_hull, false)").alias("settled"), F.expr("more or coalesce(core = other_core and hull <> other_hull, false)").alias("more"))
    return found.filter("not edge").select("key", "at", "settled", "more").unionByName(edges.filter("settled or more"))


def _raws(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _suffix_rows(unit: Unit):
    """Rows for all strings of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(blocks(batches, "text")):
            block = unit.read(_raws(batch.column(1)))
            text, at, _, _ = anchors(block, unit)
            if len(at):
                core, hull, _, _ = tokens(block, text, at, 0, unit.window - 1, unit.length)
                yield _token_batch(leading(block, at), core, hull, batch.column(0).to_numpy()[text], at - block.starts[text], n)

    return run


_suffixes = _suffix_rows(BYTES)


def _token_batch(leads: list[np.ndarray], core: np.ndarray, hull: np.ndarray, keys: np.ndarray, at: np.ndarray, batch: int) -> pa.RecordBatch:
    """Rows of tokens; `copy` is of the task and batch that made them, so it is the same in every attempt."""
    copy = np.full(len(at), (TaskContext.get().partitionId() * 1_000_003 + batch) % (1 << 31), np.int32)
    return pa.RecordBatch.from_arrays([*map(pa.array, (*leads, core.view(np.int64), hull.view(np.int64), keys, at, copy))], names=[*_COLUMNS, "copy"])


def _runs_of(block: Block, i: int, places: np.ndarray, width: int, window: int) -> tuple[np.ndarray, ...]:
    """For places (anchor * window + least distance of a run of strings): anchor in the block, low, high."""
    at, low = places // window + block.starts[i], places % window
    return at, low, np.minimum(low + width, window) - 1


def _run_rows(unit: Unit, width: int):
    """Rows for the runs of strings that are still open, listed in `open`."""
    half, length = unit.length // 2, unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(blocks(batches, "text")):
            block = unit.read(_raws(batch.column(1)))
            for i, raw in enumerate(batch.column(2).to_pylist()):
                every = np.frombuffer(raw, np.int64)
                for k in range(0, len(every), 50_000):
                    places = every[k : k + 50_000]
                    at, low, high = _runs_of(block, i, places, width, unit.window)
                    if width > 1:
                        core, hull, _, _ = tokens(block, np.full(len(at), i), at, low, high, length)
                    else:  # one string: its halves
                        core, hull = block.hashes(at - low, at - low + half), block.hashes(at - low + half, at - low + length)
                    yield _token_batch(leading(block, at - low), core, hull, np.full(len(at), batch.column(0)[i].as_py()), places, n)

    return run


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of spans (start, end)."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], np.maximum.reduceat(spans[:, 1], np.flatnonzero(new))], 1)


_RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary()), ("kept", pa.string())]
_RESULT_DDL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept string"


def _cut(raw: bytes, spans: np.ndarray, keep: bool) -> tuple:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(raw[at:a])
        at = b
    rest = b"".join([*out, raw[at:]])
    return len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), spans.astype("<i8").tobytes(), rest.decode("utf-8", "ignore") if keep else None


def _covered(block: Block, i: int, places: np.ndarray, width: int, unit: Unit) -> np.ndarray:
    """The hulls of settled runs, as spans of the text's bytes; none where no string fits in."""
    at, low, high = _runs_of(block, i, places, width, unit.window)
    a, b = np.maximum(at - high, block.starts[i]), np.minimum(at + unit.length - low, block.ends[i])
    return block.in_bytes(i, (np.stack([a, b], 1) - block.starts[i])[b - a >= unit.length])


def _marks(scalar) -> tuple[np.ndarray, np.ndarray]:
    """Places that are settled, and that go on, of one text's marks."""
    if not scalar.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, settled, more = (c.to_numpy(zero_copy_only=False) for c in scalar.values.flatten())
    return np.unique(at[settled]), np.unique(at[more])


def _next_round(unit: Unit, width: int, then: int, keep: bool):
    """Texts with their marks: spans so far, and either a result or the runs of width `then` that are open."""
    window = unit.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            raws = _raws(batch.column(1))
            block = unit.read(raws)
            if width == window:
                text, at, first, last = anchors(block, unit)
                bounds = np.searchsorted(text, np.arange(len(raws) + 1))
            rows, opened = [], []
            for i, (raw, marks, before) in enumerate(zip(raws, batch.column(2), batch.column(3), strict=True)):
                settled, more = _marks(marks)
                if width == window:  # marks are the anchors' places
                    settled, mine = settled * window, slice(bounds[i], bounds[i + 1])
                    places, order = at[mine] - block.starts[i], np.argsort(at[mine], kind="stable")
                    pick = order[np.searchsorted(places[order], more)]
                    near, far = (at[mine] - last[mine])[pick], (at[mine] - first[mine])[pick]
                else:
                    near, far = more % window, np.minimum(more % window + width, window) - 1
                    more = more // window
                spans = joined_spans(np.concatenate([np.frombuffer(before.as_py() or b"", np.int64).reshape(-1, 2), _covered(block, i, settled, width, unit)]))
                if not then or not len(more):
                    rows.append(_cut(raw, spans, keep))
                    opened.append(None)
                    continue
                # runs of width `then`, as far as their strings lie in the text and have this anchor
                near, far = np.maximum(near, more + unit.length - int(block.ends[i] - block.starts[i])), np.minimum(far, more)
                low = near // then * then
                count = np.maximum((far - low) // then + 1, 0)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                places = np.repeat(more * window + low, count) + step * then
                if then == 1:  # runs reach over their anchor's own strings: each start once
                    places = places[np.unique(places // window - places % window, return_index=True)[1]]
                rows.append((None, None, None, None, spans.tobytes(), None))
                opened.append(places.tobytes())
            texts = [x if o is not None else None for x, o in zip(batch.column(1).to_pylist(), opened, strict=True)]
            columns = [pa.array(c, kind) for (_, kind), c in zip(_RESULT, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(opened, pa.binary()), *columns, batch.column(4)], names=["key", "text", "open", *(n for n, _ in _RESULT), "rest"])

    return run


def _n_open(texts: DataFrame) -> int:
    """The number of runs that are open in the texts."""
    return (texts.agg(F.sum(F.octet_length("open").cast("long"))).first()[0] or 0) // 8


def _cut_rows(rows: DataFrame, unit: Unit, before: DataFrame | None, keep: bool) -> tuple[DataFrame, DataFrame]:
    """Results of rows (key, text, rest): of those that lose something or might, with their key, and of all others.

    before: spans (of keys, one row a key) that go too.
    """
    spark = rows.sparkSession
    rest_ddl = f"rest {rows.schema['rest'].dataType.simpleString()}"

    def texts_with(frame: DataFrame, marks: DataFrame, width: int, then: int) -> DataFrame:
        of_key = marks.groupBy("key").agg(F.collect_list(F.struct("at", "settled", "more")).alias("marks"))
        joined = frame.join(of_key, "key", "left").select("key", "text", "marks", "spans", "rest")
        return joined.mapInArrow(_next_round(unit, width, then, keep), f"key long, text string, open binary, {_RESULT_DDL}, {rest_ddl}")

    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    marks = compared(rows.select("key", "text").mapInArrow(_suffix_rows(unit), _ROWS), "suffixes", 2 * n_bytes // (unit.size * unit.window))
    keys = marks.select("key") if before is None else marks.select("key").union(before.select("key"))
    words = spark.sparkContext.broadcast(id_filter(keys.distinct(), "key"))

    @F.pandas_udf("boolean")
    def marked(keys: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(words.value, keys.to_numpy()))

    some = rows.filter(marked("key"))
    some = some.withColumn("spans", F.lit(None).cast("binary")) if before is None else some.join(before, "key", "left")
    first = staged(texts_with(some, marks, unit.window, unit.run), "first")
    still = first.filter("open is not null")
    marks = compared(still.select("key", "text", "open").mapInArrow(_run_rows(unit, unit.run), _ROWS), "runs", _n_open(still))
    second = staged(texts_with(still.select("key", "text", "spans", "rest"), marks, unit.run, 1), "second")
    still = second.filter("open is not null")
    marks = compared(still.select("key", "text", "open").mapInArrow(_run_rows(unit, 1), _ROWS), "strings", _n_open(still)).filter("settled")
    last = texts_with(still.select("key", "text", "spans", "rest"), marks, 1, 0)
    columns = ["key", "rest", *(n for n, _ in _RESULT)]
    found = last.select(columns)
    for part in (first, second):
        found = found.union(part.filter("open is null").select(columns))
    raw = F.encode("text", "UTF-8")
    alone = rows.filter(~marked("key")).select("key", "rest", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), F.encode(F.lit(""), "UTF-8").alias("spans"), (F.col("text") if keep else F.lit(None).cast("string")).alias("kept"))
    return found, alone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None, keep: bool = False, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (little-endian pairs of longs), kept for each row.

    carried: further columns that stay with their rows, in a struct `rest`. keep: `kept` holds the remaining
    text; pieces of a character at the edge of a removed run go with it. units: strings of any of these go.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rest = F.struct(F.col(id_col).cast("long").alias("doc_id"), *(carried or [])).alias("rest")
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), text, rest)
    spans = None
    for unit in units[:-1]:
        found, _ = _cut_rows(rows.select("key", "text", F.lit(True).alias("rest")), unit, spans, False)
        spans = staged(found.filter("n_spans > 0").groupBy("key").agg(F.first("spans").alias("spans")), "spans")
    found, alone = _cut_rows(rows, units[-1], spans, keep)
    return alone.union(found).select(F.col("rest.doc_id").alias("doc_id"), "rest", *(n for n, _ in _RESULT))


def without_repeats(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """The rows of docs with the remaining text, and n_chars of it."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    back = remove_repeats(docs, carried=others, keep=True, units=units).select("doc_id", F.col("kept").alias("text"), "rest")
    have = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return back.select(*(have.get(c, F.col("rest")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
