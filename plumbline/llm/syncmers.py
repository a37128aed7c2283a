"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is read as units: a unit ends at white space, after a border and before it can have more than UNIT code
points. Borders are every sixth printable ASCII character by its number and every code point beyond ASCII, so
that their places are chosen by the text itself and not by a count from some start: letters of other scripts
are units of their own, words and unspaced ASCII are cut at their borders. Only a stretch of more than UNIT
code points without any border is cut by count, up to the next border. A k-mer of units is chosen when its
smallest inner s-mer lies at its first or last place. The choice depends on the k-mer alone, so an edit moves no
anchor outside its own k-mers: anchors are context-free, and their places tell where two texts match. A
fingerprint is the set of a text's anchors, as text all of them in hexadecimal form, in order. Likeness is the
Jaccard likeness of two such sets. `anchors` gives every anchor with its place, for joins on passages;
`aligned_edited` is the share of a text's anchors that stand at the same place in its edited text.

Null texts are empty. An empty text has an empty fingerprint; its likeness is 1 to an empty text and 0
to any other. A text too short for a k-mer has its whole units as its only anchor. The next document is
the one with the next larger id, null ids first; rows with equal ids follow one another by text, and
equal rows are each other's next. Very long texts count whole, one at a time. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import shuffle_partitions

UNIT, K, S = 12, 7, 3
BORDER = "".join(f"\\x{c:02X}" for c in range(33, 127) if c % 6 == 1)
_INNER = f"[^ \\t-\\r{BORDER}\\x80-\\x{{10FFFF}}]"
UNITS = f"{_INNER}{{0,{UNIT - 1}}}[{BORDER}\\x80-\\x{{10FFFF}}]|{_INNER}{{1,{UNIT}}}"
RANGE_BYTES, GRID = 32 << 20, 10_000


def syncmer_columns(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds {prefix}_places, the units at which chosen k-mers start, and {prefix}_anchors, their hashes in that order."""
    units, smer, n = f"{prefix}_u", f"{prefix}_s", f"size({prefix}_u)"
    df = df.withColumn(units, F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)))
    joined = ", ".join(f"{units}[i{f' + {j}' if j else ''}]" for j in range(S))
    df = df.withColumn(smer, F.expr(f"if({n} < {K}, array(xxhash64(array_join({units}, ','))), transform(sequence(0, {n} - {S}), i -> xxhash64({joined})))"))
    last = K - S
    inner = ", ".join(f"{smer}[i + {j}]" for j in range(1, last))
    df = df.withColumn(f"{prefix}_places", F.expr(f"if({n} < {K}, if({n} = 0, cast(array() as array<int>), array(0)), filter(sequence(0, {n} - {K}), i -> least({smer}[i], {smer}[i + {last}]) <= least({inner})))"))
    spans = ", ".join(f"{smer}[i + {j}]" for j in sorted({*range(0, last, S), last}))
    df = df.withColumn(f"{prefix}_anchors", F.expr(f"if({n} < {K}, slice({smer}, 1, size({prefix}_places)), transform({prefix}_places, i -> xxhash64({spans})))"))
    return df.drop(units, smer)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, anchor, place (in units) for every anchor of every row: equi-joins on anchor find common passages."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = syncmer_columns(rows, "text", "own").select("doc_id", F.explode(F.arrays_zip("own_anchors", "own_places")).alias("at"))
    return found.select("doc_id", F.col("at.own_anchors").alias("anchor"), F.col("at.own_places").alias("place"))


def matches(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """Passages that rows of two sets of anchors have in common: left_id, right_id, shift, n_anchors, first, last.

    Anchors match where they are equal; those of one passage have the same shift between their places.
    Give one side few rows (passages to be found), the join being on anchors.
    """
    a = left.select(F.col("doc_id").alias("left_id"), "anchor", F.col("place").alias("at"))
    both = a.join(right.select(F.col("doc_id").alias("right_id"), "anchor", "place"), "anchor")
    found = both.groupBy("left_id", "right_id", (F.col("place") - F.col("at")).alias("shift")).agg(F.countDistinct("at").alias("n_anchors"), F.min("at").alias("first"), F.max("at").alias("last"))
    return found.filter(F.col("n_anchors") >= least)


def as_text(anchor_set: str) -> Column:
    return F.expr(f"array_join(transform(sort_array({anchor_set}), x -> lpad(hex(x), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of anchors (distinct); two empty ones are alike."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, transform(array(size(array_intersect({a}, {b}))), both_ -> cast(both_ as double) / (size({a}) + size({b}) - both_))[0])")


def with_next(rows: DataFrame, order: str, size: str, prepare: Callable[[DataFrame], DataFrame], columns: list[str], partitions: int | None = None) -> DataFrame:
    """prepare(rows) with next_<column> of the row with the next larger `order` (after the last: of the first).

    The order is cut into ranges at quantiles of the key, so many that one holds about RANGE_BYTES of
    the column `size`. Each range takes in the first row of the next one, so that no window spans more
    than a range and the rows are shuffled once, as they are read.
    """
    grid = F.expr(f"percentile_approx({order}, array({', '.join(f'{i / GRID}D' for i in range(1, GRID))}), {10 * GRID})")
    found = rows.agg(grid.alias("grid"), F.sum(F.octet_length(size).cast("long")).alias("bytes")).first()
    n = min(GRID, partitions or max(2, shuffle_partitions(rows), (found["bytes"] or 0) // RANGE_BYTES))
    grid = found["grid"] or []
    cuts = sorted({grid[i * GRID // n - 1] for i in range(1, n)}) if grid else []
    placed = rows.withColumn("range_", _place(cuts, order))
    # two numbers a range: its first row is read by its key, nulls come first
    least = placed.groupBy("range_").agg(F.min(order).alias("least"), F.max(F.col(order).isNull()).alias("nulls")).collect()
    ranges = sorted(r["range_"] for r in least)
    heads = F.col(order).isin([r["least"] for r in least if not r["nulls"]])
    if any(r["nulls"] for r in least):
        heads = heads | F.col(order).isNull()
    whole = F.struct(order, *(c for c in rows.columns if c != order))
    firsts = placed.filter(heads).groupBy("range_").agg(F.min(whole).alias("row")).select("row.*", "range_")
    # each first row goes to the range before it, that of the first range to the last
    before = {b: a for a, b in zip([ranges[-1], *ranges], ranges, strict=False)} if ranges else {0: 0}
    to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    every = placed.withColumn("extra_", F.lit(0)).unionByName(firsts.withColumn("range_", to[F.col("range_")]).withColumn("extra_", F.lit(1)))
    sorted_ = every.repartitionById(n, "range_").sortWithinPartitions("range_", "extra_", order, *columns[:1])
    window = Window.partitionBy("range_").orderBy("extra_", order, *columns[:1])
    return prepare(sorted_).select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in columns)).filter("extra_ = 0").drop("range_", "extra_")


def _place(cuts: list[int], order: str) -> Column:
    """The number of cuts up to a key: first among every m-th one, then among the m that follow."""
    if not cuts:
        return F.lit(0)
    m = max(1, int(len(cuts) ** 0.5))
    every, some = (f"cast(split('{','.join(map(str, c))}', ',') as array<bigint>)" for c in (cuts, cuts[m - 1 :: m]))
    block = f"size(filter({some}, cut_ -> cut_ <= {order}))"
    return F.expr(f"cast({block} * {m} + size(filter(slice({every}, {block} * {m} + 1, {m}), cut_ -> cut_ <= {order})) as int)")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, aligned_edited for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def with_anchors(df: DataFrame, text: str, prefix: str) -> DataFrame:
        df = syncmer_columns(df, text, prefix)
        placed = F.expr(f"transform({prefix}_places, (x, i) -> xxhash64(x, {prefix}_anchors[i]))")
        return df.select(*(c for c in df.columns if c != f"{prefix}_places"), placed.alias(f"{prefix}_placed")).withColumn(f"{prefix}_anchors", F.array_distinct(f"{prefix}_anchors"))

    both = with_next(rows, "doc_id", "text", lambda df: with_anchors(df, "text", "own"), ["text", "own_anchors"])
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 4)), substring(next_text, 1, int(n_chars div 4)))"))
    done = with_anchors(both, "edited", "edited")
    aligned = F.expr("if(size(own_placed) = 0, 1.0D, cast(size(array_intersect(own_placed, edited_placed)) as double) / size(own_placed))")
    return done.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text("own_anchors").alias("fingerprint"), as_text("edited_anchors").alias("edited_fingerprint"), likeness("own_anchors", "edited_anchors").alias("near_edited"), likeness("own_anchors", "next_own_anchors").alias("near_next"), aligned.alias("aligned_edited"))
