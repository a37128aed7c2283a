"""WARC fixity audit by Merkle trees over ranges of offsets.

Pages become WARC response records. A replica is told by its runs (archive, key, offset, bytes, sha,
copies): equal records of a key that lie side by side, with the offset observed in the archive. Where a
replica comes as plain records (key, record), `lay_out` places them: in archives of ARCHIVE consecutive
record keys in order of keys, or where another replica has them.

A leaf is a range of LEAF bytes of an archive: the additive digest of all runs that start in it, each
hashed with its offset, so any order and partial aggregation give one digest. A node covers FANOUT
consecutive ranges of the level below and hashes them in order, each with its place and length. There
are as many levels as the largest offset needs. The audit compares the roots of two replicas, joins the
children of mismatching nodes only, level by level, and compares the runs of mismatching leaves: a record
at another place differs as one with other bytes does. Each replica is read once: its runs, then each
level, are written tables, and so is what is found on each level down.

Null url or html is empty; null keys are left out (a record without an id can't be located) and
reported by no row. Records without an offset lie in a range of their own. Repeated records are copies of
one key, in any order. Running offsets are summed within parts of a key by the hash of its records, then
over parts, so a key with very many records is no task's alone. Columns besides those named are ignored.
Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import staged

FANOUT, ARCHIVE, LEAF = 256, 4096, 1 << 16
RUN = ("archive", "key", "offset", "bytes", "sha", "copies")


def to_records(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """key and the bytes of the WARC record of each page."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    key = F.col(id_col).cast("long")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), key.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.filter(key.isNotNull()).select(key.alias("key"), F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def parent_of(node: str, width: int = FANOUT) -> Column:
    """node / width, rounded down, in whole numbers."""
    return F.expr(f"({node} - pmod({node}, {width}L)) div {width}L")


def observed(records: DataFrame) -> DataFrame:
    """The runs of records whose archive and offset are known (archive, key, offset, record)."""
    rows = records.filter("key is not null").select("archive", "key", "offset", F.octet_length("record").cast("long").alias("bytes"), F.sha2("record", 256).alias("sha"))
    return rows.groupBy("archive", "key", "offset", "bytes", "sha").agg(F.count("*").alias("copies"))


def lay_out(records: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The runs of records (key, record) written in order of keys, those of a key in order of their hash.

    like: runs of another replica; a key's records then start where they do there, and a key that isn't
    there has no offset.
    """
    rows = records.select("key", F.octet_length("record").cast("long").alias("bytes"), F.sha2("record", 256).alias("sha"))
    runs = rows.groupBy("key", "bytes", "sha").agg(F.count("*").alias("copies"))
    runs = staged(runs.select(parent_of("key", ARCHIVE).alias("archive"), "key", F.substring("sha", 1, 3).alias("part"), "bytes", "sha", "copies"), "records")
    size, keys = F.expr("bytes * copies"), ["archive", "key", "part"]

    def before(what: Column, by: list[str], order: list[str]) -> Column:
        return F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = runs.groupBy(*keys).agg(F.sum(size).alias("total"))
    parts = parts.select(*keys, before(F.col("total"), ["archive"] if like is None else ["archive", "key"], ["key", "part"]).alias("start"))
    placed = runs.withColumn("within", before(size, keys, ["sha", "bytes"])).join(parts, keys)
    offset = F.col("start") + F.col("within")
    if like is not None:
        base = like.groupBy("key").agg(F.min("archive").alias("there"), F.min("offset").alias("base"))
        placed = placed.join(base, "key", "left").withColumn("archive", F.coalesce("there", "archive"))
        offset = offset + F.col("base")
    return placed.select("archive", "key", offset.alias("offset"), "bytes", "sha", "copies")


def leaves(runs: DataFrame) -> DataFrame:
    """One row per range of offsets in which runs start: archive, node, bytes, digest."""
    each = runs.select("archive", "node", F.expr("bytes * copies").alias("bytes"), F.sha2(F.concat_ws(":", "offset", "key", "bytes", "copies", "sha"), 256).alias("hash"))
    sums = [F.sum(F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return each.groupBy("archive", "node").agg(F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("digest"))


def levels(leaf: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes (archive, node, bytes, digest) of each level, leaves first, the roots of archives last."""
    out = [staged(leaf, "level0")]
    for level in range(1, depth + 1):
        up = out[-1].groupBy("archive", parent_of("node").alias("parent")).agg(F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct("node", "bytes", "digest"))).alias("children"))
        joined = F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["node"].cast("string"), x["bytes"].cast("string"), x["digest"])), "|")
        out.append(staged(up.select("archive", F.col("parent").alias("node"), "bytes", F.sha2(joined, 256).alias("digest")), f"level{level}"))
    return out


def mismatches(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """The leaves (archive, node) that differ or stand in one replica only; only children of differing nodes are read."""

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("archive", "node", F.col("digest").alias("a")).join(b.select("archive", "node", F.col("digest").alias("b")), ["archive", "node"], "full_outer")
        return staged(both.filter("not (a <=> b)").select("archive", "node"), "mismatches")

    def descend(found: DataFrame, level: int) -> DataFrame:
        parents = found.select("archive", F.col("node").alias("parent"))
        return differing(*(x[level].withColumn("parent", parent_of("node")).join(parents, ["archive", "parent"], "left_semi") for x in (left, right)))

    return reduce(descend, range(len(left) - 2, -1, -1), differing(left[-1], right[-1]))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per key of two replicas: archive, offset, bytes and copies in the first, status, found_offset.

    A replica is a table of runs, or of records (key, record), which `lay_out` places: the first in order
    of keys, the second where the first has them. status: ok; corrupt (other bytes or another number of
    copies); moved (the same records elsewhere; found_offset is the first new place); missing (none in the
    second); extra (in the second only; no offset, bytes and copies). A key whose records lie in several
    archives or places is told by the first of them.
    """
    if "record" in left.columns:
        left = lay_out(left)

    def with_ranges(runs: DataFrame) -> DataFrame:
        at = F.coalesce(F.col("offset"), F.lit(-1)).cast("long")
        return staged(runs.filter("key is not null").select(*RUN).withColumn("offset", at).withColumn("node", parent_of("offset", LEAF)), "runs")

    a = with_ranges(left)
    b = with_ranges(lay_out(right, a) if "record" in right.columns else right)
    last = max(x.agg(F.max("node")).first()[0] or 0 for x in (a, b))
    depth = next(d for d in range(64) if FANOUT**d > last)
    found = mismatches(levels(leaves(a), depth), levels(leaves(b), depth))

    sides = [x.join(found, ["archive", "node"], "left_semi").select(*RUN[:-1], *((F.col("copies") if i == k else F.lit(0).cast("long")).alias(n) for k, n in enumerate(("here", "there")))) for i, x in enumerate((a, b))]
    places = sides[0].unionByName(sides[1]).groupBy(*RUN[:-1]).agg(F.sum("here").alias("here"), F.sum("there").alias("there")).filter("here <> there")
    both = [F.sum(n).alias(n) for n in ("here", "there")]
    contents = places.groupBy("key", "bytes", "sha").agg(*both, F.min("archive").alias("in"), F.min(F.expr("if(there > here, offset, null)")).alias("found_offset"))
    keys = contents.groupBy("key").agg(*both, F.min("in").alias("in"), F.min("found_offset").alias("found_offset"), F.bool_and(F.expr("here = there")).alias("same"))

    whole = a.groupBy("key").agg(F.min(F.struct("archive", "offset")).alias("place"), F.sum(F.expr("bytes * copies")).alias("bytes"), F.sum("copies").alias("copies"))
    rows = whole.join(keys, "key", "full_outer")
    status = F.expr("case when copies is null then 'extra' when here is null then 'ok' when same then 'moved' when there = 0 and here = copies then 'missing' else 'corrupt' end")
    offset = F.expr("nullif(place.offset, -1)")
    return rows.select("key", F.coalesce("place.archive", "in").alias("archive"), offset.alias("offset"), "bytes", "copies", status.alias("status"), F.expr("if(same and copies is not null, found_offset, null)").alias("found_offset"))
