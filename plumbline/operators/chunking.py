"""Spans to chunks: token windows, child chunks, lineage, types, running macro numbers."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.functions import rules, scan
from plumbline.functions.textnorm import WHITE, is_title, is_upper, numbered
from plumbline.session import prepare

#: A token: what stands between white space as SQL's patterns see it.
TOKEN = re.compile("[^ \t\n\x0b\f\r]+")


def page_tokens(pages: DataFrame) -> DataFrame:
    """Tokens of each page text with their offsets, and the page's number of tokens."""
    found = pages.select("doc_id", "page_number", F.regexp_extract_all("text", F.lit("^\\s*\\S+\\s*|\\S+\\s*"), F.lit(0)).alias("parts")).withColumn("n", F.size("parts"))
    # n is made before the explode, so that no exploded row carries its page's array
    parts = found.select("doc_id", "page_number", "n", F.posexplode("parts").alias("pos", "part"))
    before = Window.partitionBy("doc_id", "page_number").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.regexp_replace("part", "^\\s+", "")
    start = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.length("part") - F.length(tail)
    token = F.regexp_replace(tail, "\\s+$", "")
    return parts.select("doc_id", "page_number", "n", "pos", start.cast("int").alias("start"), (start + F.length(token)).cast("int").alias("end"))


def macro_windows(tokens: DataFrame, size: int = 8192, overlap: int = 256) -> DataFrame:
    """Windows of `size` tokens that overlap; a window starts at 0 or before n - overlap."""
    n = tokens.groupBy("doc_id", "page_number").agg(F.count("*").cast("int").alias("n"))
    starts = n.select("doc_id", "page_number", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size - overlap))).alias("first"))
    kept = starts.filter((F.col("first") == 0) | (F.col("first") < F.col("n") - overlap))
    return kept.withColumn("macro_no", F.floor(F.col("first") / (size - overlap)).cast("int")).withColumn("last", F.least(F.col("first") + size, "n") - 1)


def token_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of TOKEN start and end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def children(text: str, child: int, size: int, overlap: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Macro number, child number, first and last offset and tokens of each child of a text."""
    starts, ends = token_bounds(text)
    n = len(starts)
    for macro, first in enumerate(range(0, n, size - overlap)):
        if first and first >= n - overlap:
            break
        end = min(first + size, n)
        for number, at in enumerate(range(first, end, child)):
            last = min(at + child, end)
            yield macro, number, int(starts[at]), int(ends[last - 1]), last - at


def page_children(pages: DataFrame, child: int = 256, size: int = 8192, overlap: int = 256) -> DataFrame:
    """Runs of `child` tokens within each macro window of a page; no token is a row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, *c) for row, text in enumerate(batch.column("text").to_pylist()) for c in children(text or "", child, size, overlap)]
            x = np.array(found, np.int64).reshape(-1, 6)
            keys = batch.take(pa.array(x[:, 0])).select(["doc_id", "page_number"])
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(x[:, k].astype(np.int32)) for k in range(1, 5)), pa.array(x[:, 5])], names=["doc_id", "page_number", "macro_no", "child_id", "char_start", "char_end", "n_tokens"])

    prepare(pages.sparkSession)
    return pages.select("doc_id", "page_number", "text").mapInArrow(cut, f"{_ddl(pages, 'doc_id', 'page_number')}, macro_no int, child_id int, char_start int, char_end int, n_tokens long")


def _ddl(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def chunk_type(text: Column) -> Column:
    t = F.btrim(text, F.lit(WHITE))
    short = F.length(t) <= 80
    heading = (short & (is_upper(t) | t.endswith(":") | is_title(t))) | ((F.length(t) <= 100) & numbered(t)) | t.rlike("(?i)^Note\\s+\\d+")
    plate = F.lit(False)
    for phrase in rules.BOILERPLATE:
        plate = plate | F.upper(t).contains(phrase)
    return F.when(t == "", "boilerplate").when(heading, "heading").when((F.length(t) <= 120) & plate, "boilerplate").otherwise("narrative")


def _overlapping(first: list[int], last: list[int], start: int, end: int) -> range:
    """Which of the spans first[i]..last[i] (in order, apart) overlap start..end."""
    return range(bisect_right(last, start), bisect_left(first, end))


def chunks(spans: DataFrame, macro: int = 8192, overlap: int = 256, child: int = 256) -> DataFrame:
    """Chunks of the spans of pages: on each page tables first, then macro windows, numbered over the document.

    Spans come together once, as a page; its text, windows, children and their lineage (heading and section of the
    first span with one, by bisection) are made there. Macro numbers go on from the pages before. The
    spans are read twice: hand over a written table.
    """
    prepare(spans.sparkSession)
    names = ("span_no", "char_start", "is_table", "text", "heading_path", "section_id")
    pages = spans.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("spans"))
    schema = f"{_ddl(spans, 'doc_id', 'page_number')}, place int, child_id int, char_start int, char_end int, text_content string, heading_path string, section_id string, n_spans int, is_table boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("spans")
            bounds, values = held.offsets.to_pylist(), held.values
            starts, kinds, texts, paths, sections = (values.field(c).to_pylist() for c in ("char_start", "is_table", "text", "heading_path", "section_id"))
            rows = []
            for row, (begin, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
                tables, lines = [i for i in range(begin, end) if kinds[i]], [i for i in range(begin, end) if not kinds[i]]
                rows += [(row, place, 0, starts[i], starts[i] + len(texts[i]), texts[i], paths[i], sections[i], 1, True) for place, i in enumerate(tables)]
                text = "\n".join(texts[i] for i in lines)
                first, last = [starts[i] for i in lines], [starts[i] + len(texts[i]) for i in lines]
                for number, at, start, stop, _ in children(text, child, macro, overlap):
                    under = _overlapping(first, last, start, stop)
                    named = (next((own[lines[i]] for i in under if own[lines[i]]), None) for own in (paths, sections))
                    rows.append((row, len(tables) + number, at, start, stop, text[start:stop], *named, len(under), False))
            if rows:
                own, *columns = zip(*rows, strict=True)
                keys = batch.select(["doc_id", "page_number"]).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:], strict=True))], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    # A page's numbers start after the tables and macro windows of the pages before it.
    tokens = F.sum(F.when(~F.col("is_table"), F.size(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0)))).otherwise(0))
    more = F.greatest(F.ceil((F.col("tokens") - overlap) / (macro - overlap)), F.lit(1))
    counts = spans.groupBy("doc_id", "page_number").agg(tokens.alias("tokens"), F.count_if("is_table").alias("tables"))
    counts = counts.select("doc_id", "page_number", (F.col("tables") + F.when(F.col("tokens") > 0, more).otherwise(0)).alias("macros_"))
    rows = pages.mapInArrow(cut, schema).join(scan.before(counts, {"macros_": "sum"}), ["doc_id", "page_number"])
    kind = F.when(F.col("is_table"), "table").otherwise(chunk_type(F.col("text_content")))
    return rows.select("doc_id", "page_number", (F.col("macros_") + F.col("place")).cast("int").alias("macro_id"), "child_id", "char_start", "char_end", "text_content", "heading_path", "section_id", "n_spans", F.array("page_number").alias("page_numbers"), kind.alias("chunk_type"))


def late_pooling(token_vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise mean of the token vectors of each child."""
    rows = token_vectors.select(*keys, F.posexplode("vector").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("vector"))
