"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

A sentencepiece BPE model without pieces that hold a space mark after another character never merges
across the start of a run of space marks. A text therefore falls into pre-tokens (a run of space marks
and what follows up to the next run), and its count is the sum over its pre-tokens. No ids are kept:

1. the distinct pre-tokens of the corpus with their frequencies (counted in each task, then by key);
2. the number of pieces of each distinct pre-token, once;
3. per document: frequent pre-tokens, a table of at most `head` rows, are summed in the scan; all other
   pre-tokens leave as (document, pre-token, frequency) rows for an equi-join. The lowest frequency of
   that table is read off a histogram of some hundred rows, so that only its own rows reach the driver.

Very long texts count whole, one at a time; so does a long run without a space mark, which is one pre-token.
Null or empty texts have 0 tokens and 0 bytes; an empty table gives no rows. Rows are counted one by one:
repeated doc_ids stay repeated. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import same_file, staged

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space mark, which the library adds again."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [m[1:] for m in _RUNS.findall(MARK + text.replace(" ", MARK))]


def _load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=same_file(path))
    if any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("the model has pieces that go on after a space mark; its texts can't be cut there")
    return model


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, head: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. head bounds the broadcast table (rows)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_pydict({"piece": pa.array(list(seen), pa.string()), "freq": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                seen.update(pretokens(text.as_py()))
                if len(seen) > 300_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _load(model)
        for batch in batches:
            words = [x.replace(MARK, " ") for x in batch.column(0).to_pylist()]
            # an empty remainder is a lone mark at the end of a text: the library takes "" as no text at all
            counts = [len(ids) if word else 1 for word, ids in zip(words, sp.encode(words, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=["piece", "freq", "n"])

    distinct = rows.select("text").mapInArrow(vocabulary, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    counted = staged(distinct.mapInArrow(pieces, "piece string, freq long, n long"), "pieces")
    step = F.floor(F.log2("freq") * 8)
    sizes = counted.filter("freq > 1").groupBy(step.alias("step")).count().orderBy(F.desc("step")).toPandas()
    fitting = sizes["step"][sizes["count"].cumsum() <= head]
    least = int(fitting.min()) if len(fitting) else None
    top = counted.filter(F.lit(False) if least is None else (F.col("freq") > 1) & (step >= least)).select("piece", "n").toPandas()
    table = spark.sparkContext.broadcast(dict(zip(top["piece"], top["n"].tolist(), strict=True)))

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        out: dict[str, list] = {k: [] for k in ("rid", "doc_id", "n_bytes", "base", "piece", "freq")}

        def row(*values):
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)

        def flush():
            done = pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "piece" else pa.int64()) for k, v in out.items()], names=list(out))
            for v in out.values():
                v.clear()
            return done

        for batch in batches:
            for rid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base, rest = 0, []
                for word in pretokens(text):
                    n = known.get(word)
                    if n is None:
                        rest.append(word)
                    else:
                        base += n
                # a key of its own, so that these rows spread over the join's partitions
                row(rid, doc_id, len(text.encode("utf-8", "surrogatepass")), base, f"\x00{rid}", 0)
                for word, freq in Counter(rest).items():
                    row(rid, None, None, 0, word, freq)
                if len(out["rid"]) > 20_000:
                    yield flush()
        yield flush()

    parts = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(per_document, "rid long, doc_id long, n_bytes long, base long, piece string, freq long")
    tokens = F.sum(F.col("base") + F.when(F.col("freq") > 0, F.col("freq") * F.col("n")).otherwise(0))
    found = parts.join(counted.select("piece", "n"), "piece", "left").groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
