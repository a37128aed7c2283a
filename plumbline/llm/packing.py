"""Packing into training sequences: bounded-space online best fit.

Each task keeps `open_windows` windows open. A document's tokens (with the end id) give full windows
while they are long enough; the rest goes whole into the window where it leaves the least room. If it
fits nowhere and no further window may be opened, the fullest window is emitted. What is still open at
the end of a task is merged across tasks, `MERGED_TASKS` tasks together, by best fit decreasing over
window sizes alone (at most MERGED_TASKS * open_windows rows a group, whatever the input).

Of windows with equal room the one that was opened last is taken, and so it is among equally full ones.
Null or empty texts are a document of the end id alone. Repeated rows are packed each by itself. Other
columns are ignored; an empty table gives no rows. Texts of over LONG_TEXT characters get the same ids
from the slower of two libraries, whose stack they don't overflow.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe_stream import byte_marks
from plumbline.llm.common import same_file, staged

MERGED_TASKS = 64
LONG_TEXT = 200_000
# Fixed value: the public pattern by which byte-level tokenizers split text before their merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevelIds:
    """Ids of a byte-level vocabulary file; the rank of a token is its id, so the faster library gives the same."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path = path = same_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {m: i for i, m in enumerate(byte_marks())}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.fast = tiktoken.Encoding("ids", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:  # very long runs overflow the faster library's stack
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        if "<|" not in text:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.specials[part]] if part in self.specials else self.fast.encode_ordinary(part)
        return np.array(ids, "<u4")


class Windows:
    """A fixed number of open windows, ordered by use; best fit by bisection."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.next = capacity, most, 0
        self.open: list[tuple[int, int]] = []  # (used, window), ascending
        self.held: dict[int, list[tuple]] = {}

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int, piece: tuple) -> list[tuple[int, int, list[tuple]]]:
        """Places a piece; returns the windows that are emitted for it: (window, used, pieces)."""
        out = []
        at = bisect.bisect_right(self.open, (self.capacity - length, 1 << 62)) - 1
        if at >= 0:
            used, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                full, gone = self.open.pop()
                out.append((gone, full, self.held.pop(gone)))
            used, window = 0, self.new()
            self.held[window] = []
        self.held[window].append((*piece, used))
        if used + length == self.capacity:
            out.append((window, self.capacity, self.held.pop(window)))
        else:
            bisect.insort(self.open, (used + length, window))
        return out


def merge_windows(used: list[int], capacity: int) -> list[tuple[int, int]]:
    """Best fit decreasing over windows; for each its (first window of its sequence, shift)."""
    at: list[tuple[int, int]] = [(0, 0)] * len(used)
    open_: list[tuple[int, int]] = []
    for i in sorted(range(len(used)), key=lambda i: -used[i]):
        k = bisect.bisect_right(open_, (capacity - used[i], 1 << 62)) - 1
        filled, head = open_.pop(k) if k >= 0 else (0, i)
        at[i] = (head, filled)
        bisect.insort(open_, (filled + used[i], head))
    return at


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, open_windows: int = 128, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (and ids)."""
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary(), "offset": pa.int64(), "window": pa.int64(), "used": pa.int64(), "task": pa.int64(), "left": pa.bool_()}
    names = list(kinds)
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, offset long, window long, used long, task long, left boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, windows, task = ByteLevelIds(path), Windows(capacity, open_windows), TaskContext.get().partitionId()
        rows: list[tuple] = []

        def emit(emitted, left=False):
            rows.extend((*piece, window, used, task, left) for window, used, pieces in emitted for piece in pieces)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, ids = doc_id.as_py(), np.append(ids_of.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    raw = ids[start : start + capacity].tobytes()
                    piece = (doc_id, start, len(raw) // 4, zlib.crc32(raw), len(ids), raw if with_ids else None)
                    if len(raw) == 4 * capacity:
                        emit([(windows.new(), capacity, [(*piece, 0)])])
                    else:
                        emit(windows.place(len(raw) // 4, piece))
                if len(rows) >= (500 if with_ids else 10_000):
                    yield flush()
        emit(((window, used, windows.held[window]) for used, window in windows.open), True)
        if rows:
            yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["task", "window"]).reset_index(drop=True)
        at = merge_windows(group["used"].tolist(), capacity)
        heads = [h for h, _ in at]
        total = group["used"].groupby(heads).sum()
        return group.assign(to_task=group["task"].to_numpy()[heads], to_window=group["window"].to_numpy()[heads], shift=[s for _, s in at], total=total.loc[heads].to_numpy())[["task", "window", "to_task", "to_window", "shift", "total"]]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(rows.mapInArrow(run, ddl), "packed")
    left = pieces.filter("left").groupBy("task", "window").agg(F.first("used").alias("used"))
    moved = left.groupBy(F.expr(f"task div {MERGED_TASKS}")).applyInPandas(merge, "task long, window long, to_task long, to_window long, shift long, total long")
    out = pieces.filter("not left").withColumns({"to_task": F.col("task"), "to_window": F.col("window"), "shift": F.lit(0).cast("long"), "total": F.col("used")})
    out = out.unionByName(pieces.filter("left").join(moved, ["task", "window"]))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft("to_task", 32) + F.col("to_window")).alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")]
    padded = F.when(F.expr("total & (total - 1)") == 0, F.col("total")).otherwise(F.lit(capacity).cast("long")).alias("padded")
    return out.select(*columns, padded, *(["ids"] if with_ids else []))
