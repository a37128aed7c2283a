"""BPE encoding by a streaming transducer with bounded lookahead, and incremental decoding.

Merges apply by rank. Whether a token boundary is final can depend on what follows it, but only
through a chain of merges of falling rank that overlap to the right. `lookahead()` computes the
longest such chain of a merge list once; a boundary further than that from the end of what has been
read can't change any more. `Bpe.stream` keeps only the unstable rest of a word, `Bpe.pieces` gives the
ids of a text word by word, and `Decoder` turns ids into text as they come, so memory besides the text
itself doesn't grow with a text or a word; words that are short are remembered.

Texts: null is empty. Special strings inside texts become their own ids, as in the library. Repeated rows
are encoded each by itself; columns besides the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import same_file

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WIDE = regex.compile("[^\\x00-\u052f]")


@functools.cache
def _words(wide: bool) -> regex.Pattern:
    """The pattern of words. For characters newer than Python's data, the tokenizers library says what is a letter or digit."""
    letters, digits = "\\p{L}", "\\p{N}"
    if wide:
        from tokenizers import Regex, pre_tokenizers

        for k in (letters, digits):
            here, there = regex.compile(k), pre_tokenizers.Split(Regex(k), "removed", invert=True)
            odd = "".join(c for c in map(chr, range(0x530, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and here.match(c) and not there.pre_tokenize_str(c))
            letters, digits = (f"[{k}--[{odd}]]" if odd and k == x else x for x in (letters, digits))
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letters}+|{digits}|[^{_SPACE}{letters}{digits}]+")


def words(text: str) -> Iterator[str]:
    return (m.group() for m in _words(not text.isascii() and _WIDE.search(text) is not None).finditer(text))


def byte_marks() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (public convention)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    marks, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            marks[b] = chr(b)
        else:
            marks[b], extra = chr(extra), extra + 1
    return marks


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Characters (of the vocabulary's alphabet) after which a boundary can't change.

    hops[v]: the longest chain of overlapping merges that can decide, from the right, how v is formed.
    A merge (u, v) is reached by chains through v; a merge that starts with a token on the right spine
    of v, and comes before the one that consumes it, can keep v from being formed.
    """
    from_left: dict[str, int] = {}  # longest chain so far that starts with a merge of this left token
    hops: dict[str, int] = {}
    longest, width = 1, 1
    for left, right in merges:
        reach = max(hops.get(right, 0), from_left.get(right, 0))
        joined = left + right
        hops[joined] = max(hops.get(joined, 0), reach)
        from_left[left] = max(from_left.get(left, 0), reach + 1)
        longest, width = max(longest, reach + 1), max(width, len(joined))
    return (longest + 1) * width


class Bpe:
    """A merge list with word ends, its specials, and the transducer over it."""

    def __init__(self, path: str, block: int = 4096, remembered: int = 200_000, longest: int = 256):
        spec = json.load(open(same_file(path), encoding="utf-8"))
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.ahead = lookahead(merges)
        self.block, self.longest, self.limit = block, longest, remembered
        self.marks = byte_marks()
        self.memo: dict[str, bytes] = {}
        byte_of = {m: bytes([i]) for i, m in enumerate(self.marks)}
        special = set(self.specials.values())
        self.plain_bytes = {i: t.encode("utf-8") for i, t in self.surface.items()}
        self.readable_bytes = {i: self.plain_bytes[i] if i in special or not all(c in byte_of for c in t.removesuffix(self.end)) else b"".join(byte_of[c] for c in t.removesuffix(self.end)) + b" " * (bool(self.end) and t.endswith(self.end)) for i, t in self.surface.items()}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges in order of rank, leftmost first, over a linked list with a heap."""
        n, ranks = len(symbols), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s, keep in zip(symbols, alive, strict=True) if keep]

    def stream(self, pieces: Iterator[str]) -> Iterator[str]:
        """Tokens of one word that comes in pieces, each as soon as it is stable."""
        held: list[str] = []
        marks = self.marks
        for piece in pieces:
            held += [marks[b] for b in piece.encode("utf-8")]
            if len(held) >= self.ahead + self.block:
                tokens, done = self.merged(list(held)), 0
                for token in tokens:
                    if done + len(token) > len(held) - self.ahead:
                        break
                    done += len(token)
                    yield token
                held = held[done:]
        if held:
            held[-1] += self.end
            yield from self.merged(held)

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers."""
        if (found := self.memo.get(word)) is not None:
            return found
        tokens = self.stream(word[i : i + self.block] for i in range(0, len(word), self.block))
        found = array("I", [self.ids[t] for t in tokens]).tobytes()
        if len(word) <= self.longest:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[word] = found
        return found

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of a text, one special string or word after the other."""
        parts = self.split_specials.split(text) if self.split_specials and "<" in text else [text]
        for part in parts:
            if part in self.specials:
                yield array("I", [self.specials[part]]).tobytes()
            elif part:
                yield from map(self.word, words(normalized(part)))

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def decode(self, ids: bytes) -> str:
        decoder = Decoder(self)
        return decoder.feed(ids) + decoder.end()

    def text(self, ids: bytes) -> str:
        """Readable text."""
        decoder = Decoder(self, readable=True)
        return decoder.feed(ids) + decoder.end()


class Decoder:
    """Ids to text as they come: a machine over the tokens' bytes that holds back an unfinished character.

    Plain: as the library does without a decoder, the tokens' own strings with a space between them.
    readable: the bytes that a byte-level vocabulary stands for, with a space after word ends.
    """

    def __init__(self, bpe: Bpe, readable: bool = False):
        self.bytes_of = bpe.readable_bytes if readable else bpe.plain_bytes
        self.between = b"" if readable else b" "
        self.begun = False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        raw = self.between.join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        if raw and self.begun:
            raw = self.between + raw
        self.begun = self.begun or bool(raw)
        return self.machine.decode(raw)

    def end(self) -> str:
        return self.machine.decode(b"", True)


def normalized(text: str) -> str:
    """NFC and lower case, character by character (no rule for a final sigma)."""
    if text.isascii():
        return text.lower()
    if _WIDE.search(text):  # newer characters than Python's data has
        from tokenizers import normalizers

        return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit), decoded string for each row."""

    def whole(bpe: Bpe, text: str) -> tuple:
        ids = bpe.encode(text)
        return ids, bpe.decode(ids)

    return _over(docs, path, id_col, text_col, whole, {"ids": pa.binary(), "decoded": pa.string()})


def digests(bpe: Bpe, text: str, chunk: int = 4096) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the decoded text; ids are hashed and decoded as they come."""
    n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(bpe)
    for pieces in itertools.batched(bpe.pieces(text), chunk):
        ids = b"".join(pieces)
        n += len(ids) // 4
        of_ids.update(ids)
        of_text.update(decoder.feed(ids).encode())
    of_text.update(decoder.end().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; ids and decoded texts are never held whole."""
    return _over(docs, path, id_col, text_col, digests, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})


def _over(docs: DataFrame, path: str, id_col: str, text_col: str, of, kinds: dict[str, pa.DataType]) -> DataFrame:
    """doc_id and the columns of `of(bpe, text)` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [of(bpe, text.as_py() or "") for text in part.column(1)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *kinds])

    ddl = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} {ddl[kind]}" for name, kind in kinds.items()))
