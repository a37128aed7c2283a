"""Vectorised work on blocks of texts: many texts as one byte array, hashes of any spans by prefix sums.

A span's hash is a polynomial in an odd base over random byte codes, modulo 2**64, with a finaliser;
spans of equal bytes have equal hashes wherever they stand.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, inverse))


class Block:
    """Texts as bytes, one gap byte after each."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        n = len(self.bytes)
        self.up, self.down = _powers(1 << max(16, int(n).bit_length()))
        self._add_up(_CODES[self.bytes])

    def _add_up(self, codes: np.ndarray) -> None:
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def __len__(self) -> int:
        return len(self.sums) - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 byte of each word (runs without ASCII white space)."""
        gap = _GAP[self.bytes]
        before = np.concatenate([[True], gap[:-1]])
        return np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)  # the gap byte after each text ends its last word

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word, and each text's first and last + 1 word."""
        starts, ends = self.word_spans()
        return self.hashes(starts, ends), np.searchsorted(starts, self.starts), np.searchsorted(starts, self.ends)

    def leading(self, starts: np.ndarray, n: int) -> list[np.ndarray]:
        """The first bytes from each place, eight a column, as n columns of integers of the same order."""
        raw = self.bytes[starts[:, None] + np.arange(8 * n)].view(">u8").astype(np.uint64)
        return list(np.ascontiguousarray((raw ^ np.uint64(1 << 63)).view(np.int64).T))

    def in_bytes(self, text: int, spans: np.ndarray) -> np.ndarray:
        """Spans of a text's bytes for spans of it."""
        return spans


class WordBlock(Block):
    """Texts as words: places, spans and hashes are of words, whatever white space is between them."""

    def __init__(self, texts: list[bytes]):
        raw = Block(texts)
        self.raw_starts = raw.starts
        self.word_starts, self.word_ends = raw.word_spans()
        self.codes, self.starts, self.ends = raw.words()
        self.up, self.down = raw.up, raw.down
        self._add_up(self.codes)

    def leading(self, starts: np.ndarray, n: int) -> list[np.ndarray]:
        """The hashes of the first n words from each place."""
        return list(np.ascontiguousarray(self.codes[starts[:, None] + np.arange(n)].view(np.int64).T))

    def in_bytes(self, text: int, spans: np.ndarray) -> np.ndarray:
        first, last = self.starts[text] + spans[:, 0], self.starts[text] + spans[:, 1] - 1
        return np.stack([self.word_starts[first], self.word_ends[last]], 1) - self.raw_starts[text]


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; the whole sequence where there are fewer words."""
    block = Block(texts)
    words, first, last = block.words()
    n = len(words) - width + 1
    joined = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            joined = joined * _BASE + words[i : i + max(n, 0)]
    joined = mix(joined)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            part = np.sort(joined[a : b - width + 1])
            keep = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            out.append(part[keep])
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(np.atleast_1d(whole) * _BASE + w)
            out.append(np.atleast_1d(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
