"""Numpy over blocks of vectors: stacking Arrow lists, whole-number codes with error bounds, first k of a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of doubles; shorter vectors end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.array(lists.flatten().fill_null(0), np.float64)
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows at length 1: whole numbers of -127 to 127, the scale of each row, and an upper bound of the length of what is lost.

    With bounds e and f, the product of two rows differs from that of their codes by at most e + f + e * f.
    """
    u = units(x)
    most = np.abs(u).max(1, initial=0)
    scale = 127 / np.where(most > 0, most, 1)
    code = np.rint(u * scale[:, None])
    rest = np.linalg.norm(u - code / scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return code.astype(np.int8), scale, rest


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of codes: 1024 components at a time, whose sums stay below 2**24, in single precision."""
    kind = np.float32 if a.shape[1] <= 1024 else np.float64
    out = np.zeros((len(a), len(b)), kind)
    for j in range(0, a.shape[1], 1024):
        out += a[:, j : j + 1024].astype(np.float32) @ b[:, j : j + 1024].astype(np.float32).T
    return out


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as SQL does: halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits


def first_k(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first k columns of each row by score; `order` ranks the columns among equal scores."""
    k = min(k, scores.shape[1])
    if not k or not len(scores):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    i, j = np.nonzero(scores >= least[:, None])
    by = np.lexsort((order[j], -scores[i, j], i))
    i, j = i[by], j[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]
