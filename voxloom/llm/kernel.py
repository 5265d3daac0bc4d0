"""Numpy kernels over Arrow string batches: words, rolling hashes, distinct sets.

A batch of texts is seen as one byte array plus offsets.  Words are found with byte masks and
hashed with prefix sums of a polynomial over bytes, so there is no Python loop per word.  All
separators and the case folding are ASCII, which UTF-8 never uses inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
_MUL = pow(3, 41, 1 << 64) | 1
_INV = pow(_MUL, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POW = np.ones(1, U)
_IPOW = np.ones(1, U)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW = np.full(size, _MUL, U)
        _IPOW = np.full(size, _INV, U)
        _POW[0] = _IPOW[0] = 1
        _POW, _IPOW = np.cumprod(_POW, dtype=U), np.cumprod(_IPOW, dtype=U)
    return _POW, _IPOW


class Texts:
    """Bytes and per-text offsets of a slice of an Arrow string column; a null is an empty text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.offsets)

    def prefix_hash(self) -> np.ndarray:
        pw, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U)
        np.cumsum(_BYTE[self.data] * pw[: len(self.data)], out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of data[start:end] for arrays of starts and ends."""
        _, inv = _powers(len(self.data) + 1)
        return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * _GOLD)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the words, in order."""
        n = len(self.data)
        solid = np.ones(n + 2, bool)
        solid[0] = solid[-1] = False
        solid[1:-1] = ~SEPARATOR[self.data]
        starts_here = solid[1:-1] & ~solid[:-2]
        ends_here = solid[1:-1] & ~solid[2:]
        cut = self.offsets[1:-1]
        first = cut[cut < n]
        starts_here[first] |= solid[1:-1][first]
        last = cut[cut > 0] - 1
        ends_here[last] |= solid[1:-1][last]
        start = np.flatnonzero(starts_here)
        end = np.flatnonzero(ends_here) + 1
        return start, end, np.searchsorted(self.offsets, start, "right") - 1


def texts_of(column) -> Texts:
    """Texts of an Arrow string array (nulls become empty texts)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch, column: str, limit: int = 1 << 21) -> Iterator:
    """Pieces of a record batch whose texts hold about ``limit`` bytes (one text at least)."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def rows_of(owner: np.ndarray, n: int) -> np.ndarray:
    """Where the items of each of n texts begin in an array sorted by text number (n + 1 bounds)."""
    return np.searchsorted(owner, np.arange(n + 1))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` following word hashes (across texts: the caller cuts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n].copy()
    for k in range(1, width):
        out = mix(out * U(0xD6E8FEB86659FD93) + words[k : k + n] + U(k))
    return out


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingle hashes of each lower-cased text: hashes, n + 1 bounds.

    A text with fewer words (but one at least) has its whole word sequence as its only shingle.
    """
    low = texts.lowered()
    start, end, owner = low.words()
    hashes = low.span_hash(low.prefix_hash(), start, end)
    bounds = rows_of(owner, len(texts))
    count = np.diff(bounds)
    joined = window_hashes(hashes, width)
    inside = owner[: len(joined)] == owner[width - 1 : width - 1 + len(joined)]
    hashed, of = joined[inside], owner[: len(joined)][inside]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.array([_whole(hashes[bounds[i] : bounds[i + 1]]) for i in short], U)
        hashed, of = np.concatenate([hashed, extra]), np.concatenate([of, short])
    order = np.lexsort((hashed, of)) if len(short) else _grouped_order(hashed, of, len(texts))
    hashed, of = hashed[order], of[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])
    return hashed[new], rows_of(of[new], len(texts))


def _whole(words: np.ndarray) -> int:
    out = np.full(1, len(words), U)
    for k in range(len(words)):
        out = mix(out * U(0xA24BAED4963EE407) + words[k : k + 1])
    return out[0]


def _grouped_order(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Order by owner, then value, of values already grouped by owner."""
    bounds = rows_of(owner, n)
    out = np.empty(len(values), np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b > a:
            out[a:b] = np.argsort(values[a:b]) + a
    return out
