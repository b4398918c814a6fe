"""Words, word hashes and windows of many texts at once, in numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: One random value a byte; A to Z share those of a to z in the second table.
_BYTE = mix(np.arange(1, 257, dtype=U) * U(_ROOT))
_BYTE_FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.roll(_BYTE, -32), _BYTE)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    out = np.ones(n, U)
    if n > 1:
        out[1:] = U(base)
        np.multiply.accumulate(out, out=out)
    return out


_held: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _held or len(_held[base]) < n:
        _held[base] = powers(base, max(n, BLOCK_BYTES + 1))
        if n > 4 * BLOCK_BYTES:  # not worth keeping
            return _held.pop(base)[:n]
    return _held[base][:n]


@dataclass
class Words:
    """Words of consecutive texts: their hashes and byte places; the first word and the first byte of each text (n + 1 entries)."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(data: np.ndarray, bounds: np.ndarray, fold: bool = False) -> Words:
    """Words of the texts data[bounds[i]:bounds[i + 1]] (uint8); fold: A-Z count as a-z."""
    apart = _SEPARATOR[data]
    edge = np.ones(len(data) + 1, bool)  # before which byte a word may begin
    edge[1:-1] = apart[:-1]
    edge[bounds] = True
    begin = np.flatnonzero(edge[:-1] & ~apart)
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = apart
    stop[bounds] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, begin, side="right")] if len(begin) else begin
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[data] * _powers(_ROOT, len(data)), out=total[1:])
    hashes = mix((total[end] - total[begin]) * _powers(_INVERSE, len(data) + 1)[begin] + (end - begin).astype(U))
    return Words(hashes, begin, end, np.searchsorted(begin, bounds), data, bounds)


def byte_blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of its first text, bytes, bounds of texts in them) for runs of texts of about ``size`` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_dictionary(texts.type) or texts.type not in (pa.large_string(), pa.large_binary()):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def blocks(texts: pa.Array, fold: bool = False, size: int = BLOCK_BYTES) -> Iterator[tuple[int, Words]]:
    """(index of its first text, words) for runs of texts of about ``size`` bytes; nulls have no words."""
    for at, data, bounds in byte_blocks(texts, size):
        yield at, split(data, bounds, fold)


def rolling(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q bytes in a row."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _powers(_ROOT, len(data)), out=total[1:])
    return mix((total[q:] - total[:-q]) * _powers(_INVERSE, len(data) - q + 1))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one text, and the place of the first of them."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n + 1, U)
    np.cumsum(words.hashes * _powers(_ROOT, n), out=total[1:])
    hashes = (total[k:] - total[:-k]) * _powers(_INVERSE, n - k + 1)
    at = window_starts(words.first, k)
    return mix(hashes[at]), at


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Places at which k consecutive words of one text begin."""
    inside = np.ones(max(0, int(first[-1]) - k + 1), bool)
    for j in range(1, k):  # a window that would cross into the next text
        cross = first[1:-1] - j
        inside[cross[(cross >= 0) & (cross < len(inside))]] = False
    return np.flatnonzero(inside)


def text_of(words: Words) -> np.ndarray:
    """Which text each word belongs to."""
    return np.repeat(np.arange(words.texts), words.counts())
