"""Columns of numbers as compressed bytes: one row of a shuffle for many small records.

Shuffling a record a row costs far more than its few bytes; records of one task and one
target travel as one row instead, and the target splits them again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """All columns have one length; the types are agreed on between pack and unpack.

    Bytes of one significance lie together, so that the high ones of small numbers vanish.
    """
    turned = (np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(turned))


def unpack(data: bytes, n: int, *types) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for t in types:
        width = np.dtype(t).itemsize
        turned = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(turned.T).view(t).reshape(n))
        at += n * width
    return out


def gather(table: pa.Table, *types, blob: str = "blob", n: str = "n") -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all rows of ``table`` one after another, and the row that each entry came from."""
    sizes = table.column(n).to_numpy().astype(np.int64)
    parts = [unpack(b.as_py(), int(k), *types) for b, k in zip(table.column(blob), sizes, strict=True)]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]
    return columns, np.repeat(np.arange(len(sizes)), sizes)
