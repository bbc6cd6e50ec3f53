"""Arrays of numbers as one compressed value, for rows that carry a block of work to a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

KINDS = [np.dtype(k) for k in ("u1", "u2", "u4", "u8", "i8", "f8")]


def small(x: np.ndarray) -> np.ndarray:
    """Numbers of 0 or more in as few bytes as the largest of them needs."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in KINDS[:4] if most <= np.iinfo(k).max))


def packed(*arrays: np.ndarray) -> bytes:
    """Each array byte by byte of significance, which compresses better."""
    codec = pa.Codec("zstd", 1)
    raw = bytearray([len(arrays)])
    for x in arrays:
        raw += bytes([KINDS.index(x.dtype)]) + len(x).to_bytes(8, "little")
    for x in arrays:
        raw += np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + codec.compress(bytes(raw), asbytes=True)


def unpacked(value: pa.Scalar) -> list[np.ndarray]:
    data = value.as_buffer()
    raw = np.frombuffer(pa.Codec("zstd", 1).decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little")), np.uint8)
    n, out = int(raw[0]), []
    begin = 1 + 9 * n
    for i in range(n):
        head = raw[1 + 9 * i : 10 + 9 * i]
        kind, size = KINDS[head[0]], int.from_bytes(head[1:].tobytes(), "little")
        end = begin + size * kind.itemsize
        out.append(np.ascontiguousarray(raw[begin:end].reshape(kind.itemsize, size).T).view(kind).ravel())
        begin = end
    return out


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches: numbers as Python's, the rest as Arrow's scalars."""
    for batch in batches:
        columns = [c.to_pylist() if pa.types.is_integer(c.type) else c for c in batch.columns]
        yield from zip(*columns, strict=True)


def split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each part, in their order."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts), "right")
    begin = 0
    for p, end in enumerate(ends.tolist()):
        if end > begin:
            yield p, order[begin:end]
        begin = end
