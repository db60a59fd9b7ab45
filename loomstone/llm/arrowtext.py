"""Arrow text as flat numpy code points and back, without a Python call a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (a null has none) and the offset of each text, with one more for the end."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    raw = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]]
    bytes_ = np.frombuffer(raw, np.uint8)
    cps = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(bytes_) + 1, np.int64)
    np.cumsum((bytes_ & 0xC0) != 0x80, out=lead[1:])
    return cps, lead[offsets - offsets[0]]


def to_strings(cps: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The Arrow strings of ``cps`` cut at ``offsets``; null where ``valid`` is false."""
    cps = np.ascontiguousarray(cps, np.uint32)
    data = cps.tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    n = len(offsets) - 1
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends[offsets].astype(np.int64).tobytes()), pa.py_buffer(data), mask)
    return out.cast(pa.string()) if ends[-1] < 2**31 - 1 else out


def single(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into parts of about ``size`` bytes of a string column; a longer value is a part of its own."""
    sizes = np.array(pc.fill_null(pc.binary_length(single(batch.column(column)).cast(pa.large_string())), 0), np.int64)
    part = np.cumsum(sizes) // size
    lo = 0
    for hi in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
        if hi > lo:
            yield batch.slice(lo, hi - lo)
        lo = hi
