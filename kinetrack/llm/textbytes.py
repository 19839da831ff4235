"""Whole texts as NumPy byte buffers, a bounded slice of rows at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task holds as NumPy arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19


#: Fixed values of glibc's mallopt: the options, and the bytes from which a block is mapped (and so given back when freed).
_TRIM, _MAP, _FROM = -1, -3, 1 << 20


def lean() -> None:
    """For tasks: what NumPy and Arrow free goes back to the system at once.

    Spark keeps idle Python workers, and what these retain counts against the executor: Arrow's own pool
    holds freed batches, and glibc raises the size from which it maps blocks with each one freed, so that
    arrays of megabytes come to lie (and stay) in its heap.  Elsewhere than on glibc only the pool is set.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(_MAP, _FROM)
            libc.mallopt(_TRIM, _FROM)
        except (OSError, AttributeError):
            pass


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(raw: bytes) -> bytes:
    """Lower-case A-Z and nothing else."""
    return raw.translate(_LOWER)


def utf8_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offsets from 0, bytes) for runs of rows of about ``most`` bytes."""
    at, raw = utf8_columns(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, at[lo : hi + 1] - at[lo], raw[at[lo] : at[hi]]
        lo = hi
