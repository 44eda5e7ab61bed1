"""The same functions over Arrow batches with NumPy tables, for pipelines that are in Python anyway; bench.py compares them with the built-in forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .alphabet import CHARACTERS, CODES, COMPLEMENT_CHARACTERS, complement
from .sequence import column
from .two_bit import _DIGITS, ORDER

_CODES = np.frombuffer(CODES, np.uint8)
_TEXT = np.frombuffer(CHARACTERS.encode(), np.uint8)
_COMPLEMENT_TEXT = np.frombuffer(COMPLEMENT_CHARACTERS.encode(), np.uint8)[_CODES]
_TWO_BITS, _TWO_BIT_TEXT = np.array([int(x) for x in _DIGITS], np.uint8), np.frombuffer(ORDER.encode(), np.uint8)
_COMPLEMENT = np.array([complement(x) for x in range(16)], np.uint8)


def _values(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(bytes, n+1 offsets, null mask or None)."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    null = a.is_null().to_numpy(zero_copy_only=False) if a.null_count else None
    if null is not None:
        a = a.fill_null(b"")
    _, offsets, data = a.buffers()
    wide = pa.types.is_large_binary(a.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0], null


def _array(kind: pa.DataType, data: np.ndarray, offsets: np.ndarray, null: np.ndarray | None) -> pa.Array:
    mask = pa.array(~null).buffers()[1] if null is not None else None
    return pa.Array.from_buffers(kind, len(offsets) - 1, [mask, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _pack(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offsets)
    odd = n & 1
    out = np.concatenate(([0], np.cumsum((n + 1) // 2)))
    if odd.any():  # a 0 behind each odd row
        codes = np.insert(codes, offsets[1:][odd == 1], 0)
    return codes[0::2] << 4 | codes[1::2], out


def _unpack(packed: np.ndarray) -> np.ndarray:
    codes = np.empty(len(packed) * 2, np.uint8)
    codes[0::2], codes[1::2] = packed >> 4, packed & 15
    return codes


def _take(offsets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the unpacked codes the first n of each row are, n+1 offsets)."""
    n = np.clip(n, 0, np.diff(offsets) * 2)
    out = np.concatenate(([0], np.cumsum(n)))
    return np.arange(out[-1]) + np.repeat(offsets[:-1] * 2 - out[:-1], n), out


@F.arrow_udf(BinaryType())
def _encode(a: pa.Array) -> pa.Array:
    data, offsets, null = _values(a)
    packed, out = _pack(_CODES[data], offsets)
    return _array(pa.binary(), packed, out, null)


@F.arrow_udf(StringType())
def _decode(a: pa.Array, n: pa.Array) -> pa.Array:
    data, offsets, null = _values(a)
    if n.null_count:
        null = n.is_null().to_numpy(zero_copy_only=False) | (null if null is not None else False)
    at, out = _take(offsets, n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    return _array(pa.string(), _TEXT[_unpack(data)][at], out, null)


@F.arrow_udf(BinaryType())
def _encode2(a: pa.Array) -> pa.Array:
    data, offsets, null = _values(a)
    n = np.diff(offsets)
    out = np.concatenate(([0], np.cumsum((n + 3) // 4)))
    codes = np.zeros(4 * int(out[-1]), np.uint8)
    codes[np.arange(len(data)) + np.repeat(4 * out[:-1] - offsets[:-1], n)] = _TWO_BITS[data]
    return _array(pa.binary(), codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4], out, null)


@F.arrow_udf(StringType())
def _decode2(a: pa.Array, n: pa.Array) -> pa.Array:
    data, offsets, null = _values(a)
    if n.null_count:
        null = n.is_null().to_numpy(zero_copy_only=False) | (null if null is not None else False)
    n = np.clip(n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0, np.diff(offsets) * 4)
    out = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(out[-1]) + np.repeat(4 * offsets[:-1] - out[:-1], n)
    return _array(pa.string(), _TWO_BIT_TEXT[data[at >> 2] >> (6 - 2 * (at & 3)).astype(np.uint8) & 3], out, null)


def _backwards(offsets: np.ndarray) -> np.ndarray:
    """Places of all rows' items, each row from its end."""
    n = np.diff(offsets)
    return np.repeat(offsets[1:] + offsets[:-1] - 1, n) - np.arange(offsets[-1])


@F.arrow_udf(StringType())
def _reverse_complement(a: pa.Array) -> pa.Array:
    data, offsets, null = _values(a)
    return _array(pa.string(), _COMPLEMENT_TEXT[data][_backwards(offsets)], offsets, null)


@F.arrow_udf(BinaryType())
def _reverse_complement_packed(a: pa.Array, n: pa.Array) -> pa.Array:
    data, offsets, null = _values(a)
    n = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(offsets)
    bad = (n != 2 * size) & (n != 2 * size - 1) & (~null if null is not None else True)
    if bad.any():
        i = int(np.flatnonzero(bad)[0])
        raise ValueError(f"{n[i]} bases don't fit into {size[i]} bytes")
    at, out = _take(offsets, np.where(null, 0, n) if null is not None else n)
    codes = _COMPLEMENT[_unpack(data)][at]
    packed, out = _pack(codes[_backwards(out)], out)
    return _array(pa.binary(), packed, out, null)


def encode4_arrow(seq: Column | str) -> Column:
    return _encode(column(seq).cast("binary"))


def decode4_arrow(packed: Column | str, n_bases: Column | str) -> Column:
    return _decode(column(packed), column(n_bases).cast("int"))


def encode2_arrow(seq: Column | str) -> Column:
    return _encode2(column(seq).cast("binary"))


def decode2_arrow(packed: Column | str, n_bases: Column | str) -> Column:
    return _decode2(column(packed), column(n_bases).cast("int"))


def reverse_complement_arrow(seq: Column | str) -> Column:
    return _reverse_complement(column(seq).cast("binary"))


def reverse_complement_packed_arrow(packed: Column | str, n_bases: Column | str) -> Column:
    return _reverse_complement_packed(column(packed), column(n_bases).cast("int"))
