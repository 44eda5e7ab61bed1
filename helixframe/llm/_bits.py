"""Bit streams in NumPy: packing of variable-length codes, and gathering of windows."""

from __future__ import annotations

import numpy as np


def pack(codes: np.ndarray, lengths: np.ndarray, at: np.ndarray, n_bytes: int) -> np.ndarray:
    """Big-endian bytes with ``codes`` (of up to 32 bits) written at the rising, non-overlapping bit places ``at``; other bits 0."""
    words = np.zeros(n_bytes // 4 + 3, np.uint64)
    if len(codes):
        word = at >> 5
        value = codes.astype(np.uint64) << (64 - lengths.astype(np.int64) - (at & 31)).astype(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        both = np.add.reduceat(value, new)
        words[word[new]] += both >> np.uint64(32)
        words[word[new] + 1] += both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").view(np.uint8)[:n_bytes]


def windows(data: np.ndarray) -> np.ndarray:
    """For each byte place (and 4 beyond) the 32 bits that begin there."""
    d = np.zeros(len(data) + 8, np.uint32)
    d[: len(data)] = data
    return (d[:-3] << np.uint32(24)) | (d[1:-2] << np.uint32(16)) | (d[2:-1] << np.uint32(8)) | d[3:]
