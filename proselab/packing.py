"""Packing of arrays and hashes of 64-bit words."""

from __future__ import annotations

import pickle

import numpy as np
import zstandard

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pack(obj) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(obj, protocol=5))


def unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(data)))


def planes(a: np.ndarray) -> tuple[str, int, bytes]:
    """An integer array as byte planes, which compress well where most values are small."""
    a = np.ascontiguousarray(a)
    return a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(p: tuple[str, int, bytes]) -> np.ndarray:
    kind, n, data = p
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lens[i]``, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts.astype(np.int64) - (ends - lens), lens) + np.arange(total)
