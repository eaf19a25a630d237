"""Distances in numpy, over blocks of vectors; the base of Arrow functions and searches.

Every kernel takes a block (n, d) and either one query (d,) or an equally long block, and
accumulates in double precision. Cosine is at least 0; two zero vectors have distance 0, one
zero vector has distance 1. Hamming and Jaccard on float32 look at the bytes of the floats.
"""

from __future__ import annotations

import numpy as np


def l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.float64) - b.astype(np.float64)
    return np.sqrt((d * d).sum(axis=-1))


def l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a.astype(np.float64) - b.astype(np.float64)).sum(axis=-1)


def ip(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -(a.astype(np.float64) * b.astype(np.float64)).sum(axis=-1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.astype(np.float64), b.astype(np.float64)
    dot, na, nb = (x * y).sum(axis=-1), (x * x).sum(axis=-1), (y * y).sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.maximum(0.0, 1.0 - dot / (np.sqrt(na) * np.sqrt(nb)))
    za, zb = na == 0, nb == 0
    return np.where(za & zb, 0.0, np.where(za | zb, 1.0, d))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8) if x.dtype != np.uint8 else x


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(_bits(a) ^ _bits(b)).sum(axis=-1, dtype=np.int64).astype(np.float64)


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = _bits(a), _bits(b)
    both = np.bitwise_count(x & y).sum(axis=-1, dtype=np.int64)
    either = np.bitwise_count(x | y).sum(axis=-1, dtype=np.int64)
    return np.where(either == 0, 1.0, 1.0 - both / np.maximum(either, 1))


KERNELS = {"l2": l2, "cosine": cosine, "ip": ip, "l1": l1, "hamming": hamming, "jaccard": jaccard}


def pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances (n, m) of all rows of ``a`` to all rows of ``b``, by matrix products where they serve."""
    if metric in ("ip", "cosine", "l2"):
        x, y = a.astype(np.float64), b.astype(np.float64)
        dot = x @ y.T
        if metric == "ip":
            return -dot
        na, nb = (x * x).sum(axis=1), (y * y).sum(axis=1)
        if metric == "l2":
            return np.sqrt(np.maximum(na[:, None] + nb[None, :] - 2 * dot, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.maximum(0.0, 1.0 - dot / np.sqrt(na[:, None] * nb[None, :]))
        za, zb = na[:, None] == 0, nb[None, :] == 0
        return np.where(za & zb, 0.0, np.where(za | zb, 1.0, d))
    kernel = KERNELS[metric]
    return np.stack([kernel(a, row) for row in b], axis=1) if len(b) else np.zeros((len(a), 0))


def store(x: np.ndarray, kind: str) -> np.ndarray:
    """Float32 rows in a storage type: as they are, clamped and rounded to int8, or one bit for each positive element."""
    if kind == "float32":
        return x.astype(np.float32)
    if kind == "int8":
        c = np.clip(x.astype(np.float32), np.float32(-128), np.float32(127))
        return np.trunc(c + np.where(c < 0, np.float32(-0.5), np.float32(0.5))).clip(-128, 127).astype(np.int8)
    return np.packbits(x > 0, axis=-1)
