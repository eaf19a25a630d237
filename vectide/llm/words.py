"""Words and shingles shared by the text operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


class Hasher:
    """64-bit word hashes with a bounded cache."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most, self.cache = most, {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        try:
            return np.array([cache[w] for w in ws], dtype=np.uint64)
        except KeyError:
            for w in ws:
                if w not in cache:
                    cache[w] = xxhash.xxh64_intdigest(w)
            return np.array([cache[w] for w in ws], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def shingles(ws: list[str], size: int, hasher: Hasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; empty for shorter texts."""
    if len(ws) < size:
        return np.zeros(0, np.uint64)
    w = hasher(ws)
    with np.errstate(over="ignore"):
        h = w[: len(w) - size + 1].copy()
        for k in range(1, size):
            h = mix(h * _MIX + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def shingle_sets(texts: list[list[str]], size: int, hasher: Hasher) -> list[np.ndarray]:
    """``shingles`` of many texts, hashed in one go."""
    if not texts:
        return []
    flat = hasher([w for ws in texts for w in ws])
    n = len(flat) - size + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * len(texts)
    with np.errstate(over="ignore"):
        h = flat[:n].copy()
        for k in range(1, size):
            h = mix(h * _MIX + flat[k : n + k])
    out, at = [], 0
    for ws in texts:
        own = np.sort(h[at : at + max(0, len(ws) - size + 1)])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        at += len(ws)
    return out
