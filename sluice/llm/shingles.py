"""Word-shingle sets and circulant MinHash signatures in numpy, for tasks of the near-duplicate operator."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import U64, mix64, model

#: A-Z to a-z and nothing else, on UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Positions of the circulant permutation; shingles hash onto them before the exact check.
BITS = 21
MEMO, LONG = 150_000, 64


class WordHash(dict):
    """Word to 64-bit hash; cleared when full and without long words, so that a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words.

    Words are runs of characters other than x20 and x09 to x0D, A-Z lower-cased. A text with fewer
    words is one shingle; without words (or null) the set is empty.
    """
    if not text:
        return np.empty(0, U64)
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(model("words", 0, WordHash).__getitem__, words), U64, n)
    k = min(size, n)
    s = mix64(h[: n - k + 1] + U64(k))
    for i in range(1, k):
        s = mix64(s * U64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return np.unique(s)


def _circulant(k: int, seed: int) -> np.ndarray:
    """Row i is the permutation's run of ``k`` values from position i on, with wrap-around: one table serves all shifts."""
    perm = np.random.default_rng(seed).permutation(1 << BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([perm, perm[:k]]), k)


def signature(s: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Circulant MinHash: a first permutation scatters the set, a second one, shifted by 1 to k, gives the k minima."""
    rows = model("circulant", (k, seed), lambda: _circulant(k, seed))
    at = (mix64(s + U64(seed)) >> U64(64 - BITS)).astype(np.int64)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 1024):
        np.minimum(out, rows[at[i : i + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of consecutive coordinates."""
    m = sig.reshape(bands, -1).astype(U64)
    key = mix64(np.arange(1, bands + 1, dtype=U64))
    for j in range(m.shape[1]):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + m[:, j])
    return key.view(np.int64)
