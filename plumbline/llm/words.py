"""Words of whole texts as 64-bit hashes, computed with numpy over the bytes of many texts at once.

A word is a run of bytes other than space and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``. Its hash is a polynomial in its
bytes modulo 2^64, mixed at the end, so equal words have equal hashes and different ones collide with odds of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
PLAIN, LETTERS = _GAP, np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, U(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n + n // 4, (1 << 18) + (1 << 16))
        _POWERS[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(n, b, U))]) for b in (U(_BASE), U(pow(_BASE, -1, 1 << 64)))]
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of the texts of a slice: ``hashes``; ``counts`` and ``first`` for each text; byte spans ``at``, ``to`` in ``data``.

    ``gap`` tells which bytes separate words: white space (PLAIN) or all ASCII but letters and digits (LETTERS).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, gap: np.ndarray = PLAIN):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        lo = int(offsets[0]) if n else 0
        size = int(offsets[-1]) - lo if n else 0
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[lo : lo + size] if size else np.zeros(0, np.uint8)
        self.offsets = offsets - lo if n else np.zeros(1, np.int64)
        word = ~gap[self.data]
        cut = np.zeros(size + 1, bool)
        cut[self.offsets] = True
        self.at = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]] if size else [word]) | word & cut[:-1])
        self.to = np.flatnonzero(word & np.concatenate([~word[1:], [True]] if size else [word]) | word & cut[1:]) + 1
        up, down = _powers(size + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum((_LOWER if lower else _BYTE)[self.data] * up[:size])])
        self.hashes = mix((total[self.to] - total[self.at]) * down[self.at])
        edge = np.searchsorted(self.at, self.offsets)
        self.first, self.counts = edge[:-1], np.diff(edge)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words; those that cross texts are to be left out by the caller."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        out = np.zeros(n, U)
        for j in range(k):
            out = out * _STEP + self.hashes[j : j + n]
        return mix(out)


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) of at most ``most`` bytes of text, or of one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, k
            at, total = k, 0
        total += n + 8
    if at < len(sizes):
        yield at, len(sizes)
