"""Vectorised word and n-gram hashes of many texts at once.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters.  Every word gets a 64-bit
hash from one cumulative sum over the bytes: sum(b[i] * R**i), brought to its start with the inverse of R modulo
2**64, then mixed.  No Python code runs for a single word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, np.uint64(_R))
        down = np.full(n, np.uint64(pow(_R, -1, 1 << 64)))
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts: ``hashes`` of all, ``first[i]:first[i+1]`` those of text i, and byte spans in it."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(texts)].astype(np.int64)
        raw = np.frombuffer(joined, np.uint8)
        n = len(raw)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = _WORD[raw]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(1 << max(10, int(n).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            words = (sums[self.end] - sums[self.start]) * down[self.start]
            self.hashes = mix(words + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, np.append(self.at, n + 1))

    def __len__(self) -> int:
        return len(self.at)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words of one word sequence; of all words together if there are fewer, none of none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for i in range(1, n):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + hashes[i : len(hashes) - n + 1 + i]
        return mix(out + np.uint64(n))
