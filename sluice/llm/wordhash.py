"""Hashes of words and word shingles of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SECOND = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant modulo 2**64 and their inverses, from 0 to n."""
    if len(_POWERS.get("up", ())) <= n:
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 2**64))):
            steps = np.full(max(1 << 16, 1 << (n + 1).bit_length()), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(b: np.ndarray, second: bool = False) -> np.ndarray:
    """Sums from which the hash of any stretch of the bytes follows; ``second`` gives hashes that are independent of the first."""
    up, _ = powers(len(b))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((_SECOND if second else _TABLE)[b] * up[: len(b)], dtype=np.uint64)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles, A-Z lower-cased.

    A text with fewer words has one hash of its whole sequence; one without words has none.
    """
    raw = [(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = np.concatenate(([False], ~_SPACE[b]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])  # the last byte is a separator
    start, end = turn[::2], turn[1::2]
    sums, (_, down) = prefix_sums(b), powers(len(b))
    w = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    owner = np.searchsorted(start, ends)  # words before the end of each text
    n = max(len(w) - words + 1, 0)
    rolled = w[:n].copy()
    for i in range(1, words):
        rolled = mix(rolled * np.uint64(_ODD) + w[i : n + i])
    out, first = [], 0
    for last in owner.tolist():
        if last - first >= words:
            out.append(np.unique(rolled[first : last - words + 1]))
        elif last > first:
            whole = np.uint64(last - first)
            for x in w[first:last]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(_ODD) + x)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out
