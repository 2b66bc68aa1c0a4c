"""Rolling 64-bit hashes of words and word runs, as numpy arrays over one document."""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse, modulo 2 ** 64."""
    up, down = _TABLES.get(base, (np.empty(0, "u8"),) * 2)
    if len(up) < n:
        n = max(n, 2 * len(up), 1 << 14)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(n, base, "u8"), np.full(n, inverse, "u8")
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        _TABLES[base] = up, down
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One hash for each word; equal words have equal hashes in every process."""
    if not words:
        return np.empty(0, "u8")
    text = np.frombuffer(b" ".join(words) + b" ", "u1")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    up, down = _powers(_BASES[0], len(text))
    total = np.empty(len(text) + 1, "u8")
    total[0] = 0
    np.cumsum((text.astype("u8") + np.uint64(1)) * up[: len(text)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype("u8"))


def run_hashes(hashes: np.ndarray, length: int, base: int = 1) -> np.ndarray:
    """One hash for each run of ``length`` neighbours; ``base`` chooses one of the hash functions."""
    n = len(hashes)
    if n < length:
        return np.empty(0, "u8")
    up, down = _powers(_BASES[base], n)
    total = np.empty(n + 1, "u8")
    total[0] = 0
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[length:] - total[:-length]) * down[: n - length + 1] + np.uint64(length))


def sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """The least value of each run of ``length`` neighbours."""
    reach = 1
    while 2 * reach <= length:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = length - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values
