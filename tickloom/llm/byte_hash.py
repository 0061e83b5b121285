"""64-bit hashes of byte intervals, for many intervals of a buffer at once."""

from __future__ import annotations

import numpy as np

ODD = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)


def letters(seed: int) -> np.ndarray:
    """A fixed random number for each byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step
        done += more
    return out


class Intervals:
    """Hashes of data[start:end]; equal bytes have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray, seed: int, up: np.ndarray, down: np.ndarray) -> None:
        self.down = down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters(seed)[data] * up[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What Intervals needs for buffers of up to n bytes."""
    return powers(n + 1, ODD), powers(n + 1, pow(ODD, -1, 1 << 64))


def grams(data: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """The hash of the `length` bytes from each position on, by doubling."""
    base, out, covered = letters(seed)[data], None, 0
    size = 1
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out = base
            else:
                n = len(base) - covered
                out = out[:n] * np.uint64(pow(ODD, size, 1 << 64)) + base[covered:covered + n]
            covered += size
        rest >>= 1
        if rest:
            n = max(len(base) - size, 0)
            base = base[:n] * np.uint64(pow(ODD, size, 1 << 64)) + base[size:size + n]
            size *= 2
    return mixed(out[:max(len(data) - length + 1, 0)])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    size = 1
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size:width - size + n])
