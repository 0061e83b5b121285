"""Words of texts as arrays of positions and hashes, for many texts of a buffer at once.

A word is a maximal run of bytes other than the space and the five ASCII white-space controls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tickloom.llm import byte_hash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word of the texts data[ends[i]:ends[i + 1]]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = ink[cuts]
    stops = ink.copy()
    stops[:-1] &= ~ink[1:]
    cuts = cuts[cuts > 0]
    stops[cuts - 1] = ink[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(ends, start, side="right") - 1


def long_text(data: np.ndarray, limit: int, overlap: int) -> Iterator[tuple]:
    """Parts of one text of about `limit` bytes: the part, start and end of its words, the number
    of its first word. Neighbouring parts share `overlap` words."""
    at = number = 0
    size = limit
    while True:
        part = data[at:at + size]
        start, end, _ = words_of(part, np.array([0, len(part)]))
        last = at + size >= len(data)
        if not last and len(end) and end[-1] == len(part):
            start, end = start[:-1], end[:-1]
        if not last and len(start) <= overlap:     # longer words than a part holds
            size *= 2
            continue
        yield part, start, end, number
        if last:
            return
        back = len(start) - overlap
        number, at, size = number + back, at + int(start[back]), limit


class WordSpans:
    """Hashes of words start..end-1; equal words have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int,
                 tables: tuple[np.ndarray, np.ndarray]) -> None:
        """tables: byte_hash.tables of enough bytes, or of fewer, which are then made anew."""
        up, down = tables if len(tables[0]) > len(data) else byte_hash.tables(len(data))
        words = byte_hash.Intervals(data, seed, up, down)(start, end)
        self.down = down
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:len(words)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return byte_hash.mixed((self.sums[end] - self.sums[start]) * self.down[start])
