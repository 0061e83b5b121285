"""Runs: stretches of words that repeat with a period, at least `least` words and three periods long.

The longest common extension (LCE) of two places, how many words from them on are the same, tells
how far a period reaches. It is answered from a difference cover: the places whose number modulo
`MODULUS` is in `COVER`. For any two places some shift below MODULUS brings both into the cover.

* Only suffixes that start at covered places are sorted, by names of their first MODULUS words, then
  by doubling within one residue, which stays in the cover.
* An LCE compares at most MODULUS words until both places are covered; the rest is the least common
  prefix between their ranks, a range minimum from a sparse table.
* Enumeration goes over the harmonic grid: for each period p the places 0, p, 2p, ... A run of three
  periods holds three neighbouring places of the grid of its period, so their words are equal;
  such places are extended by LCE to both sides. All periods together have n ln n places.

Texts of a batch are joined with a separator of their own each, so no extension leaves a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import forget

LEAST, TIMES = 24, 3
MODULUS, COVER = 13, (0, 1, 3, 9)     # every difference modulo 13 is one of two cover elements
BATCH, ASKED = 1 << 18, 1 << 20       # words handled together (a longer text alone), places asked
ADDED = [("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()),
         ("period", T.LongType()), ("exponent_milli", T.LongType()),
         ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())]


def ranks_of(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of non-negative numbers, in their order."""
    high, *rest = keys
    for low in rest:
        _, high = np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True)
    return high


class Extensions:
    """LCE of places in `words`, an array of small numbers that ends in a word of its own."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, n = words, len(words)
        shift = np.full((MODULUS, MODULUS), -1)      # what brings two residues into the cover
        for i in range(MODULUS):
            for j in range(MODULUS):
                shift[i, j] = next(s for s in range(MODULUS)
                                   if (i + s) % MODULUS in COVER and (j + s) % MODULUS in COVER)
        self.shift = shift
        place = np.arange(n)
        covered = np.isin(place % MODULUS, COVER)
        sample = place[covered]
        self.number = np.cumsum(covered) - 1          # of a covered place among them
        padded = np.concatenate([words.astype(np.int64) + 1, np.zeros(MODULUS, np.int64)])
        two = ranks_of(padded[:-1], padded[1:])
        four = ranks_of(two[:-2], two[2:])
        eight = ranks_of(four[:-4], four[4:])
        names = ranks_of(eight[sample], eight[np.minimum(sample + MODULUS - 8, len(eight) - 1)])
        # doubling: levels[k] ranks the first MODULUS * 2^k words; past the end comes 0
        levels, step = [names], MODULUS
        while step < n and levels[-1].max(initial=0) + 1 < len(sample):
            later = sample + step
            inside = later < n
            follow = np.zeros(len(sample), np.int64)
            follow[inside] = levels[-1][self.number[later[inside]]] + 1
            levels.append(ranks_of(levels[-1], follow))
            step *= 2
        rank = levels[-1]
        order = np.empty(len(sample), np.int64)
        order[rank] = np.arange(len(sample))
        self.rank = rank
        self.table = [self.neighbours(sample[order], levels)]
        width = 1
        while 2 * width < len(sample):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def neighbours(self, place: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each place with the next one."""
        left, right = place[:-1].copy(), place[1:].copy()
        common = np.zeros(len(left), np.int64)
        n = len(self.words)
        for k in range(len(levels) - 1, -1, -1):
            step = MODULUS << k
            ask = np.flatnonzero((left + common < n) & (right + common < n))
            a, b = (levels[k][self.number[side[ask] + common[ask]]] for side in (left, right))
            same = ask[a == b]
            # names reach past the end only where the words differ anyway: the last is unique
            common[same] += step
        return common + self.walked(left + common, right + common, MODULUS)

    def walked(self, left: np.ndarray, right: np.ndarray, most: int | np.ndarray) -> np.ndarray:
        """How many words agree from two places on, at most `most`."""
        most = np.broadcast_to(most, left.shape)
        found = np.zeros(len(left), np.int64)
        going, n = np.arange(len(left)), len(self.words)
        for step in range(MODULUS):
            a, b = left[going] + step, right[going] + step
            same = (step < most[going]) & (a < n) & (b < n)
            same &= self.words[np.minimum(a, n - 1)] == self.words[np.minimum(b, n - 1)]
            going = going[same]
            if not len(going):
                break
            found[going] += 1
        return found

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shift = self.shift[left % MODULUS, right % MODULUS]
        out = self.walked(left, right, shift)
        n = len(self.words)
        go = np.flatnonzero((out == shift) & (left + out < n) & (right + out < n))
        a = self.rank[self.number[left[go] + shift[go]]]
        b = self.rank[self.number[right[go] + shift[go]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(np.maximum(high - low, 1).astype(np.float64))[1] - 1
        least = np.empty(len(go), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            least[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        out[go] += least
        return out


def grid(words: np.ndarray, longest: int, least: int = LEAST) -> Iterator[tuple]:
    """Places i of the grid of each period p up to a third of `longest` where the words at i, i + p
    and i + 2p are the same, and the next words at i and i + p too, in groups of bounded size."""
    places, periods, held = [], [], 0
    for p in range(1, longest // TIMES + 1):
        line = words[::p]
        same = line[1:] == line[:-1]
        found = np.flatnonzero(same[1:] & same[:-1]) * p
        if len(found):
            found = found[words[found + 1] == words[found + p + 1]]
        if len(found):
            places.append(found)
            periods.append(np.full(len(found), p))
            held += len(found)
        if held >= ASKED:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(words: np.ndarray, longest: int, least: int = LEAST) -> tuple:
    """Start, length and smallest period of all runs in texts of up to `longest` words, joined with
    a separator of its own after each."""
    forth = back = None
    found = []
    n = len(words)
    for place, period in grid(words, longest):
        if forth is None:
            forth, back = Extensions(words), Extensions(words[::-1].copy())
        end = place + period + forth(place, place + period)
        # places before, read backwards
        start = place - np.where(place > 0, back(np.maximum(n - place, 0) % n,
                                                 (n - place - period) % n), 0)
        good = end - start >= np.maximum(least, TIMES * period)
        # one row a run: its least period, whichever place found it
        start, length, period = start[good], (end - start)[good], period[good]
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        found.append([start[new], length[new], period[new]])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _answer(words: list[bytes], start: np.ndarray, length: np.ndarray,
            period: np.ndarray) -> tuple:
    """The row of one text."""
    lines = b"".join(b"%d,%d,%d\n" % row for row in zip(
        start.tolist(), length.tolist(), period.tolist()))
    best = (None,) * 4
    if len(start):
        share = length / period
        close = np.flatnonzero(share >= share.max() * (1 - 1e-9))
        k = min(close.tolist(), key=lambda k: (-Fraction(int(length[k]), int(period[k])),
                                               start[k], period[k]))
        best = (int(start[k]), int(length[k]), int(period[k]),
                1000 * int(length[k]) // int(period[k]))
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, start + length, -1)
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return (len(start), *best, hashlib.sha256(lines).hexdigest(),
            hashlib.sha256(b" ".join(words)).hexdigest())


def answers(texts: list[list[bytes]], least: int = LEAST) -> list[tuple]:
    """The rows of texts given as words. Texts of like length are handled together."""
    out: list = [None] * len(texts)
    nothing = np.zeros(0, np.int64)
    order = sorted(range(len(texts)), key=lambda t: len(texts[t]))
    at = 0
    while at < len(order):
        if len(texts[order[at]]) < least:
            out[order[at]] = _answer(texts[order[at]], nothing, nothing, nothing)
            at += 1
            continue
        size, members = 0, []
        shortest = len(texts[order[at]])
        while at < len(order) and (not members or (
                size + len(texts[order[at]]) <= BATCH and len(texts[order[at]]) <= 2 * shortest)):
            members.append(order[at])
            size += len(texts[order[at]]) + 1
            at += 1
        ids: dict[bytes, int] = {}
        numbers: list[int] = []
        begin = []
        for m in members:
            begin.append(len(numbers))
            numbers.extend([ids.setdefault(w, len(ids)) for w in texts[m]])
            numbers.append(-1)
        words = np.array(numbers, np.int64)
        ends = np.flatnonzero(words < 0)
        words[ends] = len(ids) + np.arange(len(ends))
        start, length, period = runs_of(words, len(texts[members[-1]]), least)
        begin = np.array(begin)
        cut = np.searchsorted(start, np.append(begin, len(words)))
        for k, m in enumerate(members):
            some = slice(cut[k], cut[k + 1])
            out[m] = _answer(texts[m], start[some] - begin[k], length[some], period[some])
    return out


def periodic_runs(docs: DataFrame, prepare: Callable | None = None, least: int = LEAST) -> DataFrame:
    """docs without text, with n_runs, the greatest run's start, length, period and exponent_milli,
    and the digests runs_sha256 and collapsed_sha256.

    A run is a stretch of words with smallest period q, of at least `least` words and three
    periods, that no neighbouring word extends. The greatest has the greatest length by period; ties
    go to the smaller start, then the smaller period. Words of a run after its first period are
    collapsed. `prepare` may change the words of a document first: it takes doc_id (None if null)
    and words, and returns words.

    Null, empty or blank texts and texts without a run: n_runs 0, four nulls, the digest of no rows
    and that of all words. Very long texts are handled alone, in memory that grows with the text
    (some 300 bytes a word). Repeated rows and equal ids get their own answers each; an empty table
    stays empty. Other columns pass through, but for those added, which are replaced.
    """
    new = {name for name, _ in ADDED} | {"text"}
    others = [f for f in docs.schema if f.name not in new]
    names = [f.name for f in others]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, size, row = [], 0, low
                while row < batch.num_rows and size < 4 * BATCH:
                    words = batch.column("__text")[row].as_buffer().to_pybytes().split()
                    if prepare is not None:
                        words = prepare(batch.column("__id")[row].as_py(), words)
                    texts.append(words)
                    size += len(words)
                    row += 1
                columns = list(zip(*answers(texts, least)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(low, row - low) for n in names),
                     *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=names + [name for name, _ in ADDED])
                low = row

    text = F.coalesce(F.col("text"), F.lit("")).alias("__text")
    return docs.select(*names, F.col("doc_id").alias("__id"), text).mapInArrow(
        judge, T.StructType([*others, *(T.StructField(n, t) for n, t in ADDED)]))
