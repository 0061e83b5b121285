"""Running recursions ``s_t = r * s_{t-1} + u_t`` over chunked series.

Inside a chunk the recursion is a scaled running sum, ``r^j * sum(u_k * r^-k)``. Between chunks
only the last value of each chunk matters: chunk ``c`` starts from
``sum_d last(c - d) * r^(size * (d - 1))``. Each summary is sent forward to the chunks it can still
reach in double precision (beyond that its weight is exactly 0.0), so no task folds a whole series.
A ratio of 1 is a plain running total and uses the block prefix instead, and so does the last known
value of a column.

Where the ratio differs by row (``s_t = r_t * s_{t-1} + u_t``), the scaled sum runs over the product
of the ratios in logarithms, and a chunk is an affine map of what comes before it: its product and
its offset. These maps are composed in order (`exclusive_affine`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.sqltext import num
from tickloom.operators.blocks import (
    CHUNK_SQL, exclusive_affine, exclusive_prefix, last_own_rows,
)
from tickloom.session import materialise

RUN_SQL = f"OVER ({CHUNK_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# ln of the smallest positive double is about -745.1; weights below it are exactly zero.
UNDERFLOW = 746.0
# Largest allowed ln(r^-size): keeps the scaled sums inside the double range.
HEADROOM = 575.0


@dataclass(frozen=True)
class Scan:
    """Running recursion over column ``u``.

    ``decay``: a fixed ``ratio`` in (0, 1]. ``affine``: the ratio of each row, in [0, 1], is column
    ``r``; within a chunk, the ratios after the first below 1 must multiply to at least
    ``ratio ** size``. ``last``: the last known value of ``u``.
    """

    name: str
    u: str
    ratio: float
    kind: str = "decay"
    r: str = ""


def safe_chunk_rows(ratios: Sequence[float], wanted: int) -> int:
    """Chunk size for which no scaled sum leaves the double range."""
    decays = [-math.log(r) for r in ratios if 0.0 < r < 1.0]
    return min([wanted, *[int(HEADROOM / d) for d in decays]])


def local_value(scan: Scan, size: int) -> str:
    """The recursion restarted from 0 at the chunk's first own row, as SQL text."""
    mine = f"CASE WHEN _j >= 0 AND _j < {size} THEN coalesce(double({scan.u}), 0D) ELSE 0D END"
    if scan.kind == "last":
        return f"last(CASE WHEN _j >= 0 AND _j < {size} THEN {scan.u} END, true) {RUN_SQL}"
    if scan.ratio == 1.0:
        return f"sum({mine}) {RUN_SQL}"
    if scan.ratio == 0.0:       # no memory: the value itself
        return f"last({mine}) {RUN_SQL}"
    ratio = num(scan.ratio)
    return f"pow({ratio}, _j) * sum(({mine}) * pow({ratio}, -_j)) {RUN_SQL}"


def affine_levels(scan: Scan, size: int) -> list[list[str]]:
    """Select lists, one over the other, that add an affine scan restarted from 0 at the chunk's
    first own row, and the product of the ratios up to each row."""
    n = scan.name
    mine = f"_j >= 0 AND _j < {size}"
    # the first ratio below 1 has nothing to scale: it may be as small as it likes, also 0
    return [
        [f"min(CASE WHEN {mine} AND {scan.r} < 1 THEN _i END) {RUN_SQL} AS _first_{n}"],
        [f"sum(CASE WHEN {mine} AND _i > _first_{n} AND {scan.r} < 1 THEN ln({scan.r}) ELSE 0D END) "
         f"{RUN_SQL} AS _log_{n}",
         f"coalesce(min(CASE WHEN _i = _first_{n} THEN {scan.r} END) {RUN_SQL}, 1D) AS _begin_{n}"],
        [f"exp(_log_{n}) * sum(CASE WHEN {mine} THEN {scan.u} * exp(-_log_{n}) ELSE 0D END) "
         f"{RUN_SQL} AS {n}", f"_begin_{n} * exp(_log_{n}) AS {product(n)}"],
    ]


def product(name: str) -> str:
    """The column with the product of an affine scan's ratios."""
    return f"_product_{name}"


def _reach(scan: Scan, size: int) -> int:
    if scan.ratio == 0.0:
        return 0
    return math.ceil(UNDERFLOW / (-math.log(scan.ratio) * size)) + 1


def carry_table(
    frame: DataFrame, scans: Sequence[Scan], size: int, seed: DataFrame | None = None,
) -> DataFrame:
    """Value each scan has just before every chunk, keyed ``(symbol, _c)``; read once, so not
    written.

    ``seed`` holds values from before chunk 0 (a continued series), one row per symbol.
    """
    names = [s.name for s in scans]
    affine = [s.name for s in scans if s.kind == "affine"]
    ends = last_own_rows(frame, size).select("symbol", "_c", *names, *map(product, affine))
    if seed is not None:
        ends = ends.unionByName(seed.select(
            "symbol", F.lit(-1).cast("long").alias("_c"), *names,
            *[F.lit(0.0).alias(product(n)) for n in affine]))
    decays = [s for s in scans if s.kind == "decay" and s.ratio < 1.0]
    totals = [s.name for s in scans if s.kind == "decay" and s.ratio == 1.0]
    lasts = [s.name for s in scans if s.kind == "last"]
    if totals or lasts or affine:
        ends = materialise(ends, "scan-ends")
    if totals or lasts:
        before = exclusive_prefix(ends, "_c", sums=totals, lasts=lasts)
        full = ends.join(before.select("symbol", "_c", *[
            F.col(t).alias(f"_before_{t}") for t in (*totals, *lasts)]), ["symbol", "_c"])
    else:
        full = ends
    reach = max((_reach(s, size) for s in decays), default=0)
    sent = full.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    gap = (F.col("_d") - 1) * size
    sums = [F.sum(F.when(F.col("_d") > 0, F.col(s.name) * F.pow(F.lit(s.ratio), gap)))
            .alias(f"_in_{s.name}") for s in decays]
    sums += [F.max(F.when(F.col("_d") == 0, F.col(f"_before_{t}"))).alias(f"_in_{t}")
             for t in (*totals, *lasts)]
    target = ["symbol", (F.col("_c") + F.col("_d")).alias("_c")]
    carry = sent.groupBy(*target).agg(*sums) if sums else None
    if affine:
        maps = ends.select("symbol", "_c", F.inline(F.array(*[F.struct(
            F.lit(n).alias("scan"), F.col(product(n)).alias("a"),
            F.coalesce(F.col(n), F.lit(0.0)).alias("b")) for n in affine])))
        ahead = exclusive_affine(maps, "_c").groupBy("symbol", "_c").agg(*[
            F.max(F.when(F.col("scan") == n, F.col("b"))).alias(f"_in_{n}") for n in affine])
        carry = ahead if carry is None else carry.join(ahead, ["symbol", "_c"], "full")
    return carry


def with_carry(
    frame: DataFrame, carry: DataFrame, scans: Sequence[Scan], keep: Sequence[str],
) -> DataFrame:
    """Add what came before the chunk; holds from the row just before it (``_j = -1``) on."""
    joined = frame.join(carry, ["symbol", "_c"], "left")
    values = []
    for s in scans:
        if s.kind == "last":
            values.append(F.coalesce(s.name, f"_in_{s.name}").alias(s.name))
            continue
        before = F.coalesce(F.col(f"_in_{s.name}"), F.lit(0.0))
        if s.kind == "affine":
            values.append((F.col(s.name) + F.col(product(s.name)) * before).alias(s.name))
            continue
        weight = F.lit(1.0) if s.ratio == 1.0 else F.pow(
            F.lit(s.ratio), (F.col("_j") + 1).cast("double"))
        values.append((F.col(s.name) + weight * before).alias(s.name))
    return joined.select(*keep, *values)
