"""Bounded-frame aggregates that stay NULL until the frame is full, as SQL text.

Expressions are text so that a stage of seventy columns is one ``selectExpr`` call. They all use
the same partitioning and order, so one stage is one Window node over one sort. Window calls stand
in «marks»: the planner computes equal calls of a stage once, which the optimizer does not do.
"""

from __future__ import annotations

from tickloom.operators.blocks import CHUNK_SQL


RUN = f"OVER ({CHUNK_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def call(text: str, over: str) -> str:
    return f"«{text} {over}»"


def frame(n: int) -> str:
    return f"OVER ({CHUNK_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gated(agg: str, x: str, n: int) -> str:
    """``agg`` over the last ``n`` rows if all of them hold a value of ``x``, else NULL.

    The test is the distance to the last row without a value, one running maximum per column,
    instead of a count over every frame width. Rows before the halo lie outside all frames.
    """
    gap = call(f"max(CASE WHEN {x} IS NULL THEN _i END)", RUN)
    return f"CASE WHEN _i - coalesce({gap}, -1) >= {n} THEN {call(agg, frame(n))} END"


def mean(x: str, n: int) -> str:
    return gated(f"avg({x})", x, n)


def known_mean(x: str, n: int) -> str:
    """The mean of what is known among the last ``n`` rows, however little."""
    return call(f"avg({x})", frame(n))


def std(x: str, n: int) -> str:
    """Sample deviation."""
    return gated(f"stddev_samp({x})", x, n)


def low(x: str, n: int) -> str:
    return gated(f"min({x})", x, n)


def high(x: str, n: int) -> str:
    return gated(f"max({x})", x, n)


def total(x: str, n: int) -> str:
    return gated(f"sum({x})", x, n)


def values(x: str, n: int) -> str:
    """The frame itself, at most ``n`` values."""
    return gated(f"collect_list({x})", x, n)


def previous(x: str, k: int = 1) -> str:
    return call(f"lag({x}, {k})", f"OVER ({CHUNK_SQL})")


def following(x: str, k: int = 1) -> str:
    return call(f"lead({x}, {k})", f"OVER ({CHUNK_SQL})")


def mean_abs_deviation(window: str, centre: str, n: int) -> str:
    """Mean distance of the frame's values from ``centre``."""
    return f"aggregate({window}, 0D, (acc, x) -> acc + abs(x - {centre})) / {n}"


def fullest_bin_share(window: str, lowest: str, highest: str, n: int, bins: int = 10) -> str:
    """Share of the frame in the fullest of ``bins`` equal-width bins.

    Bins are closed on the right and the first one takes the minimum too. A constant frame lies
    in one bin.
    """
    step = f"(({highest} - {lowest}) / {bins})"

    def edge(k: int) -> str:
        return f"{lowest} + {step} * {k}"

    def count_in(k: int) -> str:
        sides = [f"x > {edge(k - 1)}"] * (k > 1) + [f"x <= {edge(k)}"] * (k < bins)
        return f"size(filter({window}, x -> {' AND '.join(sides)}))"

    counts = ", ".join(count_in(k) for k in range(1, bins + 1))
    return (f"CASE WHEN {window} IS NULL THEN NULL WHEN {highest} = {lowest} THEN 1D "
            f"ELSE greatest({counts}) / {n}D END")


def tie_share(window: str, extreme: str, n: int) -> str:
    """Share of the frame equal to its extreme value."""
    return (f"CASE WHEN {window} IS NOT NULL "
            f"THEN size(filter({window}, x -> x = {extreme})) / {n}D END")
