"""Forward and backward fill of many columns over chunked series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import CHUNK_SQL, exclusive_prefix
from tickloom.session import materialise

_SO_FAR = f"OVER ({CHUNK_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_TO_COME = f"OVER ({CHUNK_SQL} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _either(*names: str) -> str:
    return f"coalesce({', '.join(names)}) AS {names[0]}"


def fill(
    frame: DataFrame, columns: Sequence[str], backward: bool = True,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Forward fill, then (if ``backward``) fill what is left from the first known value.

    After a forward fill only the head of a series can still be empty, so the backward fill needs
    just one value per series and column. ``frame`` holds own rows only. What is filled within
    chunks is written once: chunk summaries are a hash aggregation over it, and the result is a
    scan joined with them. ``seed`` gives the last known values before chunk 0, one row per symbol.
    """
    others = [x for x in frame.columns if x not in columns]
    local = materialise(
        frame.selectExpr(*others, *[f"last({x}, true) {_SO_FAR} AS {x}" for x in columns]),
        "fill-local")
    first = "min_by({0}, CASE WHEN {0} IS NOT NULL THEN _i END) AS _first_{0}"
    ends = local.groupBy("symbol", "_c").agg(
        *[F.expr(f"max_by({x}, _i) AS {x}") for x in columns],
        *[F.expr(first.format(x)) for x in columns if backward])
    if seed is not None:
        ends = ends.unionByName(
            seed.select("symbol", F.lit(-1).cast("long").alias("_c"), *columns))
    ends = materialise(ends, "fill-ends")
    carried = exclusive_prefix(ends, "_c", lasts=columns).selectExpr(
        "symbol", "_c", *[f"{x} AS _in_{x}" for x in columns])
    if backward:
        heads = ends.groupBy("symbol").agg(*[F.expr(
            f"min_by(_first_{x}, CASE WHEN _first_{x} IS NOT NULL THEN _c END) AS _first_{x}")
            for x in columns])
        carried = carried.join(heads, "symbol")
    return local.join(carried, ["symbol", "_c"], "left").selectExpr(*others, *[
        _either(x, f"_in_{x}", *([f"_first_{x}"] if backward else [])) for x in columns])


def fill_backward(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Next known value at or after each row, for interior gaps too."""
    others = [x for x in frame.columns if x not in columns]
    local = frame.selectExpr(*others, *[f"last({x}, true) {_TO_COME} AS {x}" for x in columns])
    starts = materialise(
        local.filter(F.col("_j") == 0).select("symbol", (-F.col("_c")).alias("_r"), *columns),
        "fill-starts")
    carried = exclusive_prefix(starts, "_r", lasts=columns).select(
        "symbol", (-F.col("_r")).alias("_c"), *[F.col(x).alias(f"_in_{x}") for x in columns])
    return local.join(carried, ["symbol", "_c"], "left").selectExpr(
        *others, *[_either(x, f"_in_{x}") for x in columns])
