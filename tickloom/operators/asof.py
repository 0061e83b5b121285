"""As-of lookup: for every request the newest row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import epoch_second
from tickloom.operators.blocks import exclusive_prefix
from tickloom.session import materialise

BARS_PER_BLOCK = 32


def as_of_join(
    requests: DataFrame, series: DataFrame, time: str, at: str, payload: Sequence[str],
    bar_seconds: int = 3600, key: str = "symbol",
) -> DataFrame:
    """Requests plus ``payload`` of the newest ``series`` row with ``time <= at``, per ``key``.

    Rows are grouped into short time blocks (at most ``BARS_PER_BLOCK`` bars, since ``(key,
    time)`` is unique on the grid of ``bar_seconds``); each block also knows the last row before it. The lookup is
    then an equi-join on ``(key, block)`` whose request side may be split when it is skewed, and
    no pair of a request and a row it does not need is ever formed. Requests without an earlier
    row keep NULLs.
    """
    width = BARS_PER_BLOCK * bar_seconds
    row = F.struct(F.col(time).alias("_t"), *payload)
    keyed = series.select(F.col(key).alias("symbol"), *dict.fromkeys([time, *payload]))
    filled = keyed.groupBy("symbol", F.floor(epoch_second(F.col(time)) / width).alias("_b")).agg(
        F.sort_array(F.collect_list(row)).alias("_rows"), F.max_by(row, time).alias("_last"))
    asked = requests.withColumns({
        "_k": F.col(key), "_b": F.floor(epoch_second(F.col(at)) / width)})
    blocks = materialise(
        filled.join(asked.select(F.col("_k").alias("symbol"), "_b").distinct(),
                    ["symbol", "_b"], "full"),
        "asof-blocks")
    before = exclusive_prefix(blocks, "_b", lasts=["_last"]).withColumnRenamed("_last", "_before")
    known = blocks.drop("_last").join(before, ["symbol", "_b"]).withColumnRenamed("symbol", "_k")
    own = F.filter("_rows", lambda r: r["_t"] <= F.col(at))
    found = F.coalesce(F.try_element_at(own, F.lit(-1)), F.col("_before"))
    return asked.join(known, ["_k", "_b"], "left").select(
        *requests.columns, found.alias("_found")).select(
        *requests.columns, *[F.col(f"_found.{p}").alias(p) for p in payload])
