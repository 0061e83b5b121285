"""Row-indexed chunks: how one long series is spread over many tasks.

A window partitioned by ``symbol`` alone puts a whole series into one task. Here every row gets
its position ``_i`` in its series and belongs to chunk ``_c = _i // chunk_rows``. Windows run per
``(symbol, _c)``; the rows a frame needs from the neighbouring chunk are copied into it (the
halo), so a bounded frame sees exactly the rows it would see in the unchunked series. What depends
on the whole past (sums, decays, fills) passes between chunks as one summary row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import epoch_second
from tickloom.session import materialise

CHUNK_ROWS = 1024

# Block summaries that one task prefixes; their groups are prefixed again.
PREFIX_FAN = 4096

CHUNK_SQL = "PARTITION BY symbol, _c ORDER BY _i"

# Rows one task computes features for; keeps tasks short although the rows are narrow.
ROWS_PER_TASK = 50_000


def chunk_window():
    """The window every per-chunk operator uses, as a WindowSpec."""
    return Window.partitionBy("symbol", "_c").orderBy("_i")


def exclusive_prefix(
    blocks: DataFrame,
    order: str,
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    fan: int = PREFIX_FAN,
) -> DataFrame:
    """Per block: totals (``sums``) and last known values (``lasts``) over the earlier blocks.

    ``blocks`` has one row per ``(symbol, order)``. The window runs per group of ``fan`` blocks,
    and one more over the group totals of a symbol: a task holds ``fan`` blocks, or one row for
    ``fan`` blocks of its symbol (with chunks of 1,024 rows, one for four million rows). ``blocks``
    is read twice: pass a written table.
    """
    group = f"{order}g"
    grouped = blocks.withColumn(group, F.floor(F.col(order) / fan))
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def earlier(over: str, prefix: str = "") -> list[str]:
        return [*[f"coalesce(sum({c}) {over}, 0) AS {prefix}{c}" for c in sums],
                *[f"last({c}, true) {over} AS {prefix}{c}" for c in lasts]]

    local = grouped.selectExpr("symbol", group, order, *earlier(
        f"OVER (PARTITION BY symbol, {group} ORDER BY {order} {so_far})"))
    tops = grouped.groupBy("symbol", group).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in sums],
        *[F.expr(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN {order} END) AS {c}")
          for c in lasts])
    above = tops.selectExpr("symbol", group, *earlier(
        f"OVER (PARTITION BY symbol ORDER BY {group} {so_far})", "_top_"))
    return local.join(above, ["symbol", group]).selectExpr(
        "symbol", order, *[f"{c} + _top_{c} AS {c}" for c in sums],
        *[f"coalesce({c}, _top_{c}) AS {c}" for c in lasts])


# Affine maps that one task composes, and how often groups of them are composed again: three
# levels reach 256^3 chunks of a series.
AFFINE_FAN, AFFINE_LEVELS = 256, 3


def exclusive_affine(
    blocks: DataFrame, order: str, fan: int = AFFINE_FAN, levels: int = AFFINE_LEVELS,
) -> DataFrame:
    """Per block: the maps ``s -> a * s + b`` of all earlier blocks, composed in order.

    ``blocks`` has columns ``symbol``, ``scan``, ``order``, ``a`` and ``b``. Maps are composed one
    after another, never divided by a running product, so that factors of any size, also 0, keep
    their precision. A task folds ``fan`` maps of a group; group totals are composed the same way,
    level by level. ``blocks`` is read at every level: pass a written table.
    """
    keys = ["symbol", "scan"]
    grouped = blocks.select(*keys, F.col(order).alias("_at"), "a", "b").groupBy(
        *keys, F.floor(F.col("_at") / fan).alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "a", "b"))).alias("_maps"))
    folded = grouped.selectExpr(*keys, "_group", """aggregate(_maps,
        named_struct('a', 1D, 'b', 0D, 'out', cast(array() AS array<struct<_at: bigint, a: double, b: double>>)),
        (s, x) -> named_struct('a', s.a * x.a, 'b', x.a * s.b + x.b,
            'out', concat(s.out, array(named_struct('_at', x._at, 'a', s.a, 'b', s.b))))) AS _fold""")
    inside = folded.select(*keys, "_group", F.inline("_fold.out"))
    if levels == 1:
        return inside.drop("_group").withColumnRenamed("_at", order)
    totals = folded.select(*keys, "_group", "_fold.a", "_fold.b")
    above = exclusive_affine(totals, "_group", fan, levels - 1).select(
        *keys, "_group", F.col("a").alias("_a"), F.col("b").alias("_b"))
    return inside.join(above, [*keys, "_group"]).select(
        *keys, F.col("_at").alias(order), (F.col("_a") * F.col("a")).alias("a"),
        (F.col("a") * F.col("_b") + F.col("b")).alias("b"))


@dataclass(frozen=True)
class Series:
    """Bars with their position ``_i``, and the tasks to spread their chunks over."""

    frame: DataFrame
    chunk_rows: int
    tasks: int


def task_count(spark: SparkSession, rows: int, chunks: int) -> int:
    """Tasks for the chunk stage: by rows, since bytes understate the work of 120 columns."""
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(default, chunks), math.ceil(rows / ROWS_PER_TASK))


def index_rows(
    bars: DataFrame, chunk_rows: int = CHUNK_ROWS, bar_seconds: int = 3600, reuse: bool = False,
) -> Series:
    """Number the rows of every series without a whole-series window.

    Rows are counted per time bucket of ``chunk_rows`` bar widths, the counts are prefixed, and
    ``row_number`` runs inside a bucket. A bucket holds at most ``chunk_rows`` bars of a symbol
    because ``(symbol, time)`` is unique on the bar grid. ``reuse`` writes the result when several
    branches will read it.
    """
    bucketed = bars.withColumn(
        "_b", F.floor(epoch_second(F.col("time")) / (chunk_rows * bar_seconds)))
    counts = materialise(
        bucketed.groupBy("symbol", "_b").agg(F.count(F.lit(1)).alias("_n")), "bar-counts")
    sizes = counts.agg(F.sum("_n").alias("rows"), F.count_distinct("symbol").alias("series")).first()
    rows = sizes["rows"] or 0
    tasks = task_count(bars.sparkSession, rows, rows // chunk_rows + sizes["series"])
    offsets = exclusive_prefix(counts, "_b", sums=["_n"]).withColumnRenamed("_n", "_before")
    inside = Window.partitionBy("symbol", "_b").orderBy("time")
    frame = bucketed.join(offsets, ["symbol", "_b"]).withColumn(
        "_i", F.col("_before") + F.row_number().over(inside) - 1).drop("_b", "_before")
    return Series(
        materialise(frame, "bar-index") if reuse else frame, chunk_rows, tasks)


def spread(series: Series, back: int, ahead: int = 0, origin: str | None = None) -> DataFrame:
    """Rows addressed to their chunk plus halo copies; ``_j`` is the position inside the chunk.

    Own rows have ``0 <= _j < chunk_rows``. ``origin`` names a column from which chunks are
    counted instead of 0 (used when a series is continued: rows before it are only halo).
    """
    size = series.chunk_rows
    if max(back, ahead) > size:
        raise ValueError(f"frames of {max(back, ahead)} rows need chunks of at least that size")
    frame = series.frame
    start = F.col(origin) if origin else F.lit(0)
    offset = F.col("_i") - start
    chunk = F.floor(offset / size)
    place = offset - chunk * size
    targets = [chunk]
    if back:
        targets.append(F.when(place >= size - back, chunk + 1))
    if ahead:
        targets.append(F.when((place < ahead) & (chunk > 0), chunk - 1))
    address = F.explode(F.array_compact(F.array(*targets))) if len(targets) > 1 else chunk
    out = frame.withColumn("_c", address).withColumn("_j", offset - F.col("_c") * size)
    return out.filter(F.col("_c") >= 0).repartition(series.tasks, "symbol", "_c")


def own(size: int):
    return (F.col("_j") >= 0) & (F.col("_j") < size)


def last_own_rows(frame: DataFrame, size: int) -> DataFrame:
    """The final own row of every chunk, where running values hold the chunk's summary."""
    mine = frame.filter(own(size))
    return mine.withColumn("_next", F.lead("_i").over(chunk_window())).filter(
        F.col("_next").isNull()).drop("_next")
