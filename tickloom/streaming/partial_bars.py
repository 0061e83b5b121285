"""Bars that are open or get late ticks: partial bars by day, merged as ticks come.

A partial bar keeps, beside its prices, the order keys of its first and last tick, so two partials
of one bar merge to the partial of all their ticks, in any order. Each micro-batch aggregates its
ticks, merges them with the partials of the days it touches and publishes these days under the
batch's id. What is read is complete at every moment: open bars are there, and a late tick, however
late, changes its bar. A repeated batch finds its id published and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.schema import BAR
from tickloom.session import materialise, scratch
from tickloom.sources.bars import tick_order
from tickloom.sources.barstore import with_day
from tickloom.sources.versioned import VersionedTable

PARTIAL = T.StructType([*BAR.fields, T.StructField("first_key", T.DecimalType(38, 0)),
                        T.StructField("last_key", T.DecimalType(38, 0))])


def partial_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Partial bars of ticks ``(symbol, ts, seq, price, spread)``; hash aggregation, combined before
    the shuffle."""
    rank = tick_order()
    return ticks.groupBy(
        "symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("time")).agg(
        F.min_by("price", rank).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", rank).alias("close"),
        F.count(F.lit(1)).alias("tick_volume"),
        F.max_by("spread", rank).cast("int").alias("spread"),
        F.min(rank).alias("first_key"), F.max(rank).alias("last_key"))


def merged(partials: DataFrame) -> DataFrame:
    """One partial per ``(symbol, time)``."""
    return partials.groupBy("symbol", "time").agg(
        F.min_by("open", "first_key").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "last_key").alias("close"),
        F.sum("tick_volume").alias("tick_volume"),
        F.max_by("spread", "last_key").alias("spread"),
        F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


class LiveBars:
    """The bars of a tick stream at ``root``, open ones included."""

    def __init__(self, spark: SparkSession, root: str, unit: str = "hour") -> None:
        self.root, self.unit = root.rstrip("/"), unit
        self.table = VersionedTable(spark, f"{self.root}/bars", {"partials": PARTIAL})

    def add(self, ticks: DataFrame, batch: int) -> None:
        """Merge the ticks of a batch into the bars of their days."""
        versions = self.table.versions()
        if batch in versions:
            return
        base = max((v for v in versions if v < batch), default=None)
        with scratch(ticks.sparkSession):
            new = materialise(with_day(partial_bars(ticks, self.unit)), "partial-bars")
            days = [r["day"] for r in new.select("day").distinct().collect()]
            if not days:
                return
            both = self.table.read("partials", days, base).unionByName(new.drop("day"))
            self.table.commit({"partials": with_day(merged(both))}, "day", days, base, batch)
        self.table.vacuum(2)

    def read(self) -> DataFrame:
        """All bars as of the newest batch."""
        return self.table.read("partials").select(*BAR.fieldNames())

    def follow(self, ticks: DataFrame) -> StreamingQuery:
        """Process the ticks that have arrived, then stop."""
        return ticks.writeStream.foreachBatch(self.add).option(
            "checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
