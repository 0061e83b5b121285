"""A bar table by days: an append reads and rewrites the days it touches, and no others."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import BAR
from tickloom.session import materialise, scratch
from tickloom.sources.bars import append_bars
from tickloom.sources.versioned import Conflict, VersionedTable

NO_DAY = "none"          # the part of bars without a time


def with_day(bars: DataFrame) -> DataFrame:
    return bars.withColumn("day", F.coalesce(F.date_format("time", "yyyy-MM-dd"), F.lit(NO_DAY)))


class BarStore:
    """Bars at ``root``; one row per ``(symbol, time)``, the newest arrival wins."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.table = VersionedTable(spark, root, {"bars": BAR})

    def append(self, new: DataFrame, tries: int = 5, publish: bool = True) -> int:
        """Adds or corrects bars; returns the version. ``new`` may carry ``arrival``, see
        ``append_bars``. Days are few (a manifest holds one line a day); a writer that comes second
        merges again with what the first one wrote. Nothing to add: nothing is published."""
        with scratch(new.sparkSession):
            return self._append(materialise(with_day(new), "bars-new"), tries, publish)

    def _append(self, new: DataFrame, tries: int, publish: bool) -> int:
        days = [r["day"] for r in new.select("day").distinct().collect()]
        for left in reversed(range(tries)):
            base = max(self.table.versions(), default=None)
            if not days:
                return base
            merged = append_bars(self.table.read("bars", days, base), new.drop("day"))
            try:
                return self.table.commit({"bars": with_day(merged)}, "day", days, base, publish=publish)
            except Conflict:
                if not left:
                    raise
        raise ValueError("no tries")

    def read(self, start: date | None = None, end: date | None = None,
             version: int | None = -1) -> DataFrame:
        """Bars, those of the days from ``start`` to ``end`` if given: other days' folders are not
        even listed. ``version`` reads the table as it was."""
        if start is None and end is None:
            return self.table.read("bars", None, version)
        if version == -1:
            version = max(self.table.versions(), default=None)
        low, high = (start or date.min).isoformat(), (end or date.max).isoformat()
        days = [k.partition("/")[2] for k in self.table.manifest(version)]
        return self.table.read("bars", [d for d in days if d != NO_DAY and low <= d <= high], version)

    def replace(self, bars: DataFrame) -> int:
        """All bars anew (a snapshot), in one commit."""
        base = max(self.table.versions(), default=None)
        old = [k.partition("/")[2] for k in self.table.manifest(base)]
        return self.table.commit({"bars": with_day(bars)}, "day", old, base)

    def vacuum(self, keep: int = 2) -> int:
        return self.table.vacuum(keep)
