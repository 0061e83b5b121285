"""Features from the middle of a series: kept carries of every chunk.

``FeatureIndex`` stores bars by chunk together with a mark a chunk: the value of every running
recursion and the last known value of every column at its end. The features of any bar follow from
the mark before its chunk, the bars of that chunk, and the few bars before it that the frames reach.
A question about a past time reads two chunks at most, wherever it lies in its series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.operators.asof import as_of_join
from tickloom.operators.blocks import CHUNK_ROWS, Series, index_rows, task_count
from tickloom.operators.fill import fill
from tickloom.plans.features import run_plan
from tickloom.session import materialise
from tickloom.sources.versioned import VersionedTable
from tickloom.streaming.features import BUCKETS, FeatureStream, bucket

SPAN = 16            # chunks of a symbol that lie in one part
BETWEEN = "\u0000"   # in the name of a symbol's piece that is planned as a series of its own


class FeatureIndex:
    """Bars and marks at ``root``, for the given columns, each row as if the history ended there."""

    def __init__(self, spark: SparkSession, root: str, columns: Sequence[str],
                 chunk_rows: int = CHUNK_ROWS, bar_seconds: int = 3600) -> None:
        self.spark, self.bar_seconds = spark, bar_seconds
        self.features = FeatureStream(columns, chunk_rows, bar_seconds)
        self.size = self.features.chunk_rows
        self.table = VersionedTable(spark, root, {"bars": None, "marks": None})

    def build(self, bars: DataFrame) -> None:
        """Index a whole history; one pass of the planner."""
        series = index_rows(bars.select(*I.BASE), self.size, self.bar_seconds)
        frame = materialise(series.frame, "restart-index")
        rows = self.features.rows(
            Series(frame.withColumn("_o", F.lit(0).cast("long")), self.size, series.tasks), None)
        rows = materialise(rows, "restart-rows")
        begins = rows.groupBy("symbol", "_c").agg(F.min("time").alias("_from"))
        marks = self.features.last_rows(rows, "symbol", "_c").join(begins, ["symbol", "_c"])
        chunk = F.floor(F.col("_i") / self.size)
        base = max(self.table.versions(), default=None)
        parts = {k.partition("/")[2] for k in self.table.manifest(base)}
        self.table.commit({
            "bars": frame.withColumn("_c", chunk).withColumn("part", self._part("symbol", "_c")),
            "marks": marks.withColumn("part", self._part("symbol", "_c"))}, "part", parts, base)

    @staticmethod
    def _part(symbol: str, chunk: str):
        return F.concat_ws("-", bucket(symbol), F.floor(F.col(chunk) / SPAN))

    def starts(self, requests: DataFrame, at: str) -> DataFrame:
        """``requests`` with the chunk ``_c`` whose mark their answer starts from (-1: the series'
        beginning) and the position ``_next`` after it."""
        version = max(self.table.versions(), default=None)
        buckets = {str(r[0]) for r in requests.select(bucket()).distinct().collect()}
        parts = {k.partition("/")[2] for k in self.table.manifest(version)}
        marks = self.table.read("marks", [p for p in parts if p.split("-")[0] in buckets], version)
        found = as_of_join(requests, marks, "_from", at, ["_c"], self.size * self.bar_seconds)
        chunk = F.coalesce("_c", F.lit(0).cast("long"))
        return found.withColumns({"_c": chunk - 1, "_next": chunk * self.size})

    def pieces(self, started: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
        """What the answers need: the bars of each chunk asked about, up to the latest question, with
        those before it that frames reach, and the marks. Both name the piece as ``symbol``."""
        needed = materialise(started.groupBy("symbol", "_c", "_next").agg(F.max(at).alias("_to")),
                             "restart-needed")
        version = max(self.table.versions(), default=None)
        parts = [r[0] for r in needed.select(F.explode(F.array(
            self._part("symbol", "_c"), F.concat_ws("-", bucket("symbol"), F.floor(
                (F.col("_c") + 1) / SPAN))))).distinct().collect()]      # few: parts of the manifest
        piece = F.concat("symbol", F.lit(BETWEEN), F.col("_start").cast("string"))
        asked = needed.select("symbol", F.col("_c").alias("_start"), "_next", "_to")
        two = asked.withColumn("_c", F.explode(F.array(F.col("_start"), F.col("_start") + 1)))
        bars = self.table.read("bars", parts, version).join(two, ["symbol", "_c"]).filter(
            ((F.col("_c") > F.col("_start")) | (F.col("_i") >= F.col("_next") - self.features.plan.back))
            & (F.col("time") <= F.col("_to"))).withColumns({"symbol": piece, "_o": F.col("_next")})
        marks = self.table.read("marks", parts, version).drop("_next").join(
            asked.withColumn("_c", F.col("_start")), ["symbol", "_c"]).withColumn("symbol", piece)
        return bars.select(*I.BASE, "_i", "_o"), marks

    def answers(self, requests: DataFrame, at: str = "to_time") -> DataFrame:
        """Requests with ``bar_time`` and the columns of the newest bar of their ``symbol`` not after
        ``at``; NULLs where there is none."""
        started = materialise(self.starts(requests, at), "restart-requests")
        bars, marks = self.pieces(started, at)
        bars = materialise(bars, "restart-bars")
        sizes = bars.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("p")).first()
        series = Series(bars, self.size, task_count(self.spark, sizes["n"], max(sizes["p"], 1)))
        rows = self.features.rows(series, marks)
        piece = F.concat("symbol", F.lit(BETWEEN), F.col("_c").cast("string"))
        found = as_of_join(started.withColumn("_piece", piece),
                           rows.withColumn("bar_time", F.col("time")).withColumnRenamed("symbol", "_piece"),
                           "time", at, ["bar_time", *self.features.columns], self.bar_seconds, "_piece")
        return found.drop("_piece", "_c", "_next")
