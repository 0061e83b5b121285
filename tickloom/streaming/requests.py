"""Requests answered as of their time while requests and answers both stream in.

A request waits until its strategy's newest bar has reached its time, and ``lateness`` more if bars
may come late; then the newest answer at or before its time is final. A strategy that nobody knows
and a request without a time don't wait. Answers are kept by day, with the last one of each
strategy and day, so a batch reads the days asked for and these last ones; waiting requests are kept
by the day they ask about, and days that no strategy has reached are not read. A repeated batch
finds its id published, or writes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.plans.decision import decisions_as_of, strategy_of
from tickloom.plans.presets import StrategyConfig
from tickloom.session import materialise, scratch
from tickloom.sources.barstore import NO_DAY
from tickloom.sources.versioned import VersionedTable

MARK = T.StructType([T.StructField("strategy", T.StringType()),
                     T.StructField("time", T.TimestampNTZType())])
ANSWER = T.StructType([*MARK.fields, *[T.StructField(c, T.StringType()) for c in (
    "action_sell", "action_buy", "action")]])
VERSION = "batch"        # of an answer: the newest one counts
TOLD = T.StructType([*ANSWER.fields, T.StructField(VERSION, T.LongType())])
ALL = "all"              # the part that holds the newest bar of each strategy


def day(time: str) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(NO_DAY)).alias("day")


class RequestStream:
    """Requests of schema ``asked``, with ``strategy`` and ``to_time``, answered under ``root``.
    Their other columns go along; ``symbol``, ``day`` and the names of an answer are taken."""

    def __init__(self, spark: SparkSession, root: str, strategies: Sequence[StrategyConfig],
                 asked: T.StructType, lateness: str = "0 seconds", bar_seconds: int = 3600) -> None:
        self.spark, self.root, self.strategies = spark, root.rstrip("/"), list(strategies)
        self.asked, self.lateness, self.bar_seconds = asked, lateness, bar_seconds
        self.answers = VersionedTable(spark, f"{self.root}/answers",
                                      {"rows": ANSWER, "lasts": ANSWER, "marks": MARK})
        self.waiting = VersionedTable(spark, f"{self.root}/waiting", {"asked": asked})

    # --- a batch -----------------------------------------------------------------------------

    def add(self, asked: DataFrame, told: DataFrame, batch: int) -> None:
        """Take in the answers and requests of a batch and answer what can be. ``told`` has the
        columns of ``ANSWER`` and may have ``batch``; an answer replaces an older one of its time."""
        with scratch(self.spark):
            self._tell(told, batch)
            self._answer(asked, batch)
        for table in (self.answers, self.waiting):
            table.vacuum(2)

    def _tell(self, told: DataFrame, batch: int) -> None:
        versions = self.answers.versions()
        if batch in versions:
            return
        base = max((v for v in versions if v < batch), default=None)
        rank = F.col(VERSION) if VERSION in told.columns else F.lit(0)
        new = materialise(told.filter("time IS NOT NULL AND strategy IS NOT NULL").groupBy(
            "strategy", "time").agg(F.max_by(F.struct(*ANSWER.fieldNames()[2:]), F.struct(
                rank.alias("at"), *ANSWER.fieldNames()[2:])).alias("_a")).select(
            "strategy", "time", "_a.*", day("time")), "answers-new")
        days = [r["day"] for r in new.select("day").distinct().collect()]
        if not days:
            return
        old = self.answers.read("rows", days, base).join(new, ["strategy", "time"], "left_anti")
        rows = materialise(old.select("*", day("time")).unionByName(new), "answers-days")
        lasts = rows.groupBy("strategy", "day").agg(
            F.max_by(F.struct(*ANSWER.fieldNames()[1:]), "time").alias("_a")).select(
            "strategy", "_a.*", "day")
        marks = self.answers.read("marks", [ALL], base).unionByName(
            new.select("strategy", "time")).groupBy("strategy").agg(F.max("time").alias("time"))
        self.answers.commit(
            {"rows": rows, "lasts": lasts, "marks": marks.withColumn("day", F.lit(ALL))},
            "day", [*days, ALL], base, batch)

    def _answer(self, asked: DataFrame, batch: int) -> None:
        versions = self.waiting.versions()
        if batch in versions:
            return
        base = max((v for v in versions if v < batch), default=None)
        told = max((v for v in self.answers.versions() if v <= batch), default=None)
        marks = self.answers.read("marks", [ALL], told)
        new = materialise(asked.select(*self.asked.fieldNames(), day("to_time")), "requests-new")
        new_days = {r["day"] for r in new.select("day").distinct().collect()}
        newest = marks.agg(F.max(F.date_format("time", "yyyy-MM-dd"))).first()[0] or ""
        held = {k.partition("/")[2] for k in self.waiting.manifest(base)}
        due = sorted({d for d in held if d <= newest} | held & new_days)
        name, _ = strategy_of(self.strategies)
        until = F.col("_mark") - F.expr(f"INTERVAL {self.lateness}")
        placed = materialise(
            self.waiting.read("asked", due, base).select("*", day("to_time")).unionByName(new)
            .withColumn("_strategy", name).join(
                marks.select(F.col("strategy").alias("_strategy"), F.col("time").alias("_mark")),
                "_strategy", "left")
            .withColumn("_ready", F.col("_strategy").isNull() | F.col("to_time").isNull()
                        | F.coalesce(F.col("to_time") <= until, F.lit(False)))
            .drop("_strategy", "_mark"), "requests-placed")
        ready = {r["day"] for r in placed.filter("_ready").select("day").distinct().collect()}
        if ready:
            found = self._as_of(placed.filter("_ready").select(*self.asked.fieldNames()), ready, told)
            found.write.mode("overwrite").parquet(f"{self.root}/answered/batch={batch}")
        if ready | new_days:
            days = sorted(ready | new_days)
            left = placed.filter(~F.col("_ready") & F.col("day").isin(days)).drop("_ready")
            self.waiting.commit({"asked": left}, "day", days, base, batch)

    def _as_of(self, requests: DataFrame, days: set[str], version: int | None) -> DataFrame:
        """Answers from the rows of the days asked for and the last ones of earlier days."""
        held = {k.partition("/")[2] for k in self.answers.manifest(version)} - {ALL}
        before = [d for d in held - days if d < max(days - {NO_DAY}, default="")]
        series = self.answers.read("rows", sorted(held & days), version).unionByName(
            self.answers.read("lasts", sorted(before), version))
        return decisions_as_of(requests, series, self.strategies, self.bar_seconds)

    # --- results -----------------------------------------------------------------------------

    def read(self, waiting: bool = False) -> DataFrame:
        """Final answers; with ``waiting`` also what waiting requests would get now."""
        days = {k.partition("/")[2] for k in self.waiting.manifest(
            max(self.waiting.versions(), default=None))} if waiting else set()
        asked = self.pending() if waiting else self.spark.createDataFrame([], self.asked)
        still = self._as_of(asked, days, max(self.answers.versions(), default=None))
        if not self.waiting.exists(f"{self.root}/answered"):
            return still
        final = self.spark.read.schema(still.schema).parquet(f"{self.root}/answered")
        return still.unionByName(final.select(*still.columns))

    def pending(self) -> DataFrame:
        """Requests that wait."""
        return self.waiting.read("asked")

    def follow(self, requests: DataFrame, answers: DataFrame) -> StreamingQuery:
        """Process the requests and answers that have arrived, then stop; both are streams."""
        told = F.struct(*[F.col(c) for c in answers.columns])
        asked = F.struct(*[F.col(c) for c in self.asked.fieldNames()])
        nothing = [F.lit(None).cast(t) for t in (self.asked, answers.schema)]
        both = requests.select(asked.alias("asked"), nothing[1].alias("told")).union(
            answers.select(nothing[0].alias("asked"), told.alias("told")))

        def one(batch: DataFrame, batch_id: int) -> None:
            self.add(batch.filter("asked IS NOT NULL").select("asked.*"),
                     batch.filter("told IS NOT NULL").select("told.*"), batch_id)

        return both.writeStream.foreachBatch(one).option(
            "checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
