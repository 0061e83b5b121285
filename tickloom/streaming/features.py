"""Features of new bars only: the batch planner continued from a small per-symbol state.

State per symbol: the last rows the frames can reach, the value of every running recursion and the
last known value of every column. A micro-batch is planned exactly like a batch whose chunk 0
starts after the state: the kept rows are its halo, the recursions and fills its carry. The state
lies in buckets of symbols; a batch reads and writes the buckets of its own symbols, and publishes
them under its id in one manifest with the others as they were. It starts from the newest earlier
manifest, so a repeated batch gives the same result. What a batch writes on the way is deleted
when its result and state are stored.

A bar that has been seen already is dropped. A late or corrected bar changes every later row of
its symbol: those symbols are planned anew from the stored bars, and their rows from the first
changed bar on are written again. ``latest_rows`` reads the newest version of each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators import indicators as I
from tickloom.operators.blocks import CHUNK_ROWS, Series, index_rows
from tickloom.operators.fill import fill
from tickloom.operators.scan import safe_chunk_rows
from tickloom.plans.features import FeaturePlan, plan_features, registry_for, run_plan
from tickloom.schema import BAR
from tickloom.session import materialise, scratch
from tickloom.sources.bars import append_bars
from tickloom.sources.versioned import VersionedTable


@dataclass(frozen=True)
class State:
    """``tail``: last rows with position ``_i``; ``known``: next position, time of the last bar,
    scans, last values."""

    tail: DataFrame
    known: DataFrame


class FeatureStream:
    """Running features of a bar stream, every row as if the history ended there."""

    def __init__(self, columns: Sequence[str], chunk_rows: int = CHUNK_ROWS,
                 bar_seconds: int = 3600):
        registry = registry_for("as_of")
        scans = plan_features(columns, registry).all_scans
        self.columns = list(columns)
        self.scans = [s.name for s in scans]
        # Scans are outputs too: their last values are the state.
        self.plan: FeaturePlan = plan_features(
            list(dict.fromkeys([*columns, *self.scans])), registry)
        self.chunk_rows = safe_chunk_rows([s.ratio for s in scans], chunk_rows)
        self.bar_seconds = bar_seconds

    def advance(self, bars: DataFrame, state: State | None) -> tuple[DataFrame, State]:
        """Features of ``bars`` and the state after them."""
        series = index_rows(bars.select(*I.BASE), self.chunk_rows, self.bar_seconds)
        frame = series.frame
        if state is None:
            frame = frame.withColumn("_o", F.lit(0).cast("long"))
        else:
            starts = state.known.select("symbol", F.col("_next").alias("_o"))
            frame = frame.join(starts, "symbol", "left").withColumn(
                "_o", F.coalesce("_o", F.lit(0)))
            frame = frame.withColumn("_i", F.col("_i") + F.col("_o"))
            touched = bars.select("symbol").distinct()
            old = state.tail.join(touched, "symbol", "left_semi").join(starts, "symbol")
            frame = frame.unionByName(old)
        frame = materialise(frame, "stream-index")
        continued = Series(frame, self.chunk_rows, series.tasks)
        filled = materialise(self.rows(continued, state.known if state else None), "stream-rows")
        return filled.select(*I.BASE, *self.columns), self._after(frame, filled, state)

    def rows(self, series: Series, seed: DataFrame | None) -> DataFrame:
        """Features of the rows from ``_o`` on, filled; ``seed`` is what is known before it."""
        raw = run_plan(series, self.plan, "_o", seed)
        scans = [F.col(s).alias(f"_scan_{s}") for s in self.scans]
        return fill(raw.select(*raw.columns, *scans), self.columns, False, seed)

    def last_rows(self, rows: DataFrame, *keys: str) -> DataFrame:
        """What is known after the last row of each group."""
        values = [x for x in self.columns if x not in self.scans]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(
            (F.col("_i") + 1).alias("_next"), F.col("time").alias("_at"), *values,
            *[F.col(f"_scan_{s}").alias(s) for s in self.scans]), "_i").alias("_s"),
        ).select(*keys, "_s.*")

    def follow(
        self, arrived: DataFrame, stored: DataFrame | None, state: State | None,
    ) -> tuple[DataFrame, State]:
        """Like ``advance``, for bars in any order; ``stored`` holds all earlier ones, with the
        batch they came in as ``arrival``. Where a batch repeats a bar, one of its rows counts."""
        arrived = materialise(append_bars(arrived.limit(0), arrived), "stream-bars")
        if state is None or stored is None:
            return self.advance(arrived, state)
        seen = state.known.select("symbol", "_at")
        late = F.coalesce(F.col("time") <= F.col("_at"), F.lit(False))
        placed = arrived.join(seen, "symbol", "left").withColumn("_late", late).drop("_at")
        fresh = placed.filter(~F.col("_late")).drop("_late")
        behind = placed.filter("_late").drop("_late")
        earlier = stored.join(behind.select("symbol").distinct(), "symbol", "left_semi")
        earlier = materialise(append_bars(earlier.limit(0), earlier), "stream-earlier")
        changed = materialise(behind.select(*BAR.fieldNames()).subtract(
            earlier.select(*BAR.fieldNames())).groupBy("symbol").agg(F.min("time").alias("_from")),
            "stream-changed")
        if changed.isEmpty():
            return self.advance(fresh, state)
        rest, kept = self.advance(
            fresh.join(changed, "symbol", "left_anti"),
            State(state.tail.join(changed, "symbol", "left_anti"),
                  state.known.join(changed, "symbol", "left_anti")))
        again, redone = self.advance(append_bars(
            earlier.join(changed, "symbol", "left_semi"),
            arrived.join(changed, "symbol", "left_semi")), None)
        again = again.join(changed, "symbol").filter(F.col("time") >= F.col("_from")).drop("_from")
        return rest.unionByName(again), State(
            kept.tail.unionByName(redone.tail.select(*kept.tail.columns)),
            kept.known.unionByName(redone.known.select(*kept.known.columns)))

    def _after(self, frame: DataFrame, rows: DataFrame, state: State | None) -> State:
        last = self.last_rows(rows, "symbol")
        ends = last.select("symbol", F.col("_next").alias("_end"))
        tail = frame.drop("_o").join(ends, "symbol").filter(
            F.col("_i") >= F.col("_end") - self.plan.back).drop("_end")
        if state is None:
            return State(tail, last)
        return State(
            tail.unionByName(state.tail.join(ends, "symbol", "left_anti")),
            last.unionByName(state.known.join(ends, "symbol", "left_anti")))


BUCKETS = 64         # of symbols; a batch writes those of its own symbols


def bucket(symbol: str = "symbol"):
    return F.pmod(F.xxhash64(symbol), F.lit(BUCKETS))


def _states(spark: SparkSession, folder: str) -> VersionedTable:
    return VersionedTable(spark, folder, {"tail": None, "known": None})


def load_state(
    spark: SparkSession, folder: str, before: int, buckets: Sequence[int] | None = None,
) -> State | None:
    """Newest state written by a batch earlier than ``before``, of some buckets or all."""
    table = _states(spark, folder)
    version = max((v for v in table.versions() if v < before), default=None)
    if version is None:
        return None
    return State(*(table.read(name, buckets, version) for name in ("tail", "known")))


def save_state(
    state: State, folder: str, batch: int, buckets: Sequence[int] | None = None,
) -> None:
    """Publish the state of a batch: its ``buckets`` (all by default) anew, the others as the newest
    earlier batch left them. Only what a repeated batch can ask for is kept. A batch whose state is
    there already has been here before."""
    table = _states(state.known.sparkSession, folder)
    versions = table.versions()
    if batch not in versions:
        base = max((v for v in versions if v < batch), default=None)
        chosen = list(range(BUCKETS)) if buckets is None else list(buckets)
        table.commit({name: df.withColumn("bucket", bucket()).filter(F.col("bucket").isin(chosen))
                      for name, df in (("tail", state.tail), ("known", state.known))},
                     "bucket", chosen, base, batch)
    table.vacuum(2)


def latest_rows(rows: DataFrame) -> DataFrame:
    """One row per ``(symbol, time)`` of a written result, from the newest ``batch``."""
    newest = rows.groupBy("symbol", "time").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["symbol", "time", "batch"], "left_semi").drop("batch")


def start(
    bars: DataFrame, features: FeatureStream, folder: str, out: str,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Process the bars that have arrived; each batch lands in ``out/batch=<id>``, which
    ``latest_rows`` reads.

    ``then`` turns the features of a batch into what is written (scores, decisions). The query's
    checkpoint lies in ``folder`` beside the states and the bars.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        batch.select(*BAR.fieldNames()).write.mode("overwrite").parquet(
            f"{folder}/bars/arrival={batch_id}")
        arrived = spark.read.schema(BAR).parquet(f"{folder}/bars/arrival={batch_id}")
        buckets = [r[0] for r in arrived.select(bucket()).distinct().collect()]
        before = load_state(spark, f"{folder}/state", batch_id, buckets)
        stored = None if before is None else spark.read.schema(
            T.StructType([*BAR.fields, T.StructField("arrival", T.LongType())])).parquet(
            f"{folder}/bars").filter(F.col("arrival") < batch_id)
        with scratch(spark):
            rows, state = features.follow(arrived, stored, before)
            result = then(rows) if then else rows
            result.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            save_state(state, f"{folder}/state", batch_id, buckets)

    return bars.writeStream.foreachBatch(one).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
