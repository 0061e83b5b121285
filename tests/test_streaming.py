"""Micro-batches give what one batch gives."""

from pyspark.sql import functions as F

from tickloom.plans.features import feature_table
from tickloom.sources.bars import build_bars
from tickloom.streaming import bars as SB
from tickloom.streaming import features as SF
from tickloom.streaming import partial_bars as SP

COLUMNS = ["ema_50", "rsi_lag_10", "macd_histogram_slope", "adx", "obv", "cmf", "fib_382"]


def closes(n):
    return [100 + (i * 37 % 23) + (i % 5) / 4 for i in range(n)]


def test_running_features_equal_batch(spark, make_bars, tmp_path):
    bars = make_bars({"A": closes(260), "B": closes(150)})
    want = feature_table(bars, COLUMNS, "as_of").orderBy("symbol", "time").toPandas()
    feed, out, work = (str(tmp_path / x) for x in ("feed", "out", "work"))
    # 64-row chunks are too small for the frames: the second batch spans several 128-row chunks.
    features = SF.FeatureStream(COLUMNS, chunk_rows=128)
    parts = [bars.filter("hour(time) + 24 * dayofyear(time) < 60"),
             bars.filter("hour(time) + 24 * dayofyear(time) >= 60 AND symbol = 'A'"),
             bars.filter("hour(time) + 24 * dayofyear(time) >= 60 AND symbol = 'B'")]
    for part in parts:
        part.write.mode("append").parquet(feed)
        source = spark.readStream.schema(bars.schema).parquet(feed)
        SF.start(source, features, work, out).awaitTermination()
    got = spark.read.parquet(out).orderBy("symbol", "time").toPandas()
    assert len(got) == len(want)
    for name in COLUMNS:
        assert ((got[name] - want[name]).abs().fillna(0) < 1e-8).all(), name
        assert (got[name].isna() == want[name].isna()).all(), name


def test_a_repeated_batch_changes_nothing(spark, make_bars, tmp_path):
    bars = make_bars({"A": closes(80)})
    features, folder = SF.FeatureStream(["ema_20", "obv"]), str(tmp_path / "state")
    _, state = features.advance(bars.filter("hour(time) < 12"), None)
    SF.save_state(state, folder, 3)
    rows = []
    for _ in range(2):
        found = SF.load_state(spark, folder, before=4)
        out, state = features.advance(bars.filter("hour(time) >= 12"), found)
        SF.save_state(state, folder, 4)
        rows.append(sorted(out.collect()))
    assert rows[0] == rows[1] and SF.load_state(spark, folder, before=3) is None


def test_a_batch_writes_the_buckets_of_its_symbols(spark, make_bars, tmp_path):
    folder, out, feed = (str(tmp_path / x) for x in ("work", "out", "feed"))
    bars = make_bars({s: closes(40) for s in "ABCDEF"}).cache()
    features = SF.FeatureStream(["ema_20"])
    for part in (bars.filter("hour(time) < 12"), bars.filter("hour(time) >= 12 AND symbol = 'C'")):
        part.write.mode("append").parquet(feed)
        source = spark.readStream.schema(bars.schema).parquet(feed)
        SF.start(source, features, folder, out).awaitTermination()
    table = SF._states(spark, f"{folder}/state")
    old, new = (table.manifest(v) for v in table.versions())
    own = spark.createDataFrame([("C",)], "symbol string").select(SF.bucket()).first()[0]
    assert {k for k in new if new[k] != old[k]} == {f"tail/{own}", f"known/{own}"}
    state = SF.load_state(spark, f"{folder}/state", 99)
    assert {r["symbol"]: r["_next"] for r in state.known.collect()} == {
        s: 40 if s == "C" else 24 for s in "ABCDEF"}
    # a writer that dies before it publishes leaves the state as it was
    table.commit({"tail": state.tail.withColumn("bucket", SF.bucket()),
                  "known": state.known.limit(0).withColumn("bucket", SF.bucket())},
                 "bucket", range(SF.BUCKETS), table.versions()[-1], 50, publish=False)
    assert SF.load_state(spark, f"{folder}/state", 99).known.count() == 6


def test_a_batch_leaves_no_intermediates(spark, make_bars, tmp_path, monkeypatch):
    from tickloom import session
    written = []
    path = session.work_path
    monkeypatch.setattr(session, "work_path", lambda s, n: written.append(path(s, n)) or written[-1])
    bars = make_bars({"A": closes(40)})
    feed = str(tmp_path / "feed")
    bars.write.parquet(feed)
    SF.start(spark.readStream.schema(bars.schema).parquet(feed), SF.FeatureStream(["ema_20"]),
             str(tmp_path / "work"), str(tmp_path / "out")).awaitTermination()
    assert written
    import os
    assert not any(os.path.exists(p.removeprefix("file:")) for p in written)


def test_late_repeated_and_corrected_bars(spark, make_bars):
    bars = make_bars({"A": closes(60), "B": closes(30)}).cache()
    hour = "hour(time) + 24 * (dayofyear(time) - 1)"
    features, names = SF.FeatureStream(["ema_10", "obv"]), ["symbol", "time", "ema_10", "obv"]
    wrong = bars.filter(f"symbol = 'A' AND {hour} = 7").withColumn("close", F.lit(1.0))
    first = bars.filter(f"{hour} < 20 AND NOT (symbol = 'A' AND {hour} IN (5, 7))").unionByName(wrong)
    second = bars.filter(f"{hour} < 25 AND NOT (symbol = 'B' AND {hour} < 18)")
    _, state = features.follow(first, None, None)
    rows, state = features.follow(second, first.withColumn("arrival", F.lit(0)), state)
    want = {tuple(r) for r in feature_table(bars, ["ema_10", "obv"], "as_of").select(*names).collect()}
    got = {tuple(r) for r in rows.select(*names).collect()}
    # A from the first changed bar on; B only what is new, its repeats are dropped.
    expected = {r for r in want if (r[0] == "A" and 5 <= r[1].hour + 24 * (r[1].day - 1) < 25)
                or (r[0] == "B" and 20 <= r[1].hour + 24 * (r[1].day - 1) < 25)}
    assert {(s, t) for s, t, *_ in got} == {(s, t) for s, t, *_ in expected}
    near = {(s, t): v for s, t, *v in expected}
    assert all(abs(x - y) < 1e-8 for s, t, *v in got for x, y in zip(v, near[s, t]))
    assert {r["symbol"]: r["_next"] for r in state.known.collect()} == {"A": 25, "B": 25}


def test_closed_bars_equal_batch(spark, tmp_path):
    ticks = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("symbol"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 7)).alias("ts"),
        F.col("id").alias("seq"), (F.col("id") * 13 % 50).cast("double").alias("price"),
        (F.col("id") % 9).cast("int").alias("spread"))
    feed, out, check = (str(tmp_path / x) for x in ("feed", "out", "check"))
    for part in (ticks.filter("seq < 200"), ticks.filter("seq >= 200")):
        part.write.mode("append").parquet(feed)
        source = spark.readStream.schema(ticks.schema).parquet(feed)
        SB.to_parquet(SB.stream_bars(source), out, check).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in build_bars(ticks).select(
        "symbol", "time", "open", "high", "low", "close", "tick_volume", "spread").collect()}
    assert got <= want and len(want - got) <= 6


def test_live_bars_take_late_ticks_once(spark, tmp_path):
    ticks = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("symbol"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 37)).alias("ts"),
        F.col("id").alias("seq"), (F.col("id") * 13 % 50).cast("double").alias("price"),
        (F.col("id") % 9).cast("int").alias("spread"))
    live = SP.LiveBars(spark, str(tmp_path / "live"))
    late = F.col("seq") % 4 == 0
    live.add(ticks.filter(~late), 3)
    before = live.table.manifest(3)
    for _ in range(2):                          # a repeated batch counts once
        live.add(ticks.filter(late & (F.col("seq") < 100)), 5)
    live.add(ticks.limit(0), 6)
    after = live.table.manifest(5)
    assert any(before[k] == after[k] for k in before) and any(before[k] != after[k] for k in before)
    live.add(ticks.filter(late & (F.col("seq") >= 100)), 7)
    names = ["symbol", "time", "open", "high", "low", "close", "tick_volume", "spread"]
    got, want = ({tuple(r) for r in df.select(*names).collect()} for df in (live.read(), build_bars(ticks)))
    assert got == want
