"""Answers from the middle of a series equal the full recompute and read few bars."""

from pyspark.sql import functions as F

from tickloom.operators.asof import as_of_join
from tickloom.plans import restart
from tickloom.plans.features import feature_table
from tickloom.plans.restart import FeatureIndex

COLUMNS = ["ema_50", "rsi_lag_10", "macd_histogram_slope", "adx", "obv", "atr", "fib_382"]


def closes(n):
    return [100 + (i * 37 % 23) + (i % 5) / 4 for i in range(n)]


def test_answers_equal_the_full_recompute(spark, make_bars, tmp_path):
    bars = make_bars({"A": closes(900), "B": closes(300), "C": closes(3)}).cache()
    asked = [("A", h) for h in (-1, 0, 7, 127, 128, 129, 400, 401, 899, 2000)]
    asked += [("B", 299), ("B", 130), ("C", 1), ("D", 5), (None, 5), ("A", 400)]
    requests = spark.createDataFrame([(i, s, h) for i, (s, h) in enumerate(asked)],
                                     "request_id long, symbol string, h long").select(
        "request_id", "symbol", (F.lit("2024-01-01").cast("timestamp_ntz")
                                 + F.make_dt_interval(hours=F.col("h"), mins=F.lit(20))).alias("to_time"))
    index = FeatureIndex(spark, str(tmp_path / "index"), COLUMNS, chunk_rows=128)
    index.build(bars)
    got = index.answers(requests).orderBy("request_id").toPandas()
    full = feature_table(bars, COLUMNS, "as_of").withColumn("bar_time", F.col("time"))
    want = as_of_join(requests, full, "time", "to_time", ["bar_time", *COLUMNS]).orderBy(
        "request_id").toPandas()
    assert len(got) == len(asked) and (got.bar_time.isna() == want.bar_time.isna()).all()
    assert (got.bar_time.dropna() == want.bar_time.dropna()).all()
    for name in COLUMNS:
        assert (got[name].isna() == want[name].isna()).all(), name
        assert ((got[name] - want[name]).abs().fillna(0) < 1e-8).all(), name


def test_a_question_reads_two_chunks_at_most(spark, make_bars, tmp_path, monkeypatch):
    monkeypatch.setattr(restart, "SPAN", 2)
    bars = make_bars({"A": closes(5000), "B": closes(400)})
    index = FeatureIndex(spark, str(tmp_path / "index"), ["ema_50", "obv"], chunk_rows=128)
    index.build(bars)
    requests = spark.createDataFrame([(1, "A", 4100)], "request_id long, symbol string, h long").select(
        "symbol", (F.lit("2024-01-01").cast("timestamp_ntz")
                   + F.make_dt_interval(hours=F.col("h"))).alias("to_time"))
    pieces, marks = index.pieces(index.starts(requests, "to_time"), "to_time")
    assert pieces.count() <= 128 + index.features.plan.back and marks.count() == 1
    read, every = ([f for f in df.inputFiles() if "/parts/bars-" in f]
                   for df in (pieces, index.table.read("bars")))
    assert 1 <= len(read) <= 2 and len(every) > 20
    assert index.answers(requests).count() == 1
