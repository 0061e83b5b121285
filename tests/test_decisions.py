"""Rules, verdicts, decisions, as-of answers, appends and the stacked model."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tickloom.catalog.queries import logit_scorer
from tickloom.operators import decide as D
from tickloom.operators import rules as G
from tickloom.operators import scoring as S
from tickloom.operators.asof import as_of_join
from tickloom.operators.blocks import index_rows
from tickloom.plans import decision as P
from tickloom.plans.features import feature_table
from tickloom.plans.presets import PRESETS, Rule, StrategyConfig, rules_frame
from tickloom.schema import require_columns
from tickloom.sources import bars as B

NTZ = "symbol string, datetime timestamp_ntz, class0_{0} double, class1_{0} double, confir_{0} string"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


def test_decision_table(spark):
    verdicts = ("confirm", "not_strong", "below_threshold", "odd")
    pairs = list(itertools.product(verdicts, verdicts))
    rows = spark.createDataFrame(pairs, "b string, s string").select(
        "b", "s", D.decision(F.col("b"), F.col("s")).alias("d")).collect()
    for r in rows:
        if "odd" in (r["b"], r["s"]):
            want = "unknown"
        elif r["b"] == r["s"] == "confirm":
            want = "indecision"
        else:
            want = "buy" if r["b"] == "confirm" else "sell" if r["s"] == "confirm" else "do_nothing"
        assert r["d"] == want


def test_verdict_join_fans_out(spark):
    buy = spark.createDataFrame([("A", at(0), .4, .6, "confirm"), ("A", at(0), .3, .7, "confirm"),
                                 ("A", at(1), .5, .5, "confirm")], NTZ.format("buy"))
    sell = spark.createDataFrame([("A", at(0), .4, .6, "not_strong")], NTZ.format("sell"))
    joined = D.final_decision(D.verdict_join(buy, sell)).collect()
    assert [r["final_decision"] for r in joined] == ["buy", "buy"]


def test_gate_takes_either_class(spark):
    row = spark.createDataFrame([(0.7, 0.3), (0.3, 0.7), (0.5, 0.5), (None, None)],
                                "p0 double, p1 double").select(
        G.confidence_gate(F.col("p0"), F.col("p1"), 0.7).alias("g")).collect()
    assert [r["g"] for r in row] == [True, True, False, False]


def test_votes_bounds_and_missing(spark):
    df = spark.createDataFrame(
        [("A", at(0), 1.0, None), ("A", at(1), 2.0, 5.0), ("A", at(2), 2.1, 6.0)],
        "symbol string, time timestamp_ntz, x double, y double")
    config = StrategyConfig("s", "buy", "A", 0.5, 1, (Rule("x", 1.0, 2.0), Rule("y", None, 5.0)))
    wide = G.rule_votes_wide(df, [config]).orderBy("time").collect()
    long = G.rule_votes_long(df, rules_frame(spark, config)).orderBy("time").collect()
    assert [r["votes"] for r in wide] == [1, 2, 0] == [r["votes"] for r in long]


def test_presets_are_complete():
    from tickloom.operators.indicators import COLUMNS
    for preset in PRESETS:
        assert set(preset.features) <= {*COLUMNS, "tick_volume"}
        assert preset.meta.count("zero_pred_0") == 1 and preset.base_a.count("bb_width") == 2
        assert 0.5 < preset.threshold < 1 and preset.min_votes <= len(preset.rules)


def test_presets_run_on_their_pairs(make_bars):
    bars = make_bars({"EURUSD": [1.1 + (i % 13) / 1000 for i in range(130)]})
    def scorer(features, config, prefix):
        return S.stacked_logit(features, {"rsi_lag_5": .01}, {"rsi_lag_10": .01},
                               {"zero_pred_1": 3.0}, prefix)
    buy, sell = PRESETS[1], PRESETS[0]
    out = P.decide(bars, buy, sell, scorer).collect()
    assert len(out) == 130
    assert {r["final_decision"] for r in out} <= {"buy", "sell", "do_nothing", "indecision"}


def test_service_actions(spark):
    cases = [("SELL", "BUY", "INDIRECTION", "INDIRECTION"), ("HOLD", "HOLD", "HOLD", "HOLD"),
             ("", "", "", ""), ("SELL", "", "SELL", "SELL"), ("", "BUY", "BUY", "BUY"),
             ("SELL", "not_strong", "", "SELL"), ("below_threshold", "BUY", "", "BUY"),
             ("not_strong", "below_threshold", "", "")]
    df = spark.createDataFrame(cases, "s string, b string, v1 string, v2 string")
    for r in df.select("*", D.service_action_v1(F.col("s"), F.col("b")).alias("a1"),
                       D.service_action(F.col("s"), F.col("b")).alias("a2")).collect():
        assert (r["a1"], r["a2"]) == (r["v1"], r["v2"])


def test_stale_and_invalid_rows_are_dropped(spark):
    now = "2024-01-01 05:00:00"
    rows = [(at(4, 1), "eur / usd", "buy", .9), (at(4), "EUR/USD", "buy", .9),
            (at(4, 30), "EURUSD", "sell", .9), (at(4, 30), "usd/jpy", "do_nothing", .9)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, currency_pair string, "
                                     "final_decision string, confidence_score double")
    assert [r["currency_pair"] for r in D.review_candidates(df, now).collect()] == ["EUR/USD"]
    with pytest.raises(ValueError, match="confidence_score"):
        require_columns(df.drop("confidence_score"), ["timestamp", "confidence_score"])


def test_as_of_against_brute_force(spark):
    bars = [("A", at(h), h) for h in (0, 1, 5, 40, 41, 200)] + [("B", at(h), h) for h in (3, 90)]
    asked = [(i, s, at(h, m)) for i, (s, h, m) in enumerate(itertools.product(
        "ABC", (0, 1, 4, 39, 64, 65, 199, 200, 5000), (0, 59)))] + [(999, "A", at(-1))]
    series = spark.createDataFrame(bars, "symbol string, t timestamp_ntz, v int")
    requests = spark.createDataFrame(asked, "id int, symbol string, q timestamp_ntz")
    got = {r["id"]: r["v"] for r in as_of_join(requests, series, "t", "q", ["v"]).collect()}
    assert len(got) == len(asked)
    for i, s, q in asked:
        earlier = [v for symbol, t, v in bars if symbol == s and t <= q]
        assert got[i] == (max(earlier) if earlier else None)


def test_requests_equal_a_recompute(spark, make_bars):
    bars = make_bars({"click": [100 + (i * 37 % 23) for i in range(140)]})
    sides = [StrategyConfig("Events", s, "click", .5, 1, (Rule("rsi", 40.0), Rule("obv", 0.0)),
                            service_votes=2, aliases=("Events",)) for s in ("sell", "buy")]
    extra = ("z_score", "rsi_overbought", "rsi_oversold", "volume_imbalance", "trend", "stochastic_k")
    answers = P.service_answers(bars, sides[1], sides[0], logit_scorer, extra)
    asked = [(0, "Events_x", at(50, 30)), (1, "Events", at(139)), (2, "Other", at(50)),
             (3, "Events", at(-5))]
    answers = answers.withColumn("strategy", F.lit("Events"))
    requests = spark.createDataFrame(asked, "id int, strategy string, to_time timestamp_ntz")
    got = {r["id"]: r for r in P.decisions_as_of(requests, answers, sides).collect()}
    assert got[2]["action"] == "NO_STRG" and got[3]["action"] is None
    for i, moment in ((0, at(50, 30)), (1, at(139))):
        cut = B.until(bars, str(moment))
        names = P.needed_features(*sides, extra=extra)
        last = D.latest(feature_table(cut, names, "history"), "time")
        want = P.answer_rows(last, sides[1], sides[0], logit_scorer).first()
        assert got[i]["action"] == want["action"] and got[i]["bar_time"] == want["time"]


def test_sides_of_a_strategy_belong_together(make_bars):
    bars = make_bars({"A": [100, 101, 102]})
    buy = StrategyConfig("one", "buy", "A", .5, 0, (Rule("rsi"),))
    with pytest.raises(ValueError, match="no strategy"):
        P.strategy_decisions(bars, [], logit_scorer)
    with pytest.raises(ValueError, match="different strategies"):
        P.strategy_decisions(bars, [(buy, StrategyConfig("two", "sell", "A", .5, 0, ()))], logit_scorer)
    sell = StrategyConfig("one", "sell", "A", .5, 0, ())
    with pytest.raises(ValueError, match="must differ"):
        P.strategy_decisions(bars, [(buy, sell), (buy, sell)], logit_scorer)


def test_minute_bars_keep_blocks_short(spark):
    moments = [(i, "A", at(0) + dt.timedelta(minutes=i)) for i in range(300)]
    series = spark.createDataFrame([(s, t, i) for i, s, t in moments],
                                   "symbol string, t timestamp_ntz, v int")
    requests = spark.createDataFrame(moments, "id int, symbol string, q timestamp_ntz")
    found = as_of_join(requests, series, "t", "q", ["v"], bar_seconds=60)
    assert all(r["v"] == r["id"] for r in found.collect())
    indexed = index_rows(series.withColumnRenamed("t", "time"), 64, 60).frame
    assert sorted(r["_i"] for r in indexed.collect()) == list(range(300))


def test_appending_sorts_nothing(spark, make_bars):
    bars = make_bars({"A": [100, 101, 102]})
    plan = B.append_bars(bars, bars)._jdf.queryExecution().executedPlan().toString()
    newest = D.latest(bars, "time")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan + newest and "HashAggregate" in plan


def test_append_keeps_the_newest(make_bars):
    bars = make_bars({"A": [1.0, 2.0, 3.0]})
    new = bars.limit(1).withColumn("close", F.lit(9.0)).withColumn("arrival", F.lit(2))
    older = bars.limit(1).withColumn("close", F.lit(8.0)).withColumn("arrival", F.lit(1))
    merged = B.append_bars(bars, new.unionByName(older)).orderBy("time").collect()
    assert [r["close"] for r in merged] == [9.0, 2.0, 3.0]


def test_csv_export_and_snapshot(spark, make_bars, tmp_path):
    bars = make_bars({"A": [1.0, 2.0, 3.0]})
    path = str(tmp_path / "csv")
    bars.drop("symbol").withColumn("real_volume", F.lit(0)).write.option("header", True).csv(path)
    back = B.read_export(spark, path, "A")
    assert sorted(back.collect()) == sorted(bars.collect())
    B.write_snapshot(bars, str(tmp_path / "p"), "csv")
    B.append_rows(bars, str(tmp_path / "p"), "csv")
    assert B.read_bars(spark, str(tmp_path / "p"), "csv").count() == 6
    assert B.extract(bars, "A", at(1), at(1)).count() == 1


def test_stack_learns_and_reloads(spark, tmp_path):
    rows = [(float(i % 10), float((i * 7) % 5), int(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    model = S.fit_stack(df, "label", ["x", "x"], ["x", "y"], ["y", *S.PROBABILITIES], trees=2, depth=2)
    model.save(str(tmp_path / "m"))
    out = S.StackedModel.load(str(tmp_path / "m")).transform(df, "up")
    assert out.count() == 200
    assert out.filter("(up_p1 > 0.5) <> (label = 1)").count() == 0
    assert out.filter("abs(up_p0 + up_p1 - 1) > 1e-9").count() == 0
    assert model.base_scores(df).columns == ["x", "y", "label", *S.PROBABILITIES]


def test_bars_order_ticks_by_time_then_number(spark):
    rows = [("A", at(0, 1), 5, 1.0, 7), ("A", at(0, 1), -9, 2.0, 8), ("A", at(0, 59), 2**62, 3.0, 9),
            ("A", at(0, 59), -2**62, 4.0, 6), ("A", at(1), 0, 5.0, 5)]
    ticks = spark.createDataFrame(
        rows, "symbol string, ts timestamp_ntz, seq long, price double, spread int")
    first, second = B.build_bars(ticks).orderBy("time").collect()
    assert (first["open"], first["close"], first["spread"], first["tick_volume"]) == (2.0, 3.0, 9, 4)
    assert (first["high"], first["low"], second["open"]) == (4.0, 1.0, 5.0)
    plan = B.build_bars(ticks)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_bitmap_votes_equal_the_joined_ones(spark, monkeypatch):
    import random

    from tickloom.operators import rules as G
    monkeypatch.setattr(G, "BOOK", 7)
    monkeypatch.setattr(G, "BARS", 3)
    rng = random.Random(9)
    values = [None, 0.0, 1.0, 1.5, 2.0, 3.0, -4.0]
    bars = [(s, dt.datetime(2024, 1, 1, h), rng.choice(values), rng.choice(values), h % 3)
            for s in "AB" for h in range(20)]
    features = spark.createDataFrame(bars, "symbol string, time timestamp_ntz, x double, y double, z int")
    rows = [(f"s{rng.randrange(6)}", rng.choice(["buy", "sell"]), rng.choice("xyz"),
             rng.choice(values), rng.choice(values), 1, 0.5) for _ in range(60)]
    rules = spark.createDataFrame(rows, "strategy string, side string, feature string, lo double, "
                                        "hi double, min_votes long, threshold double")
    got, want = (sorted(map(tuple, f(features, rules).collect()))
                 for f in (G.rule_votes_bitmaps, G.rule_votes_long))
    assert got == want and len(got) == 40 * len({r[:2] for r in rows})
    assert G.rule_votes_bitmaps(features, rules.limit(0)).count() == 0


def test_more_rules_than_a_driver_should_hold(spark):
    from pyspark.sql import functions as F

    from tickloom.operators import rules as G
    features = spark.createDataFrame(
        [("A", at(0), 0.0, 7.0), ("A", at(1), None, -1.0), ("B", at(0), 500.5, 1e9)],
        "symbol string, time timestamp_ntz, x double, y double")
    n = 1_000_200
    rules = spark.range(n).select(
        F.concat(F.lit("s"), F.col("id") % 900).alias("strategy"), F.lit("buy").alias("side"),
        F.when(F.col("id") < n // 2, "x").otherwise("y").alias("feature"),
        (F.col("id") % 1000).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    votes = G.rule_votes_bitmaps(features, rules)
    got = {(r["symbol"], r["time"]): (r["strategies"], r["votes"]) for r in votes.groupBy(
        "symbol", "time").agg(F.count(F.lit(1)).alias("strategies"), F.sum("votes").alias("votes")).collect()}
    rest = [sum(i % 1000 <= v for i in span) for span, v in (
        (range(n // 2), 0), (range(n // 2, n), 7), (range(n // 2), 500))]
    assert got == {("A", at(0)): (900, rest[0] + rest[1]), ("A", at(1)): (900, 0),
                   ("B", at(0)): (900, rest[2] + n - n // 2)}


def test_votes_combined_in_tasks_equal_the_sums_of_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tickloom.operators import rules as G
    monkeypatch.setattr(G, "BOOK", 3)
    monkeypatch.setattr(G, "BARS", 2)
    features = spark.createDataFrame(
        [(s, at(h), None if h == 4 else h / 2, float(-h)) for s in "AB" for h in range(9)],
        "symbol string, time timestamp_ntz, x double, y double")
    rules = spark.createDataFrame(
        [(None if k == 3 else f"s{k}", "buy" if k % 2 else None, f, lo, lo + k) for k in range(5)
         for f, lo in (("x", 0.5), ("x", 2.0), ("y", -6.0))],
        "strategy string, side string, feature string, lo double, hi double")
    want = G.rule_votes_bitmaps(features, rules).groupBy("strategy", "side").agg(
        F.count(F.lit(1)), F.sum("votes"), F.max("votes"), F.count_if(F.col("votes") >= 2))
    got = G.rule_votes_bitmaps(features, rules, strong=2).groupBy("strategy", "side").agg(
        F.sum("bars"), F.sum("votes"), F.max("most"), F.sum("strong"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 5
