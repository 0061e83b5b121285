"""Registered queries: every operator run over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.numeric import pdiv, rounded
from tickloom.operators import decide as D
from tickloom.operators import indicators as I
from tickloom.operators import responses as T
from tickloom.operators import rolling as R
from tickloom.operators import rules as G
from tickloom.operators import scoring as S
from tickloom.operators import trees as TR
from tickloom.operators.blocks import exclusive_prefix, index_rows, spread
from tickloom.operators.fill import fill, fill_backward
from tickloom.operators.indicators import COLUMNS, row, win
from tickloom.plans import decision as P
from tickloom.plans.features import feature_table
from tickloom.plans.restart import FeatureIndex
from tickloom.plans.presets import (
    EURUSD_BUY, EURUSD_SELL, Rule, StrategyConfig, rules_frame,
)
from tickloom.session import materialise, work_path
from tickloom.sources import bars as B
from tickloom.sources.barstore import BarStore
from tickloom.sources import logs as L
from tickloom.streaming import bars as SB
from tickloom.streaming import features as SF
from tickloom.streaming import logs as SL
from tickloom.streaming import partial_bars as SP
from tickloom.streaming import requests as SQ
from tickloom.streaming import upserts as SU

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, label: str) -> str:
    return work_path(spark, label)


# --- inputs ----------------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("spread"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"),
        (F.col("o_custkey") % 50).cast("int").alias("spread"))


def _stored(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Bars are a table of the pipeline: each query builds it from the ticks, then scans it."""
    return materialise(build(), f"bars-{kind}")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "events", lambda: B.build_bars(event_ticks(spark, sf_dir)))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars; series longer than one chunk already at small scale."""
    return _stored(spark, sf_dir, "orders",
                   lambda: B.build_bars(order_ticks(spark, sf_dir), "day"))


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers widened: comparable across engines."""
    def column(name: str, kind: str):
        if kind == "double":
            return rounded(F.col(name), digits).alias(name)
        if kind in ("int", "bigint"):
            return F.col(name).cast("long").alias(name)
        return F.col(name)
    return df.select(*[column(n, k) for n, k in df.dtypes])


# Running values of order totals have eleven significant digits in common between engines.
ORDER_RUNNING_DIGITS = 4
# With four, averages of prices in cents would end on a half, which engines round either way.
ORDER_TABLE_DIGITS = 5


def indicator(columns: tuple[str, ...], bars: Query = event_bars, digits: int = 6, **kw) -> Query:
    seconds = 86400 if bars is order_bars else 3600

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = feature_table(bars(spark, sf_dir), list(columns), kw.get("view", "raw"),
                            kw.get("families"), bar_seconds=seconds)
        return shown(out.select("symbol", "time", *columns), digits)
    return run


# --- indicator queries -----------------------------------------------------------------------

LAG_COLUMNS = tuple(c for c in COLUMNS if "_lag_" in c)

FINITE = {
    "date_parts": ("day", "month", "year"),
    "lag_features": LAG_COLUMNS,
    "momentum": ("momentum",),
    "clip_momentum": ("negative_momentum", "positive_momentum"),
    "price_change": ("price_change_1", "price_change_5", "price_change_10", "roc_10", "returns"),
    "ichimoku": ("ichimoku_conversion", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b",
                 "ichimoku_lagging"),
    "ichimoku_flags": ("ichimoku_distance", "ichimoku_bearish", "ichimoku_bullish"),
    "fib_levels": ("fib_236", "fib_382", "fib_618"),
    "moving_averages": ("ma_10", "ma_20", "ma_50", "sma_20"),
    "rolling_std": ("close_std_10", "close_std_20", "close_std_50", "return_std_20"),
    "rolling_extrema": ("support_level", "resistance_level", "ichimoku_conversion"),
    "keltner": ("keltner_upper", "keltner_lower"),
    "price_cluster": ("price_cluster",),
    "support_strength": ("support_strength", "resistance_strength"),
    "rsi": ("rsi",),
    "bollinger": ("bb_middle", "bb_std", "bb_upper", "bb_lower", "bb_width", "bb_bounce_buy"),
    "stochastic": ("stochastic_k", "stochastic_d"),
    "true_range": ("true_range",),
    "atr_sma": ("atr_sma",),
    "williams_r": ("williams_r",),
    "cci": ("cci",),
    "pivot_points": ("pivot", "r1", "s1"),
    "volume_ratio": ("volume_ma", "volume_ratio", "tick_volume_ma", "tick_volume_ratio",
                     "high_volume_zone"),
    "up_counts": ("price_up", "volume_up"),
    "heikin_ashi": ("ha_close", "ha_open", "ha_high", "ha_low"),
    "volume_oscillator": ("volume_oscillator",),
    "cmf": ("cmf",),
    "signal_flags": ("rsi_overbought", "rsi_oversold", "bb_bounce_buy"),
    "candle_shape": ("price_range", "body_size", "direction", "volatility"),
    "spread_stats": ("spread_ratio", "spread_ma", "spread_volatility"),
    "price_impact": ("tick_price_impact",),
    "support_resistance": ("support_level", "resistance_level"),
    "trend": ("sma_20", "trend"),
    "z_score": ("z_score",),
    "order_flow": ("buy_volume", "sell_volume", "volume_imbalance"),
    "liquidity_index": ("liquidity_index",),
}

RUNNING = {
    "ema": ("ema_10", "ema_12", "ema_20", "ema_26", "ema_50"),
    "atr_wilder": ("atr",),
    "obv": ("obv",),
    "macd": ("macd", "macd_signal", "macd_histogram", "macd_histogram_slope"),
    "macd_cross": ("macd_bullish_cross",),
    "adx": ("adx",),
    "risk_reward": ("stop_loss", "risk_reward_ratio"),
}

# The same operators on daily order bars, whose series span several chunks.
DAILY_FINITE = {
    "daily_rsi": ("rsi", "rsi_lag_10"),
    "daily_ichimoku": FINITE["ichimoku"],
    "daily_fib_levels": FINITE["fib_levels"],
    "daily_price_cluster": FINITE["price_cluster"],
    "daily_support_strength": FINITE["support_strength"],
    "daily_cmf": FINITE["cmf"],
    "daily_liquidity_index": FINITE["liquidity_index"],
}
DAILY_RUNNING = {
    "daily_ema": RUNNING["ema"],
    "daily_obv": ("obv", "atr"),
    "daily_adx_macd": ("adx", "macd_signal", "macd_histogram_slope"),
}

ROLLING_SUMS = ("volume_sum_20", "flow_sum_20", "price_up")


def rolling_sums(spark, sf_dir):
    family = [*I.money_flow(), *I.up_counts(),
              row("volume_sum_20", "_volume_sum", "double(_volume_sum)"),
              row("flow_sum_20", "_flow_sum", "_flow_sum")]
    return indicator(ROLLING_SUMS, families=[family])(spark, sf_dir)


def ewm_adjusted(spark, sf_dir):
    """Adjusted mean over an input with interior gaps (money flow of flat bars is missing)."""
    family = [*I.money_flow(), *I.ewm_adjusted("flow_ewm", "_flow", 14),
              *I.adx()]
    return indicator(("flow_ewm", "_up_avg", "_down_avg"), families=[family])(
        spark, sf_dir).withColumnsRenamed({"_up_avg": "dm_up_ewm", "_down_avg": "dm_down_ewm"})


def fill_query(backward_only: bool) -> Query:
    def run(spark, sf_dir):
        bars = order_bars(spark, sf_dir)
        # Missing on every third customer slot: gaps at heads, inside and at ends.
        gappy = bars.withColumn("gappy", F.when(F.col("spread") % 3 != 0, F.col("close")))
        series = index_rows(gappy, bar_seconds=86400, reuse=True)
        own = spread(series, 0)
        if backward_only:
            out = fill_backward(own, ["gappy"])
        else:
            out = fill(own, ["gappy"], False)
        return shown(out.select("symbol", "time", "gappy"))
    return run


def holed_bars(spark, sf_dir) -> DataFrame:
    """Daily bars of which some lack the close, the first days the high or the low, and two symbols
    a whole bar later on."""
    bars = order_bars(spark, sf_dir)
    day = F.to_date("time")
    early = (day < F.lit("1992-01-20").cast("date")) & (F.col("tick_volume") % 2 == 0)
    gone = (F.substring("symbol", 1, 1).isin("2", "4")) & (day == F.lit("1996-07-01").cast("date"))
    return bars.withColumns({
        "high": F.when(~early & ~gone, F.col("high")), "low": F.when(~early & ~gone, F.col("low")),
        "close": F.when((F.col("spread") % 3 != 0) & ~early & ~gone, F.col("close"))})


EMA_GAPPY = ("ema_10", "ema_20", "ema_50", "macd", "macd_signal")


def ema_gappy(spark, sf_dir):
    out = feature_table(holed_bars(spark, sf_dir), list(EMA_GAPPY), "raw", bar_seconds=86400,
                        gaps=True)
    return shown(out.select("symbol", "time", *EMA_GAPPY), ORDER_RUNNING_DIGITS)


def atr_gappy(spark, sf_dir):
    out = feature_table(holed_bars(spark, sf_dir), ["true_range", "atr"], "raw",
                        bar_seconds=86400, gaps=True)
    return shown(out.select("symbol", "time", "true_range", "atr"), ORDER_RUNNING_DIGITS)


def full_table(view: str, bars: Query = event_bars, digits: int = 6) -> Query:
    return indicator(COLUMNS, bars, digits, view=view)


PREFIX_FAN = 16


def prefix_groups(spark, sf_dir):
    """Bars and last known close before each day, prefixed over many small groups of days."""
    days = order_bars(spark, sf_dir).select(
        "symbol", F.unix_date(F.col("time").cast("date")).cast("long").alias("day"),
        F.col("tick_volume").alias("bars_before"),
        F.when(F.col("spread") % 3 != 0, F.col("close")).alias("close_before"))
    return shown(exclusive_prefix(days, "day", ["bars_before"], ["close_before"], PREFIX_FAN))


# --- sources and sinks -----------------------------------------------------------------------

def scan_bars(spark, sf_dir):
    path = _folder(spark, "scan")
    B.write_snapshot(event_bars(spark, sf_dir), path, "csv")
    return shown(B.read_bars(spark, path, "csv"))


def snapshot_roundtrip(spark, sf_dir):
    path = _folder(spark, "snapshot")
    bars = event_bars(spark, sf_dir)
    B.write_snapshot(bars, path)
    B.write_snapshot(bars.filter("tick_volume > 1"), path)
    B.append_rows(bars.filter("tick_volume = 1"), path)
    return shown(B.read_bars(spark, path))


def build_bars_hourly(spark, sf_dir):
    return shown(B.build_bars(event_ticks(spark, sf_dir)))


def build_bars_daily(spark, sf_dir):
    return shown(B.build_bars(order_ticks(spark, sf_dir), "day"))


def epoch_to_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", B.epoch_to_time(1704067200 + F.col("event_id") * 60).alias("time"))


def filter_since(spark, sf_dir):
    bars = B.since(event_bars(spark, sf_dir), "2024-01-10 00:00:00")
    out = feature_table(bars, ["ema_20", "obv", "ma_10"], "raw")
    return shown(out.select("symbol", "time", "ema_20", "obv", "ma_10"))


def features_as_of(spark, sf_dir):
    bars = B.until(event_bars(spark, sf_dir), "2024-01-20 12:00:00")
    out = feature_table(bars, ["rsi", "ema_50", "cmf", "ichimoku_lagging"], "history")
    return shown(out.select("symbol", "time", "rsi", "ema_50", "cmf", "ichimoku_lagging"))


def append_dedup_last(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    late = bars.filter(F.col("tick_volume") % 2 == 0).withColumn("close", F.col("close") + 1)
    return shown(B.append_bars(bars, late))


def _filled_store(spark, sf_dir) -> BarStore:
    """Bars appended in two parts, a write that failed before it was published, corrections."""
    store = BarStore(spark, _folder(spark, "bar-store"))
    bars = event_bars(spark, sf_dir)
    cut = F.lit("2024-01-12 06:00:00").cast("timestamp_ntz")
    fixed = bars.filter(F.col("tick_volume") % 2 == 0).withColumn("close", F.col("close") + 1)
    store.append(bars.filter(F.col("time") < cut))
    store.append(bars.filter(~F.coalesce(F.col("time") < cut, F.lit(False))))
    store.append(bars.withColumn("close", F.lit(0.0)), publish=False)
    store.append(fixed)
    store.vacuum()
    return store


def bar_store(spark, sf_dir):
    return shown(_filled_store(spark, sf_dir).read())


def bar_store_days(spark, sf_dir):
    return shown(_filled_store(spark, sf_dir).read(date(2024, 1, 10), date(2024, 1, 13)))


RESTART_COLUMNS = ("rsi", "ema_50", "adx", "obv", "macd_histogram_slope", "cmf")


def features_restart(spark, sf_dir):
    """Every order asks for the features of its priority's daily bars as of a day and a half later;
    answers start from the mark before their chunk."""
    index = FeatureIndex(spark, _folder(spark, "feature-index"), RESTART_COLUMNS, 256, 86400)
    index.build(order_bars(spark, sf_dir))
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("symbol"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 36 HOURS")).alias("to_time"))
    return shown(index.answers(requests), ORDER_RUNNING_DIGITS)


# --- scalar ----------------------------------------------------------------------------------

def safe_division(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    return shown(bars.select("symbol", "time", pdiv(
        F.col("close") - F.col("open"), F.col("high") - F.col("low")).alias("body_share"),
        pdiv(F.col("close"), F.col("tick_volume") - 1).alias("close_per_extra")))


def tz_projection(spark, sf_dir):
    return T.with_zones(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").select(
        "event_id", "timestamp_local", "timestamp_market")


# --- decisions -------------------------------------------------------------------------------

# Rules and weights for the event bars (the shipped presets are in FX price units).
BUY = StrategyConfig(
    name="events_h1", side="buy", symbol="click", threshold=0.6, min_votes=3, service_votes=4,
    min_volume=3, aliases=("Events",),
    rules=(Rule("rsi", 45.0, 95.0), Rule("obv", -40.0), Rule("atr", 20.0, 80.0),
           Rule("volume_ratio", 0.8), Rule("liquidity_index", None, 0.9), Rule("cmf", -0.2)))
SELL = StrategyConfig(
    name="events_h1", side="sell", symbol="click", threshold=0.55, min_votes=3, service_votes=3,
    min_volume=2, aliases=("Events",),
    rules=(Rule("rsi_lag_5", 5.0, 55.0), Rule("adx", 20.0), Rule("volume_oscillator", None, 10.0),
           Rule("price_range", 1.0, 90.0), Rule("macd_histogram_slope", None, 0.5)))

BASE_A = {"z_score": 0.4, "rsi_overbought": 0.6, "rsi_oversold": -0.6}
BASE_B = {"volume_imbalance": 0.8, "trend": 0.3}
META_BUY = {"zero_pred_1": 1.2, "one_pred_1": 1.5, "stochastic_k": 0.01}
META_SELL = {"zero_pred_0": 1.0, "one_pred_0": 1.4, "stochastic_k": -0.01}
BIAS = {"buy": -1.8, "sell": -0.7}
SCORED_ON = ("z_score", "rsi_overbought", "rsi_oversold", "volume_imbalance", "trend",
             "stochastic_k")


def logit_scorer(features: DataFrame, config: StrategyConfig, prefix: str) -> DataFrame:
    meta = META_BUY if config.side == "buy" else META_SELL
    return S.stacked_logit(features, BASE_A, BASE_B, meta, prefix, BIAS[config.side])


def stacked_logit(spark, sf_dir):
    features = feature_table(event_bars(spark, sf_dir), list(SCORED_ON), "history")
    scored = logit_scorer(logit_scorer(features, BUY, "buy"), SELL, "sell")
    return shown(scored.select("symbol", "time", "zero_pred_1", "one_pred_1", "buy_p0", "buy_p1",
                               "sell_p0", "sell_p1"))


def confidence_gate(spark, sf_dir):
    features = feature_table(event_bars(spark, sf_dir), list(SCORED_ON), "history")
    scored = logit_scorer(features, BUY, "buy")
    gate = G.confidence_gate(F.col("buy_p0"), F.col("buy_p1"), BUY.threshold)
    return scored.select("symbol", "time", gate.alias("confident"))


def _rule_features(spark, sf_dir):
    return feature_table(event_bars(spark, sf_dir), P.needed_features(BUY, SELL), "history")


def rule_votes_wide(spark, sf_dir):
    return G.rule_votes_wide(_rule_features(spark, sf_dir), [BUY, SELL])


def rule_votes_long(spark, sf_dir):
    return G.rule_votes_long(_rule_features(spark, sf_dir), rules_frame(spark, BUY, SELL))


MANY_FEATURES = ("rsi", "obv", "cmf", "volume_ratio", "z_score")
#: feature, lower bound, upper bound and the parts that have such a rule, as SQL over part.
MANY_RULES = (
    ("rsi", "p_size + 10", "p_size + 60", "true"),
    ("obv", "CAST(NULL AS DOUBLE)", "(p_partkey % 37) * 20 - 300", "p_partkey % 3 <> 0"),
    ("cmf", "(p_partkey % 19) / 19.0 - 0.5", "CAST(NULL AS DOUBLE)", "p_size % 5 <> 1"),
    ("volume_ratio", "(p_partkey % 11) / 10.0", "(p_partkey % 11) / 10.0 + 1", "p_size > 9"),
    ("z_score", "-2 + p_size / 20.0", "0.5 + p_size / 20.0", "p_partkey % 2 = 0"))


def many_rules(spark, sf_dir) -> DataFrame:
    """Rules of as many strategies as there are parts."""
    part = table(spark, sf_dir, "part")
    out = None
    for feature, lo, hi, where in MANY_RULES:
        one = part.filter(where).selectExpr(
            "concat('s', p_partkey) AS strategy",
            "CASE WHEN p_size % 2 = 0 THEN 'buy' ELSE 'sell' END AS side", f"'{feature}' AS feature",
            f"double({lo}) AS lo", f"double({hi}) AS hi")
        out = one if out is None else out.unionByName(one)
    return out


def rule_votes_many(spark, sf_dir):
    """Votes of thousands of strategies on every bar, summed up by strategy."""
    features = feature_table(event_bars(spark, sf_dir), list(MANY_FEATURES), "history")
    found = G.rule_votes_bitmaps(features, many_rules(spark, sf_dir), strong=2)
    return found.groupBy("strategy", "side").agg(
        F.sum("bars").alias("bars"), F.sum("votes").alias("votes"), F.max("most").alias("most"),
        F.sum("strong").alias("strong"))


def rule_verdict_long(spark, sf_dir):
    features = feature_table(event_bars(spark, sf_dir),
                             P.needed_features(BUY, SELL, extra=SCORED_ON), "history")
    scored = logit_scorer(logit_scorer(features, BUY, "buy"), SELL, "sell")
    return G.rule_verdict_long(scored, rules_frame(spark, BUY, SELL))


def decided(spark, sf_dir, bars: Query = event_bars, bar_seconds: int = 3600) -> DataFrame:
    out = P.decide(bars(spark, sf_dir), BUY, SELL, logit_scorer, SCORED_ON,
                   bar_seconds=bar_seconds)
    return out.withColumn("currency_pair", F.upper(F.concat(
        F.substring("symbol", 1, 3), F.lit("/ usd"))))


def daily_final_decision(spark, sf_dir):
    """Decisions over series of several chunks."""
    return shown(decided(spark, sf_dir, order_bars, 86400))


# Two strategies on one symbol, a third on another; the other symbols have none.
STRATEGIES = (
    (replace(BUY, name="alpha", aliases=("Alpha",)), replace(SELL, name="alpha", aliases=())),
    (replace(BUY, name="beta", aliases=("Alpha-b",), threshold=0.5, min_votes=2, service_votes=2,
             rules=BUY.rules[:4]),
     replace(SELL, name="beta", aliases=(), threshold=0.5, min_votes=1, service_votes=1,
             rules=SELL.rules[2:])),
    (replace(BUY, name="gamma", symbol="view", aliases=("G",), min_votes=4),
     replace(SELL, name="gamma", aliases=(), symbol="view", threshold=0.7)),
)


def strategy_decisions(spark, sf_dir):
    return shown(P.strategy_decisions(
        event_bars(spark, sf_dir), STRATEGIES, logit_scorer, SCORED_ON))


def strategy_requests(spark, sf_dir):
    """Every event asks one of the strategies, or one nobody runs, for its answer at that time."""
    n = F.col("event_id") % 4
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(n == 0, "Alpha-v2").when(n == 1, "Alpha-beta").when(n == 2, "Gamma").otherwise("Delta")
        .alias("strategy"), F.col("ts").alias("to_time"))
    found = P.strategy_answers(event_bars(spark, sf_dir), STRATEGIES, logit_scorer, SCORED_ON)
    return P.decisions_as_of(requests, found, [c for pair in STRATEGIES for c in pair]).select(
        "request_id", "strategy", "to_time", "symbol", "bar_time", "action")


def final_decision(spark, sf_dir):
    return shown(decided(spark, sf_dir))


def verdict_join(spark, sf_dir):
    features = feature_table(event_bars(spark, sf_dir),
                             P.needed_features(BUY, SELL, extra=SCORED_ON), "history")
    both = materialise(logit_scorer(logit_scorer(features, BUY, "buy"), SELL, "sell"), "scored")
    return shown(D.verdict_join(G.side_verdict(both, BUY, "buy_p0", "buy_p1"),
                                G.side_verdict(both, SELL, "sell_p0", "sell_p1")))


def verdict_counts(spark, sf_dir):
    return D.verdict_counts(decided(spark, sf_dir))


def decision_counts(spark, sf_dir):
    return D.decision_counts(decided(spark, sf_dir))


def latest_decision(spark, sf_dir):
    return shown(D.latest_decision(materialise(decided(spark, sf_dir), "decided")))


def actionable(spark, sf_dir):
    return D.actionable(decided(spark, sf_dir)).select("symbol", "datetime", "final_decision")


NOW = "2024-01-30 12:30:00"


def fresh_decisions(spark, sf_dir):
    return D.fresh(decided(spark, sf_dir), NOW, "datetime").select(
        "symbol", "datetime", "final_decision")


def normalise_pair(spark, sf_dir):
    return D.normalise_pair(table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.substring("event_type", 1, 3), F.lit("/ "),
                             F.when(F.col("event_id") % 4 == 0, "us").otherwise("usd"))
        .alias("currency_pair")))


def answers(spark, sf_dir) -> DataFrame:
    return P.service_answers(event_bars(spark, sf_dir), BUY, SELL, logit_scorer, SCORED_ON)


def service_action(spark, sf_dir):
    return answers(spark, sf_dir).select("symbol", "time", "action_sell", "action_buy", "action")


def service_action_v1(spark, sf_dir):
    features = feature_table(event_bars(spark, sf_dir), list(SCORED_ON), "as_of")
    scored = logit_scorer(logit_scorer(features, BUY, "buy"), SELL, "sell")

    def side(c: StrategyConfig):
        p0, p1 = F.col(f"{c.side}_p0"), F.col(f"{c.side}_p1")
        return D.class_action(p0, p1, G.confidence_gate(p0, p1, c.threshold), c.side.upper())
    return scored.select("symbol", "time", side(SELL).alias("action_sell"),
                         side(BUY).alias("action_buy")).withColumn(
        "action", D.service_action_v1(F.col("action_sell"), F.col("action_buy")))


def volume_confirm(spark, sf_dir):
    return answers(spark, sf_dir).select("symbol", "time", D.volume_confirm(
        F.col("action"), F.col("tick_volume"), SELL.min_volume, BUY.min_volume).alias("action"))


PER_SYMBOL = [StrategyConfig(name=s, side="sell", symbol=s, threshold=0.0, min_votes=0, rules=(),
                             aliases=(f"Str-{s}",)) for s in ("click", "view", "purchase", "error")]


def symbol_requests(spark, sf_dir) -> DataFrame:
    """Every event asks for its own type's decision at its own time; some name no strategy."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("Str-"), F.col("event_type"), F.lit("-v2")).alias("strategy"),
        (F.col("ts") - F.expr("INTERVAL 90 MINUTES")).alias("to_time"))


def decisions_as_of(spark, sf_dir):
    answered = answers(spark, sf_dir).withColumn("strategy", F.col("symbol"))
    return P.decisions_as_of(symbol_requests(spark, sf_dir), answered, PER_SYMBOL).select(
        "request_id", "strategy", "to_time", "bar_time", "action")


# --- models ----------------------------------------------------------------------------------

MODEL_A = ("tick_volume", "close_std_10", "rsi", "bb_width", "bb_width")
MODEL_B = ("tick_volume", "atr", "volume_ratio", "price_range")
MODEL_META = ("tick_volume", "obv", "rsi_lag_5", *S.PROBABILITIES)


def _model(spark, sf_dir):
    wanted = [n for n in dict.fromkeys([*MODEL_A, *MODEL_B, *MODEL_META])
              if n not in (*S.PROBABILITIES, "tick_volume")]
    found = I.registry()
    found["_next_close"] = win("_next_close", "close", R.following("close"), 0, 1)
    found["went_up"] = row("went_up", "close _next_close",
                           "CASE WHEN _next_close IS NOT NULL THEN int(_next_close > close) END")
    features = materialise(feature_table(
        event_bars(spark, sf_dir), [*wanted, "went_up"], "raw", [list(found.values())]), "training")
    model = S.fit_stack(features, "went_up", MODEL_A, MODEL_B, MODEL_META, trees=3, depth=3)
    return model, features


def base_scores(spark, sf_dir):
    model, features = _model(spark, sf_dir)
    return model.base_scores(features).select("symbol", "time", *S.PROBABILITIES)


def stacked_scores(spark, sf_dir):
    model, features = _model(spark, sf_dir)
    return model.transform(features, "up").select(
        "symbol", "time", *S.PROBABILITIES, "up_p0", "up_p1", "up_class")


MODEL_INPUTS = {"buy": EURUSD_BUY, "sell": EURUSD_SELL}


def _side_models(spark, sf_dir):
    """One stack per side, on the model lists of a shipped strategy, and the rows it learnt from."""
    found = I.registry()
    found["_next_close"] = win("_next_close", "close", R.following("close"), 0, 1)
    for side, sign in (("buy", ">"), ("sell", "<")):
        found[f"won_{side}"] = row(f"won_{side}", "close _next_close", "CASE WHEN _next_close IS NOT "
                                   f"NULL THEN int(_next_close {sign} close) END")
    wanted = P.needed_features(*MODEL_INPUTS.values(), BUY, SELL)
    features = materialise(feature_table(event_bars(spark, sf_dir), [*wanted, "won_buy", "won_sell"],
                                         "raw", [list(found.values())]), "training")
    models = {side: S.fit_stack(features, f"won_{side}", c.base_a, c.base_b, c.meta, 2, 2)
              for side, c in MODEL_INPUTS.items()}
    return models, features


def model_checks(spark, sf_dir):
    """What holds of fitted stacks: a row a bar, chances that are chances, the likelier class, and
    a meta model over its list and the four base chances once more."""
    models, features = _side_models(spark, sf_dir)
    out = None
    for side, model in models.items():
        pairs = [S.PROBABILITIES[:2], S.PROBABILITIES[2:], ("up_p0", "up_p1")]
        proper, whole = F.lit(True), F.lit(True)
        for a, b in pairs:
            proper &= F.col(a).between(0, 1) & F.col(b).between(0, 1)
            whole &= F.abs(F.col(a) + F.col(b) - 1) < 1e-9
        likelier = F.col("up_class") == (F.col("up_p1") > F.col("up_p0")).cast("int")
        found = model.transform(features, "up").groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(proper).alias("n_proper"),
            F.count_if(whole).alias("n_whole"), F.count_if(likelier).alias("n_likelier"),
        ).select(F.lit(side).alias("side"), "*",
                 F.lit(model.meta.stages[-1].numFeatures).cast("long").alias("meta_inputs"))
        out = found if out is None else out.unionByName(found)
    return out


def model_decisions(spark, sf_dir):
    """Decisions from the fitted stacks, counted per symbol: one legal decision a bar."""
    models, _ = _side_models(spark, sf_dir)
    extra = P.needed_features(*MODEL_INPUTS.values())
    out = P.decide(event_bars(spark, sf_dir), BUY, SELL, S.model_scorer(models), extra)
    legal = F.col("final_decision").isin("buy", "sell", "indecision", "do_nothing")
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(legal).alias("n_legal"),
        F.count_distinct("datetime").alias("n_times"))


#: Dumped models of a stack over the event bars: model, tree, node, feature, test, threshold, yes, no,
#: missing, value.
DUMPED = (
    ("base_a", 0, 0, "z_score", "<", 0.5, 1, 2, 1, None), ("base_a", 0, 1, "rsi", "<", 38.5, 3, 4, 4, None),
    ("base_a", 0, 2, None, None, None, None, None, None, 0.31),
    ("base_a", 0, 3, None, None, None, None, None, None, -0.42),
    ("base_a", 0, 4, "tick_volume", "<", 4.0, 5, 6, 6, None),
    ("base_a", 0, 5, None, None, None, None, None, None, 0.07),
    ("base_a", 0, 6, None, None, None, None, None, None, -0.125),
    ("base_a", 1, 0, "volume_imbalance", "<", 1e-3, 1, 2, 2, None),
    ("base_a", 1, 1, None, None, None, None, None, None, 0.2),
    ("base_a", 1, 2, None, None, None, None, None, None, -0.11),
    ("base_b", 0, 0, "bb_width", "<=", 1.25, 1, 2, 2, None),
    ("base_b", 0, 1, "cmf", "<=", -0.05, 3, 4, 3, None),
    ("base_b", 0, 2, None, None, None, None, None, None, 0.6),
    ("base_b", 0, 3, None, None, None, None, None, None, -0.55),
    ("base_b", 0, 4, None, None, None, None, None, None, 0.15),
    ("meta", 0, 0, "zero_pred_1", "<", 0.5, 1, 2, 1, None),
    ("meta", 0, 1, "one_pred_0", "<", 0.45, 3, 4, 4, None),
    ("meta", 0, 2, "stochastic_k", "<", 60.0, 5, 6, 5, None),
    ("meta", 0, 3, None, None, None, None, None, None, 0.2),
    ("meta", 0, 4, None, None, None, None, None, None, -0.9),
    ("meta", 0, 5, None, None, None, None, None, None, 0.75),
    ("meta", 0, 6, None, None, None, None, None, None, -0.3),
    ("meta", 1, 0, None, None, None, None, None, None, 0.05),
)
TREE_FEATURES = ("z_score", "rsi", "volume_imbalance", "bb_width", "cmf", "stochastic_k")


def _dump_text(model: str) -> str:
    lines, last = [], None
    for m, tree, node, feature, test, at, yes, no, missing, value in DUMPED:
        if m != model:
            continue
        if tree != last:
            lines, last = [*lines, f"booster[{tree}]:"], tree
        lines.append(f"\t{node}:leaf={value}" if feature is None else
                     f"{node}:[{feature}{test}{at}] yes={yes},no={no},missing={missing}")
    return "\n".join(lines)


def dumped_nodes(spark) -> DataFrame:
    """The node table, read from dump files."""
    found = None
    for model in ("base_a", "base_b", "meta"):
        path = _folder(spark, f"dump-{model}")
        spark.createDataFrame([(_dump_text(model),)], "value string").coalesce(1).write.text(path)
        nodes = TR.read_dump(spark, path, model)
        found = nodes if found is None else found.unionByName(nodes)
    return found


def tree_scores(spark, sf_dir):
    features = feature_table(event_bars(spark, sf_dir), list(TREE_FEATURES), "raw")
    out = TR.tree_stack(features, dumped_nodes(spark), "up")
    return shown(out.select("symbol", "time", *S.PROBABILITIES, "up_p0", "up_p1", "up_class"))


# --- reviews ---------------------------------------------------------------------------------

def responses(spark, sf_dir) -> DataFrame:
    """Free-text answers made from the events; forms vary with the type and the number."""
    price = F.round(F.col("value") * 100).cast("long")
    n = F.col("event_id")
    kind = F.col("event_type")
    text = F.concat(
        F.when(kind == "error", F.concat(F.lit("Error: 500, retry "), n))
        .when(kind == "view", "FINAL DECISION: [CONFIRM]\n")
        .when(kind == "click", "FINAL DECISION: CONFIRM** \n")
        .when(kind == "signup", "**FINAL DECISION: REJECT** \n").otherwise("no verdict\n"),
        F.when(n % 3 == 0, F.concat(F.lit("Justification: seen "), n, F.lit("\ttimes \n\nmore\n")))
        .when(n % 3 == 1, F.concat(F.lit("Justification:\n level "), price, F.lit("\n")))
        .otherwise(""),
        F.lit("Trade Execution\n- Entry: ["), price, F.when(n % 5 == 0, F.concat(
            F.lit("-"), price + 7)).otherwise(""), F.lit("]\n"),
        F.when(n % 7 != 0, F.concat(F.lit("- Stop Loss: ["), price - 5, F.lit("]\n"))).otherwise(""),
        F.when(n % 4 == 0, F.concat(F.lit("- take profit : "), price + 9, F.lit("\n"))).otherwise(""),
        F.lit("- Take Profit: ["), price + 11, F.lit("]\n"),
        F.when(n % 6 == 0, F.concat(F.lit("*Entry*: ["), price, F.lit("] *Stop Loss*: ["), price - 1,
                                    F.lit("]\n"))).otherwise(""),
        F.when(n % 8 == 0, F.concat(F.lit('{"action": "'), kind, F.lit('", "score": '), n,
                                    F.lit("}"))).when(n % 8 == 1, "{broken: }").otherwise(""))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("response_id"), "ts", text.alias("response"), kind.alias("kind"))


def extract_decision(spark, sf_dir):
    return responses(spark, sf_dir).select(
        "response_id", T.extract_decision(F.col("response")).alias("agent_decision"))


def extract_justification(spark, sf_dir):
    return responses(spark, sf_dir).select(
        "response_id", T.extract_justification(F.col("response")).alias("justification"))


def extract_execution(spark, sf_dir):
    return responses(spark, sf_dir).select(
        "response_id", T.execution_fields(F.col("response")).alias("e")).select(
        "response_id", "e.Entry", "e.Stop_Loss", "e.Take_Profit")


def extract_execution_strict(spark, sf_dir):
    return responses(spark, sf_dir).select(
        "response_id", T.execution_fields(F.col("response"), strict=True).alias("e")).select(
        "response_id", "e.entry", "e.stop_loss", "e.take_profit")


def extract_json(spark, sf_dir):
    return responses(spark, sf_dir).select("response_id", T.extract_json(
        F.col("response"), "action string, score bigint").alias("j")).select(
        "response_id", "j.action", F.col("j.score").cast("double").alias("score"))


def split_decision(spark, sf_dir):
    return responses(spark, sf_dir).select(
        "response_id", T.split_decision(F.col("response")).alias("answer"))


def parsed(spark, sf_dir) -> DataFrame:
    return T.parse_responses(responses(spark, sf_dir)).withColumns({
        "currency_pair": F.upper("kind"),
        "model_suggestion": F.when(F.col("response_id") % 2 == 0, "buy").otherwise("sell")})


def review_table(spark, sf_dir):
    path = _folder(spark, "reviews")
    reviews = T.review_table(parsed(spark, sf_dir).filter("kind <> 'error'"))
    late = T.review_table(parsed(spark, sf_dir).filter("kind = 'error'"))
    B.write_snapshot(reviews, path)
    B.append_rows(late, path)
    return spark.read.schema(reviews.schema).parquet(path)


def exec_valid(spark, sf_dir):
    good, _ = T.executions(parsed(spark, sf_dir))
    return shown(T.price_bounds(good).select(
        "response_id", "entry", "stop_loss", "take_profit", "numeric", "entry_low", "entry_high"))


def exec_quarantine(spark, sf_dir):
    _, bad = T.executions(parsed(spark, sf_dir))
    return bad.select("response_id", "ts", "response")


def build_requests(spark, sf_dir):
    return T.build_requests(decided(spark, sf_dir)).select(
        "symbol", "datetime", "timestamp_local", "timestamp_market", "request")


def _log(spark, sf_dir) -> str:
    """Folder of the response log, written anew for each query."""
    path = _folder(spark, "log")
    L.append_log(responses(spark, sf_dir), path)
    return path


def log_records(spark, sf_dir):
    return L.read_log(spark, _log(spark, sf_dir)).filter(F.trim("record") != "").filter(
        F.col("record").contains("Timestamp:")).select(T.strip(F.col("record")).alias("record"))


def parse_log(spark, sf_dir):
    path = _folder(spark, "parsed")
    L.write_parsed(L.parse_log(spark, _log(spark, sf_dir)), path)
    return spark.read.parquet(path)


def log_latest(spark, sf_dir):
    return L.log_latest(spark, _log(spark, sf_dir))


# --- streams ---------------------------------------------------------------------------------

FEED_CUTS = ("2024-01-08 00:00:00", "2024-01-20 00:00:00")


def _feed(df: DataFrame, time: str, run: Callable[[str], None]) -> None:
    """Let rows arrive in parts by time, the last with all that is later or without a time;
    ``run`` processes the feed after each."""
    feed = _folder(df.sparkSession, "feed")
    part = F.lit(len(FEED_CUTS))
    for i, cut in reversed(list(enumerate(FEED_CUTS))):
        part = F.when(F.col(time) < F.lit(cut).cast("timestamp_ntz"), i).otherwise(part)
    for i in range(len(FEED_CUTS) + 1):
        df.filter(part == i).write.mode("append").parquet(feed)
        run(feed)


def stream_bars(spark, sf_dir):
    ticks = event_ticks(spark, sf_dir)
    out = _folder(spark, "stream-bars")

    def run(feed: str) -> None:
        source = spark.readStream.schema(ticks.schema).parquet(feed)
        SB.to_parquet(SB.stream_bars(source), f"{out}/bars", f"{out}/check").awaitTermination()
    _feed(ticks, "ts", run)
    return shown(spark.read.parquet(f"{out}/bars"))


def stream_bars_live(spark, sf_dir):
    """All bars, open ones too, although every fifth tick comes twelve days late."""
    late = F.when(F.col("seq") % 5 == 0, F.col("ts") + F.expr("INTERVAL 12 DAYS")).otherwise(F.col("ts"))
    ticks = event_ticks(spark, sf_dir).withColumn("arrives", late)
    live = SP.LiveBars(spark, _folder(spark, "live-bars"))

    def run(feed: str) -> None:
        live.follow(spark.readStream.schema(ticks.schema).parquet(feed)).awaitTermination()
    _feed(ticks, "arrives", run)
    return shown(live.read())


def stream_dedup(spark, sf_dir):
    """Every second bar arrives again in a later batch with a higher close: the first is kept."""
    bars = event_bars(spark, sf_dir)
    again = bars.filter(F.col("tick_volume") % 2 == 0).withColumn("close", F.col("close") + 1)
    out, feed = _folder(spark, "stream-dedup"), _folder(spark, "feed")
    for part in (bars, again):
        part.write.mode("append").parquet(feed)
        source = spark.readStream.schema(bars.schema).parquet(feed)
        SB.to_parquet(SB.first_arrivals(source, "60 days"), f"{out}/bars", f"{out}/check"
                      ).awaitTermination()
    return shown(spark.read.parquet(f"{out}/bars"))


def stream_keep_last(spark, sf_dir):
    """Every second bar is corrected in a later batch: the correction wins."""
    bars = event_bars(spark, sf_dir)
    fixed = bars.filter(F.col("tick_volume") % 2 == 0).withColumn("close", F.col("close") + 1)
    out, feed = _folder(spark, "stream-last"), _folder(spark, "feed")
    for part in (bars, fixed):
        part.write.mode("append").parquet(feed)
        source = spark.readStream.schema(bars.schema).parquet(feed)
        SU.keep_latest(source, out).awaitTermination()
    return shown(SU.latest_bars(spark.read.parquet(f"{out}/bars").drop("batch")))


STREAM_COLUMNS = ("rsi", "ema_50", "atr", "obv", "adx", "macd_histogram_slope", "cmf",
                  "fib_382", "ichimoku_lagging", "liquidity_index")


def _by_time(bars: DataFrame, run: Callable[[str], None]) -> None:
    _feed(bars, "time", run)


def _disordered(bars: DataFrame, run: Callable[[str], None]) -> None:
    """Of the bars before the first cut some come with a wrong close and some not at all; the
    second part corrects and adds them, and repeats the others. The rest follows in order."""
    feed = _folder(bars.sparkSession, "feed")
    first, second = [F.lit(cut).cast("timestamp_ntz") for cut in FEED_CUTS]
    early = bars.filter(F.col("time") < first)
    wrong = F.when(F.col("tick_volume") % 3 == 0, F.col("close") + 1).otherwise(F.col("close"))
    for part in (early.filter(F.dayofmonth("time") != 3).withColumn("close", wrong),
                 early.unionByName(bars.filter((F.col("time") >= first) & (F.col("time") < second))),
                 bars.filter(~F.coalesce(F.col("time") < second, F.lit(False)))):
        part.write.mode("append").parquet(feed)
        run(feed)


def _feature_stream(spark, sf_dir, columns, then=None, feed=_by_time) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    out = _folder(spark, "stream-features")
    features = SF.FeatureStream(columns)

    def run(feed: str) -> None:
        source = spark.readStream.schema(bars.schema).parquet(feed)
        SF.start(source, features, f"{out}/work", f"{out}/rows", then).awaitTermination()
    feed(bars, run)
    return SF.latest_rows(spark.read.parquet(f"{out}/rows"))


def stream_features(spark, sf_dir):
    rows = _feature_stream(spark, sf_dir, STREAM_COLUMNS)
    return shown(rows.select("symbol", "time", *STREAM_COLUMNS))


def stream_features_late(spark, sf_dir):
    """The same rows although bars came late, twice or wrong at first."""
    rows = _feature_stream(spark, sf_dir, STREAM_COLUMNS, feed=_disordered)
    return shown(rows.select("symbol", "time", *STREAM_COLUMNS))


def stream_decisions(spark, sf_dir):
    needed = P.needed_features(BUY, SELL, extra=SCORED_ON)
    return _feature_stream(spark, sf_dir, needed, lambda rows: P.answer_rows(
        rows, BUY, SELL, logit_scorer)).select(
        "symbol", "time", "action_sell", "action_buy", "action")


def stream_requests(spark, sf_dir):
    """The rows of ``decisions_as_of`` although requests come in three parts, early and late, while
    the bars come by time."""
    bars, asked = event_bars(spark, sf_dir), symbol_requests(spark, sf_dir)
    out, questions = _folder(spark, "stream-requests"), _folder(spark, "questions")
    features = SF.FeatureStream(P.needed_features(BUY, SELL, extra=SCORED_ON))
    requests = SQ.RequestStream(spark, f"{out}/requests", PER_SYMBOL, asked.schema)
    parts = iter(range(3))

    def run(feed: str) -> None:
        asked.filter(F.col("request_id") % 3 == next(parts)).write.mode("append").parquet(questions)
        SF.start(spark.readStream.schema(bars.schema).parquet(feed), features, f"{out}/work",
                 f"{out}/answers", lambda rows: P.answer_rows(rows, BUY, SELL, logit_scorer)
                 .withColumn("strategy", F.col("symbol"))).awaitTermination()
        requests.follow(spark.readStream.schema(asked.schema).parquet(questions),
                        spark.readStream.schema(SQ.TOLD).parquet(f"{out}/answers")).awaitTermination()
    _feed(bars, "time", run)
    return requests.read(waiting=True).select(
        "request_id", "strategy", "to_time", "bar_time", "action")


def stream_log(spark, sf_dir):
    out, folder = _folder(spark, "stream-log"), _folder(spark, "log")
    texts = responses(spark, sf_dir)
    for half in (texts.filter("response_id % 2 = 0"), texts.filter("response_id % 2 = 1")):
        L.append_log(half, folder)
        SL.tail_log(spark, folder, f"{out}/rows", f"{out}/check").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


GROWTH = ("response_id % 3 = 0", "response_id % 3 = 1", "response_id % 3 = 2")


def _grow(spark, path: str, texts: DataFrame) -> None:
    """Append records to the one file at ``path``, as a service does."""
    part = _folder(spark, "log-part")
    L.append_log(texts.coalesce(1), part)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    grown = jvm.org.apache.hadoop.fs.Path(f"{path}.grown")
    out = fs.create(grown, True)
    added = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(part))
             if s.getPath().getName().startswith("part-")]
    for source in ([target] if fs.exists(target) else []) + added:
        stream = fs.open(source)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
        stream.close()
    out.close()
    fs.delete(target, False)
    fs.rename(grown, target)


def stream_log_growing(spark, sf_dir):
    """One log file that grows between batches: each record comes out once."""
    out, folder = _folder(spark, "stream-growing"), _folder(spark, "growing-log")
    texts = responses(spark, sf_dir)
    for part in GROWTH:
        _grow(spark, f"{folder}/service.log", texts.filter(part))
        SL.tail_growing_log(spark, folder, f"{out}/work", f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name, columns in {**FINITE, **RUNNING}.items():
        found[name] = indicator(columns)
    for name, columns in DAILY_FINITE.items():
        found[name] = indicator(columns, order_bars)
    for name, columns in DAILY_RUNNING.items():
        found[name] = indicator(columns, order_bars, ORDER_RUNNING_DIGITS)
    found["feature_table"] = full_table("history")
    found["feature_table_as_of"] = full_table("as_of")
    found["daily_feature_table"] = full_table("history", order_bars, ORDER_TABLE_DIGITS)
    found["fill_forward"] = fill_query(False)
    found["fill_backward"] = fill_query(True)
    for fn in (
        scan_bars, build_bars_hourly, build_bars_daily, epoch_to_ts, filter_since, features_as_of,
        append_dedup_last, snapshot_roundtrip, bar_store, bar_store_days, features_restart, safe_division, tz_projection, rolling_sums,
        ewm_adjusted, ema_gappy, atr_gappy, stacked_logit, confidence_gate, rule_votes_wide, rule_votes_long, rule_votes_many,
        rule_verdict_long, verdict_join, verdict_counts, final_decision, daily_final_decision,
        decision_counts, latest_decision, strategy_decisions, strategy_requests, prefix_groups,
        model_checks, model_decisions, tree_scores,
        actionable, fresh_decisions, normalise_pair, service_action, service_action_v1,
        volume_confirm, decisions_as_of, base_scores, stacked_scores, extract_decision,
        extract_justification, extract_execution, extract_execution_strict, extract_json,
        split_decision, review_table, exec_valid, exec_quarantine, build_requests, log_records,
        parse_log, log_latest, stream_bars, stream_bars_live, stream_dedup, stream_keep_last, stream_features,
        stream_features_late, stream_decisions, stream_requests, stream_log, stream_log_growing,
    ):
        found[fn.__name__] = fn
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to bars to features to scores to votes to decisions."""
    return final_decision(spark, sf_dir)
