"""Indicator columns as small declarative features.

A feature names the columns it needs and gives one SQL expression over them. ``row`` features are
plain expressions, ``win`` features use the chunk window, ``scan`` features are running
recursions. The planner (`tickloom.plans.features`) orders them into select stages; names starting
with ``_`` are intermediates and never returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from tickloom.functions.sqltext import above, below, div, finite, flag, num
from tickloom.operators import rolling as R

BASE = ("symbol", "time", "open", "high", "low", "close", "tick_volume", "spread")
LAGS = (1, 2, 3, 5, 10)


@dataclass(frozen=True)
class Feature:
    name: str
    needs: tuple[str, ...]
    sql: str = ""
    kind: str = "row"            # row, win or scan
    back: int = 0                # rows before the current one that the window reads
    ahead: int = 0               # rows after it
    ratio: float | None = None   # of a scan
    scans: str = "decay"         # the kind of a scan


def row(name: str, needs: str, sql: str) -> Feature:
    return Feature(name, tuple(needs.split()), sql)


def win(name: str, needs: str, sql: str, back: int = 0, ahead: int = 0) -> Feature:
    return Feature(name, tuple(needs.split()), sql, "win", back, ahead)


def scan(name: str, u: str, ratio: float) -> Feature:
    return Feature(name, (u,), kind="scan", ratio=ratio)


def affine(name: str, u: str, r: str, ratio: float) -> Feature:
    """A scan whose ratio differs by row; ``ratio`` bounds its products, see ``Scan``."""
    return Feature(name, (u, r), kind="scan", ratio=ratio, scans="affine")


def last_known(name: str, u: str) -> Feature:
    return Feature(name, (u,), kind="scan", ratio=1.0, scans="last")


# --- shared intermediates --------------------------------------------------------------------

def shared() -> list[Feature]:
    return [
        win("_prev_close", "close", R.previous("close"), 1),
        win("_prev_high", "high", R.previous("high"), 1),
        win("_prev_low", "low", R.previous("low"), 1),
        win("_prev_open", "open", R.previous("open"), 1),
        win("_prev_volume", "tick_volume", R.previous("tick_volume"), 1),
        row("_delta", "close _prev_close", "close - _prev_close"),
        row("_typical", "high low close", "(high + low + close) / 3"),
        row("true_range", "high low _prev_close",
            "greatest(high - low, abs(high - _prev_close), abs(low - _prev_close))"),
    ]


# --- averages --------------------------------------------------------------------------------

def moving_average(n: int, name: str | None = None) -> list[Feature]:
    return [win(name or f"ma_{n}", "close", R.mean("close", n), n - 1)]


def ema(span: int, name: str | None = None, source: str = "close") -> list[Feature]:
    """Exponential mean started at the first value."""
    name = name or f"ema_{span}"
    alpha = 2.0 / (span + 1)
    return [
        row(f"_u_{name}", f"{source} _i",
            f"CASE WHEN _i = 0 THEN {source} ELSE {source} * {num(alpha)} END"),
        scan(name, f"_u_{name}", 1.0 - alpha),
    ]


def ema_over_gaps(span: int, name: str | None = None, source: str = "close") -> list[Feature]:
    """Exponential mean started at the first known value, as pandas gives it over missing ones: a
    gap of n rows weighs what came before by the decay of n + 1 rows and renormalises; on a missing
    row the mean stays."""
    name = name or f"ema_{span}"
    ratio = 1.0 - 2.0 / (span + 1)
    weight = f"pow({num(ratio)}, _i - _was_{source})"
    return [
        row(f"_at_{source}", f"{source} _i", f"CASE WHEN {source} IS NOT NULL THEN _i END"),
        last_known(f"_seen_{source}", f"_at_{source}"),
        win(f"_was_{source}", f"_seen_{source}", R.previous(f"_seen_{source}"), 1),
        row(f"_w_{name}", f"_was_{source} _i", weight),
        row(f"_r_{name}", f"{source} _was_{source} _w_{name}",
            f"CASE WHEN {source} IS NULL THEN 1D WHEN _was_{source} IS NULL THEN 0D "
            f"ELSE _w_{name} / (_w_{name} + {num(1.0 - ratio)}) END"),
        row(f"_u_{name}", f"{source} _was_{source} _w_{name}",
            f"CASE WHEN {source} IS NULL THEN 0D WHEN _was_{source} IS NULL THEN double({source}) "
            f"ELSE {source} * {num(1.0 - ratio)} / (_w_{name} + {num(1.0 - ratio)}) END"),
        affine(f"_s_{name}", f"_u_{name}", f"_r_{name}", ratio),
        row(name, f"_s_{name} _seen_{source}", f"CASE WHEN _seen_{source} IS NOT NULL THEN _s_{name} END"),
    ]


def ewm_adjusted(name: str, source: str, period: int) -> list[Feature]:
    """Exponential mean with alpha = 1/period, weights renormalised over the known values."""
    ratio = 1.0 - 1.0 / period
    return [
        row(f"_k_{name}", source, finite(source)),
        row(f"_un_{name}", f"_k_{name}", f"coalesce(_k_{name}, 0D)"),
        row(f"_ud_{name}", f"_k_{name}", f"CASE WHEN _k_{name} IS NULL THEN 0D ELSE 1D END"),
        scan(f"_num_{name}", f"_un_{name}", ratio),
        scan(f"_den_{name}", f"_ud_{name}", ratio),
        row(name, f"_num_{name} _den_{name}",
            f"CASE WHEN _den_{name} > 0 THEN _num_{name} / _den_{name} END"),
    ]


# --- oscillators -----------------------------------------------------------------------------

def rsi(period: int = 14) -> list[Feature]:
    """Relative strength from simple means; the first bar counts as no change."""
    return [
        row("_gain", "_delta", "CASE WHEN _delta > 0 THEN _delta ELSE 0D END"),
        row("_loss", "_delta", "CASE WHEN _delta < 0 THEN -_delta ELSE 0D END"),
        win("_avg_gain", "_gain", R.mean("_gain", period), period - 1),
        win("_avg_loss", "_loss", R.mean("_loss", period), period - 1),
        row("rsi", "_avg_gain _avg_loss", f"100 - 100 / (1 + {div('_avg_gain', '_avg_loss')})"),
    ]


def stochastic(period: int = 14, smooth: int = 3) -> list[Feature]:
    return [
        win("_low_k", "low", R.low("low", period), period - 1),
        win("_high_k", "high", R.high("high", period), period - 1),
        row("stochastic_k", "close _low_k _high_k",
            f"{div('close - _low_k', '_high_k - _low_k')} * 100"),
        row("_k_known", "stochastic_k", finite("stochastic_k")),
        win("stochastic_d", "_k_known", R.mean("_k_known", smooth), smooth - 1),
    ]


def williams_r(period: int = 14) -> list[Feature]:
    return [
        win("_low_w", "low", R.low("low", period), period - 1),
        win("_high_w", "high", R.high("high", period), period - 1),
        row("williams_r", "close _low_w _high_w",
            f"{div('_high_w - close', '_high_w - _low_w')} * -100"),
    ]


def cci(period: int = 20) -> list[Feature]:
    """Channel index scaled by the deviation (not the mean distance) of the typical price."""
    return [
        win("_tp_mean", "_typical", R.mean("_typical", period), period - 1),
        win("_tp_std", "_typical", R.std("_typical", period), period - 1),
        row("cci", "_typical _tp_mean _tp_std", div("_typical - _tp_mean", "_tp_std * 0.015D")),
    ]


def _signal_from_first(span: int) -> list[Feature]:
    """The signal line where the first rows have no MACD yet; after those none is missing."""
    alpha = 2.0 / (span + 1)
    return [
        row("_u_macd_signal", "macd _prev_macd", "CASE WHEN macd IS NULL THEN 0D WHEN _prev_macd IS "
            f"NULL THEN macd ELSE macd * {num(alpha)} END"),
        scan("_s_macd_signal", "_u_macd_signal", 1.0 - alpha),
        row("macd_signal", "_s_macd_signal macd", "CASE WHEN macd IS NOT NULL THEN _s_macd_signal END"),
    ]


def macd(fast: int = 12, slow: int = 26, signal: int = 9, gaps: bool = False) -> list[Feature]:
    mean = ema_over_gaps if gaps else ema
    return [
        *mean(fast, "_ema_fast"), *mean(slow, "_ema_slow"),
        row("macd", "_ema_fast _ema_slow", "_ema_fast - _ema_slow"),
        *(_signal_from_first(signal) if gaps else ema(signal, "macd_signal", "macd")),
        row("macd_histogram", "macd macd_signal", "macd - macd_signal"),
        win("_prev_histogram", "macd_histogram", R.previous("macd_histogram"), 1),
        row("macd_histogram_slope", "macd_histogram _prev_histogram",
            "macd_histogram - _prev_histogram"),
        win("_prev_macd", "macd", R.previous("macd"), 1),
        win("_prev_signal", "macd_signal", R.previous("macd_signal"), 1),
        row("macd_bullish_cross", "macd macd_signal _prev_macd _prev_signal",
            flag("macd > macd_signal AND _prev_macd <= _prev_signal")),
    ]


def momentum(period: int = 10) -> list[Feature]:
    return [
        win("_close_back", "close", R.previous("close", period), period),
        row("momentum", "close _close_back", "close - _close_back"),
        row("negative_momentum", "momentum", below("momentum", 0)),
        row("positive_momentum", "momentum", above("momentum", 0)),
    ]


def adx(period: int = 14) -> list[Feature]:
    """Directional index without the dominance test, on simple-mean ranges.

    The ratio of both directions is blended with its predecessor and smoothed once more.
    """
    return [
        row("_dm_up", "high _prev_high", above("high - _prev_high", 0)),
        row("_dm_down", "low _prev_low", below("low - _prev_low", 0)),
        win("_range_mean", "true_range", R.mean("true_range", period), period - 1),
        *ewm_adjusted("_up_avg", "_dm_up", period),
        *ewm_adjusted("_down_avg", "_dm_down", period),
        row("_di_up", "_up_avg _range_mean", f"{div('_up_avg', '_range_mean')} * 100"),
        row("_di_down", "_down_avg _range_mean",
            f"abs({div('_down_avg', '_range_mean')} * 100)"),
        row("_dx_ratio", "_di_up _di_down", div("abs(_di_up - _di_down)", "abs(_di_up + _di_down)")),
        row("_dx", "_dx_ratio", f"{finite('_dx_ratio')} * 100"),
        win("_prev_dx", "_dx", R.previous("_dx"), 1),
        row("_dx_blend", "_dx _prev_dx", f"(_prev_dx * {period - 1} + _dx) / {period}"),
        *ewm_adjusted("adx", "_dx_blend", period),
    ]


# --- bands, ranges, levels -------------------------------------------------------------------

def bollinger(period: int = 20, width: float = 2.0) -> list[Feature]:
    return [
        win("bb_middle", "close", R.mean("close", period), period - 1),
        win("bb_std", "close", R.std("close", period), period - 1),
        row("bb_upper", "bb_middle bb_std", f"bb_middle + bb_std * {num(width)}"),
        row("bb_lower", "bb_middle bb_std", f"bb_middle - bb_std * {num(width)}"),
        row("bb_width", "bb_upper bb_lower bb_middle", div("bb_upper - bb_lower", "bb_middle")),
        row("_bounce", "bb_lower close bb_std", div("bb_lower - close", "bb_std")),
        row("bb_bounce_buy", "_bounce", above("_bounce", 0)),
    ]


def keltner(period: int = 20, width: float = 2.0) -> list[Feature]:
    spread = R.mean_abs_deviation("_typical_values", "_typical_mean", period)
    return [
        win("_typical_values", "_typical", R.values("_typical", period), period - 1),
        win("_typical_mean", "_typical", R.mean("_typical", period), period - 1),
        row("_keltner_range", "_typical_values _typical_mean", f"{spread} * {num(width)}"),
        row("keltner_upper", "_typical_mean _keltner_range", "_typical_mean + _keltner_range"),
        row("keltner_lower", "_typical_mean _keltner_range", "_typical_mean - _keltner_range"),
    ]


def average_true_range(period: int = 14) -> list[Feature]:
    """Simple mean of the true range, and Wilder's smoothing of it (0.0 while warming up)."""
    return [
        win("atr_sma", "true_range", R.mean("true_range", period), period - 1),
        row("_u_atr", "true_range atr_sma _i",
            f"CASE WHEN _i < {period - 1} THEN 0D WHEN _i = {period - 1} THEN atr_sma "
            f"ELSE true_range / {period} END"),
        scan("atr", "_u_atr", 1.0 - 1.0 / period),
    ]


def true_range_over_gaps(period: int = 14) -> list[Feature]:
    """The same with ranges missing: the start is the mean of the known ones among the first
    ``period``; one missing later leaves everything after it unknown."""
    known = (f"CASE WHEN _i < {period - 1} THEN 0D WHEN _i = {period - 1} THEN _atr_start "
             f"ELSE true_range / {period} END")
    return [
        win("atr_sma", "true_range", R.mean("true_range", period), period - 1),
        win("_atr_start", "true_range", R.known_mean("true_range", period), period - 1),
        row("_v_atr", "true_range _atr_start _i", known),
        row("_u_atr", "_v_atr", "coalesce(_v_atr, 0D)"),
        row("_lost_atr", "_v_atr", "CASE WHEN _v_atr IS NULL THEN 1D ELSE 0D END"),
        scan("_s_atr", "_u_atr", 1.0 - 1.0 / period),
        scan("_gone_atr", "_lost_atr", 1.0),
        row("atr", "_s_atr _gone_atr", "CASE WHEN _gone_atr = 0 THEN _s_atr END"),
    ]


def fib_levels(period: int = 100) -> list[Feature]:
    """Retracements of the range of the ``period`` bars before the current one."""
    return [
        win("_fib_high", "_prev_high", R.high("_prev_high", period), period - 1),
        win("_fib_low", "_prev_low", R.low("_prev_low", period), period - 1),
        *[row(name, "_fib_high _fib_low", f"_fib_high - (_fib_high - _fib_low) * {num(share)}")
          for name, share in (("fib_236", 0.236), ("fib_382", 0.382), ("fib_618", 0.618))],
    ]


def ichimoku(conversion: int = 9, base: int = 26, span_b: int = 52,
             shift: int = 26) -> list[Feature]:
    """Cloud lines; the lagging span is the close ``shift`` bars ahead (look-ahead)."""
    def middle(n: int) -> str:
        return f"({R.high('high', n)} + {R.low('low', n)}) / 2"
    spans = "close ichimoku_span_a ichimoku_span_b"
    return [
        win("ichimoku_conversion", "high low", middle(conversion), conversion - 1),
        win("ichimoku_base", "high low", middle(base), base - 1),
        win("_span_b_now", "high low", middle(span_b), span_b - 1),
        row("_span_a_now", "ichimoku_conversion ichimoku_base",
            "(ichimoku_conversion + ichimoku_base) / 2"),
        win("ichimoku_span_a", "_span_a_now", R.previous("_span_a_now", shift), shift),
        win("ichimoku_span_b", "_span_b_now", R.previous("_span_b_now", shift), shift),
        win("ichimoku_lagging", "close", R.following("close", shift), 0, shift),
        row("ichimoku_distance", spans, "close - (ichimoku_span_a + ichimoku_span_b) / 2"),
        row("ichimoku_bearish", spans, flag("close < ichimoku_span_a AND close < ichimoku_span_b")),
        row("ichimoku_bullish", spans, flag("close > ichimoku_span_a AND close > ichimoku_span_b")),
    ]


def lagging_as_known(shift: int = 26) -> Feature:
    """The lagging span at the end of a history cut at this bar: its newest known value.

    A history that ends here has no close ``shift`` bars ahead; filling forward from the last
    bar that has one gives the close of this very bar.
    """
    return row("ichimoku_lagging", "close _i", f"CASE WHEN _i >= {shift} THEN close END")


def pivot_points() -> list[Feature]:
    return [
        row("pivot", "_prev_high _prev_low _prev_close",
            "(_prev_high + _prev_low + _prev_close) / 3"),
        row("r1", "pivot _prev_low", "pivot * 2 - _prev_low"),
        row("s1", "pivot _prev_high", "pivot * 2 - _prev_high"),
    ]


def support_resistance(period: int = 20) -> list[Feature]:
    return [
        win("support_level", "low", R.low("low", period), period - 1),
        win("resistance_level", "high", R.high("high", period), period - 1),
    ]


def risk_reward(width: float = 2.0) -> list[Feature]:
    return [
        row("stop_loss", "close atr", f"close - atr * {num(width)}"),
        row("risk_reward_ratio", "resistance_level close stop_loss",
            div("resistance_level - close", "close - stop_loss")),
    ]


# --- volume ----------------------------------------------------------------------------------

def on_balance_volume() -> list[Feature]:
    return [
        row("_u_obv", "_delta tick_volume", "coalesce(signum(_delta) * tick_volume, 0D)"),
        scan("obv", "_u_obv", 1.0),
    ]


def volume_ratio(period: int = 20) -> list[Feature]:
    return [
        win("volume_ma", "tick_volume", R.mean("tick_volume", period), period - 1),
        row("volume_ratio", "tick_volume volume_ma", div("tick_volume", "volume_ma")),
        row("tick_volume_ma", "volume_ma", "volume_ma"),
        row("tick_volume_ratio", "volume_ratio", "volume_ratio"),
        row("high_volume_zone", "volume_ratio", flag("volume_ratio > 1.5D")),
    ]


def up_counts(period: int = 14) -> list[Feature]:
    return [
        row("_up_close", "close _prev_close", f"double({flag('close > _prev_close')})"),
        row("_up_volume", "tick_volume _prev_volume",
            f"double({flag('tick_volume > _prev_volume')})"),
        win("price_up", "_up_close", R.total("_up_close", period), period - 1),
        win("volume_up", "_up_volume", R.total("_up_volume", period), period - 1),
    ]


def volume_oscillator(short: int = 5, long: int = 20) -> list[Feature]:
    return [
        win("_volume_short", "tick_volume", R.mean("tick_volume", short), short - 1),
        win("_volume_long", "tick_volume", R.mean("tick_volume", long), long - 1),
        row("volume_oscillator", "_volume_short _volume_long",
            f"{div('_volume_short - _volume_long', '_volume_long')} * 100"),
    ]


def money_flow(period: int = 20) -> list[Feature]:
    """Chaikin money flow; a flat bar has no flow and empties every frame holding it."""
    return [
        row("_flow_raw", "high low close tick_volume",
            f"{div('(close - low) - (high - close)', 'high - low')} * tick_volume"),
        row("_flow", "_flow_raw", finite("_flow_raw")),
        win("_flow_sum", "_flow", R.total("_flow", period), period - 1),
        win("_volume_sum", "tick_volume", R.total("tick_volume", period), period - 1),
        row("cmf", "_flow_sum _volume_sum", div("_flow_sum", "_volume_sum")),
    ]


def order_flow() -> list[Feature]:
    return [
        row("buy_volume", "close open tick_volume",
            "CASE WHEN close > open THEN tick_volume ELSE 0 END"),
        row("sell_volume", "close open tick_volume",
            "CASE WHEN close < open THEN tick_volume ELSE 0 END"),
        row("volume_imbalance", "buy_volume sell_volume tick_volume",
            div("buy_volume - sell_volume", "tick_volume")),
    ]


# --- shape, spread, statistics ---------------------------------------------------------------

def heikin_ashi() -> list[Feature]:
    """Averaged candles; the open uses the raw previous bar."""
    return [
        row("ha_close", "open high low close", "(open + high + low + close) / 4"),
        row("ha_open", "_prev_open _prev_close", "(_prev_open + _prev_close) / 2"),
        row("ha_high", "high ha_open ha_close", "greatest(high, ha_open, ha_close)"),
        row("ha_low", "low ha_open ha_close", "least(low, ha_open, ha_close)"),
    ]


def candle_shape() -> list[Feature]:
    return [
        row("price_range", "high low", "high - low"),
        row("body_size", "close open", "abs(close - open)"),
        row("direction", "close open", "CASE WHEN close > open THEN 1 ELSE -1 END"),
        row("volatility", "price_range open", div("price_range", "open")),
    ]


def spread_stats(period: int = 20) -> list[Feature]:
    return [
        row("spread_ratio", "spread close", div("spread", "close")),
        win("spread_ma", "spread", R.mean("spread", period), period - 1),
        win("_spread_std", "spread", R.std("spread", period), period - 1),
        row("spread_volatility", "_spread_std spread_ma", div("_spread_std", "spread_ma")),
    ]


def price_impact() -> list[Feature]:
    return [row("tick_price_impact", "close open tick_volume", div("close - open", "tick_volume"))]


def price_change() -> list[Feature]:
    out = []
    for k in (1, 5, 10):
        out.append(win(f"_close_{k}_ago", "close", R.previous("close", k), k))
        out.append(row(f"price_change_{k}", f"close _close_{k}_ago",
                       f"{div('close', f'_close_{k}_ago')} - 1"))
    return out + [
        row("roc_10", "price_change_10", "price_change_10 * 100"),
        row("returns", "price_change_1", "price_change_1"),
    ]


def deviations() -> list[Feature]:
    """Deviation of the close, and (a different thing) of the returns."""
    return [
        *[win(f"close_std_{n}", "close", R.std("close", n), n - 1) for n in (10, 20, 50)],
        row("_returns_known", "returns", finite("returns")),
        win("return_std_20", "_returns_known", R.std("_returns_known", 20), 19),
    ]


def trend() -> list[Feature]:
    return [
        *moving_average(20, "sma_20"),
        row("trend", "close sma_20", "CASE WHEN close > sma_20 THEN 1 ELSE -1 END"),
        row("z_score", "close sma_20 bb_std", div("close - sma_20", "bb_std")),
    ]


def price_cluster(period: int = 50, bins: int = 10) -> list[Feature]:
    return [
        win("_cluster_values", "close", R.values("close", period), period - 1),
        win("_cluster_low", "close", R.low("close", period), period - 1),
        win("_cluster_high", "close", R.high("close", period), period - 1),
        row("price_cluster", "_cluster_values _cluster_low _cluster_high",
            R.fullest_bin_share("_cluster_values", "_cluster_low", "_cluster_high",
                                period, bins)),
    ]


def level_strength(period: int = 100) -> list[Feature]:
    return [
        win("_lows", "low", R.values("low", period), period - 1),
        win("_lowest", "low", R.low("low", period), period - 1),
        win("_highs", "high", R.values("high", period), period - 1),
        win("_highest", "high", R.high("high", period), period - 1),
        row("support_strength", "_lows _lowest", R.tie_share("_lows", "_lowest", period)),
        row("resistance_strength", "_highs _highest", R.tie_share("_highs", "_highest", period)),
    ]


def liquidity_index() -> list[Feature]:
    return [row(
        "liquidity_index",
        "volume_ratio price_cluster volume_imbalance support_strength resistance_strength",
        "(volume_ratio + price_cluster + abs(volume_imbalance)"
        " + (support_strength + resistance_strength) / 2) / 4")]


def signal_flags() -> list[Feature]:
    return [
        row("rsi_overbought", "rsi", flag("rsi > 70")),
        row("rsi_oversold", "rsi", flag("rsi < 30")),
    ]


def date_parts() -> list[Feature]:
    return [
        row("day", "time", "dayofmonth(time)"),
        row("month", "time", "month(time)"),
        row("year", "time", "year(time)"),
    ]


def lagged() -> list[Feature]:
    sources = {"close": "close", "volume": "tick_volume", "ma_10": "ma_10", "rsi": "rsi",
               "bb_middle": "bb_middle"}
    return [win(f"{label}_lag_{k}", source, f"double({R.previous(source, k)})", k)
            for k in LAGS for label, source in sources.items()]


# Output order of the full feature table.
COLUMNS = (
    "day", "month", "year", "ma_10", "ma_20", "ma_50", "ema_10", "ema_20", "ema_50", "rsi",
    "bb_middle", "bb_std", "bb_upper", "bb_lower", "momentum", "stochastic_k", "stochastic_d",
    *[f"{s}_lag_{k}" for k in LAGS for s in ("close", "volume", "ma_10", "rsi", "bb_middle")],
    "price_change_1", "price_change_5", "price_change_10",
    "close_std_10", "close_std_20", "close_std_50", "atr", "williams_r",
    "fib_236", "fib_382", "fib_618", "macd", "macd_signal", "macd_histogram", "obv", "cci",
    "roc_10", "adx", "ichimoku_conversion", "ichimoku_base", "ichimoku_span_a",
    "ichimoku_span_b", "ichimoku_lagging", "pivot", "r1", "s1", "volume_ma", "volume_ratio",
    "price_up", "volume_up", "ha_close", "ha_open", "ha_high", "ha_low", "volume_oscillator",
    "cmf", "keltner_upper", "keltner_lower", "bb_width", "ichimoku_distance",
    "macd_histogram_slope", "rsi_overbought", "negative_momentum", "ichimoku_bearish",
    "macd_bullish_cross", "rsi_oversold", "bb_bounce_buy", "positive_momentum",
    "ichimoku_bullish", "price_range", "body_size", "direction", "volatility", "spread_ratio",
    "spread_ma", "spread_volatility", "tick_volume_ma", "tick_volume_ratio",
    "tick_price_impact", "support_level", "resistance_level", "sma_20", "trend", "ema_12",
    "ema_26", "returns", "return_std_20", "z_score", "stop_loss", "risk_reward_ratio",
    "high_volume_zone", "price_cluster", "buy_volume", "sell_volume", "volume_imbalance",
    "support_strength", "resistance_strength", "liquidity_index",
)


def registry(gaps: bool = False) -> dict[str, Feature]:
    """All features with their default periods, by name; ``gaps``: for bars with missing prices."""
    mean = ema_over_gaps if gaps else ema
    wilder = true_range_over_gaps if gaps else average_true_range
    families = [
        shared(), date_parts(), moving_average(10), moving_average(20), moving_average(50),
        mean(10), mean(20), mean(50), mean(12), mean(26), rsi(), bollinger(), momentum(),
        stochastic(), lagged(), price_change(), deviations(), wilder(),
        williams_r(), fib_levels(), macd(gaps=gaps), on_balance_volume(), cci(), adx(), ichimoku(),
        pivot_points(), volume_ratio(), up_counts(), heikin_ashi(), volume_oscillator(),
        money_flow(), keltner(), candle_shape(), spread_stats(), price_impact(),
        support_resistance(), trend(), risk_reward(), price_cluster(), order_flow(),
        level_strength(), liquidity_index(), signal_flags(),
    ]
    found = {f.name: f for family in families for f in family}
    # The default fast and slow means are outputs of their own: one scan serves both names.
    found["_ema_fast"] = row("_ema_fast", "ema_12", "ema_12")
    found["_ema_slow"] = row("_ema_slow", "ema_26", "ema_26")
    return found
