"""DuckDB statements for the registered queries, written from the formulas, not from the plans.

Rolling values use plain per-symbol windows and the running recursions a recursive CTE over the
row number, so the chunked Spark forms are checked against an independent formulation.
"""

from __future__ import annotations

EVENT_BARS = """
bars AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS time,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*) AS tick_volume,
         arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), (ts, event_id)) AS spread
  FROM events GROUP BY 1, 2)"""

ORDER_BARS = """
bars AS MATERIALIZED (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS time,
         arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,
         count(*) AS tick_volume,
         CAST(arg_max(o_custkey % 50, (o_orderdate, o_orderkey)) AS INTEGER) AS spread
  FROM orders GROUP BY 1, 2)"""


def div(a: str, b: str) -> str:
    return (f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) "
            f"WHEN ({b}) = 0 AND ({a}) > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN ({b}) = 0 AND ({a}) < 0 THEN CAST('-inf' AS DOUBLE) END)")


def fin(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY time ROWS {n - 1} PRECEDING)"


def roll(call: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {call}({x}) {over(n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY time)"


LAGS = (1, 2, 3, 5, 10)


def finite_ctes() -> str:
    """Layers x1..x6: everything without a recursion."""
    lags = ",\n".join(f"{lag('close', k)} AS close_lag_{k}, {lag('tick_volume', k)} AS volume_lag_{k}"
                      for k in LAGS)
    lags2 = ",\n".join(
        f"{lag('ma_10', k)} AS ma_10_lag_{k}, {lag('rsi', k)} AS rsi_lag_{k}, "
        f"{lag('bb_middle', k)} AS bb_middle_lag_{k}" for k in LAGS)
    bins = ", ".join(
        "len(list_filter(c50, lambda x: "
        + " AND ".join(([f"x > lo50 + (hi50 - lo50) / 10 * {k - 1}"] if k > 1 else [])
                       + ([f"x <= lo50 + (hi50 - lo50) / 10 * {k}"] if k < 10 else []))
        + "))" for k in range(1, 11))
    return f"""
x1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS rn,
  {lag('open')} AS po, {lag('high')} AS ph, {lag('low')} AS pl, {lag('close')} AS pc,
  {lag('tick_volume')} AS pv, (high + low + close) / 3 AS tp,
  lead(close, 26) OVER (PARTITION BY symbol ORDER BY time) AS ichimoku_lagging,
  {fin(div('(close - low) - (high - close)', 'high - low') + ' * tick_volume')} AS flow,
  {lags}
  FROM bars),
x2 AS (SELECT *, close - pc AS delta,
  CASE WHEN close - pc > 0 THEN close - pc ELSE 0 END AS gain,
  CASE WHEN close - pc < 0 THEN pc - close ELSE 0 END AS loss,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range,
  CASE WHEN ph IS NOT NULL THEN greatest(high - ph, 0) END AS dm_up,
  CASE WHEN pl IS NOT NULL THEN least(low - pl, 0) END AS dm_down,
  {div('close', 'close_lag_1')} - 1 AS price_change_1,
  {div('close', 'close_lag_5')} - 1 AS price_change_5,
  {div('close', 'close_lag_10')} - 1 AS price_change_10,
  {fin(div('close', 'close_lag_1') + ' - 1')} AS ret,
  close - close_lag_10 AS momentum,
  CAST({flag('close > pc')} AS DOUBLE) AS up_c, CAST({flag('tick_volume > pv')} AS DOUBLE) AS up_v
  FROM x1),
x3 AS (SELECT *,
  {roll('avg', 'close', 10)} AS ma_10, {roll('avg', 'close', 20)} AS ma_20,
  {roll('avg', 'close', 50)} AS ma_50, {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al,
  {roll('stddev_samp', 'close', 10)} AS close_std_10, {roll('stddev_samp', 'close', 20)} AS close_std_20,
  {roll('stddev_samp', 'close', 50)} AS close_std_50, {roll('stddev_samp', 'ret', 20)} AS return_std_20,
  {roll('min', 'low', 14)} AS ll14, {roll('max', 'high', 14)} AS hh14,
  {roll('avg', 'true_range', 14)} AS atr_sma,
  {roll('max', 'ph', 100)} AS fh, {roll('min', 'pl', 100)} AS fl,
  {roll('avg', 'tp', 20)} AS tp_mean, {roll('stddev_samp', 'tp', 20)} AS tp_std,
  {roll('list', 'tp', 20)} AS tp20,
  ({roll('max', 'high', 9)} + {roll('min', 'low', 9)}) / 2 AS ichimoku_conversion,
  ({roll('max', 'high', 26)} + {roll('min', 'low', 26)}) / 2 AS ichimoku_base,
  ({roll('max', 'high', 52)} + {roll('min', 'low', 52)}) / 2 AS span_b_now,
  {roll('avg', 'tick_volume', 20)} AS volume_ma, {roll('avg', 'tick_volume', 5)} AS v5,
  {roll('sum', 'up_c', 14)} AS price_up, {roll('sum', 'up_v', 14)} AS volume_up,
  {roll('sum', 'flow', 20)} AS flow_sum, {roll('sum', 'tick_volume', 20)} AS vol_sum,
  {roll('avg', 'spread', 20)} AS spread_ma, {roll('stddev_samp', 'spread', 20)} AS spread_std,
  {roll('min', 'low', 20)} AS support_level, {roll('max', 'high', 20)} AS resistance_level,
  {roll('list', 'close', 50)} AS c50, {roll('min', 'close', 50)} AS lo50, {roll('max', 'close', 50)} AS hi50,
  {roll('list', 'low', 100)} AS l100, {roll('list', 'high', 100)} AS h100
  FROM x2),
x4 AS (SELECT *, day(time) AS day, month(time) AS month, year(time) AS year,
  ma_20 AS bb_middle, ma_20 AS sma_20, close_std_20 AS bb_std,
  ma_20 + 2 * close_std_20 AS bb_upper, ma_20 - 2 * close_std_20 AS bb_lower,
  100 - 100 / (1 + {div('ag', 'al')}) AS rsi,
  {div('close - ll14', 'hh14 - ll14')} * 100 AS stochastic_k,
  {fin(div('close - ll14', 'hh14 - ll14') + ' * 100')} AS sk,
  -100 * {div('hh14 - close', 'hh14 - ll14')} AS williams_r,
  fh - (fh - fl) * 0.236::DOUBLE AS fib_236, fh - (fh - fl) * 0.382::DOUBLE AS fib_382,
  fh - (fh - fl) * 0.618::DOUBLE AS fib_618,
  {div('tp - tp_mean', '0.015::DOUBLE * tp_std')} AS cci, price_change_10 * 100 AS roc_10,
  (ph + pl + pc) / 3 AS "pivot", {div('tick_volume', 'volume_ma')} AS volume_ratio,
  (open + high + low + close) / 4 AS ha_close, (po + pc) / 2 AS ha_open,
  {div('v5 - volume_ma', 'volume_ma')} * 100 AS volume_oscillator,
  {div('flow_sum', 'vol_sum')} AS cmf,
  2 * list_sum(list_transform(tp20, lambda x: abs(x - tp_mean))) / 20 AS kr,
  CASE WHEN momentum IS NOT NULL THEN least(momentum, 0) END AS negative_momentum,
  CASE WHEN momentum IS NOT NULL THEN greatest(momentum, 0) END AS positive_momentum,
  high - low AS price_range, abs(close - open) AS body_size,
  CASE WHEN close > open THEN 1 ELSE -1 END AS direction,
  {div('spread', 'close')} AS spread_ratio, {div('spread_std', 'spread_ma')} AS spread_volatility,
  {div('close - open', 'tick_volume')} AS tick_price_impact, price_change_1 AS returns,
  CASE WHEN c50 IS NULL THEN NULL WHEN hi50 = lo50 THEN 1.0
       ELSE greatest({bins}) / 50.0::DOUBLE END AS price_cluster,
  CASE WHEN close > open THEN tick_volume ELSE 0 END AS buy_volume,
  CASE WHEN close < open THEN tick_volume ELSE 0 END AS sell_volume,
  len(list_filter(l100, lambda x: x = list_min(l100))) / 100.0::DOUBLE AS support_strength,
  len(list_filter(h100, lambda x: x = list_max(h100))) / 100.0::DOUBLE AS resistance_strength,
  (ichimoku_conversion + ichimoku_base) / 2 AS span_a_now,
  CASE WHEN close > ma_20 THEN 1 ELSE -1 END AS trend, {div('close - ma_20', 'close_std_20')} AS z_score
  FROM x3),
x5 AS (SELECT *, {roll('avg', 'sk', 3)} AS stochastic_d,
  {lag('span_a_now', 26)} AS ichimoku_span_a, {lag('span_b_now', 26)} AS ichimoku_span_b,
  2 * "pivot" - pl AS r1, 2 * "pivot" - ph AS s1,
  greatest(high, ha_open, ha_close) AS ha_high, least(low, ha_open, ha_close) AS ha_low,
  tp_mean + kr AS keltner_upper, tp_mean - kr AS keltner_lower,
  {div('bb_upper - bb_lower', 'bb_middle')} AS bb_width,
  {div('bb_lower - close', 'bb_std')} AS bounce, {div('price_range', 'open')} AS volatility,
  {flag('rsi > 70')} AS rsi_overbought, {flag('rsi < 30')} AS rsi_oversold,
  volume_ma AS tick_volume_ma, volume_ratio AS tick_volume_ratio,
  {flag('volume_ratio > 1.5')} AS high_volume_zone,
  {div('buy_volume - sell_volume', 'tick_volume')} AS volume_imbalance,
  {lags2}
  FROM x4),
x6 AS (SELECT *, CASE WHEN bounce IS NOT NULL THEN greatest(bounce, 0) END AS bb_bounce_buy,
  close - (ichimoku_span_a + ichimoku_span_b) / 2 AS ichimoku_distance,
  {flag('close < ichimoku_span_a AND close < ichimoku_span_b')} AS ichimoku_bearish,
  {flag('close > ichimoku_span_a AND close > ichimoku_span_b')} AS ichimoku_bullish,
  (volume_ratio + price_cluster + abs(volume_imbalance)
    + (support_strength + resistance_strength) / 2) / 4 AS liquidity_index
  FROM x5)"""


def _step(span: int, prev: str, x: str) -> str:
    return f"{prev} + 2.0::DOUBLE / {span + 1} * ({x} - {prev})"


def scan_ctes() -> str:
    """Layers with the recursions: s1, y1..y3, s2, f."""
    return f""",
k AS MATERIALIZED (SELECT symbol, rn, close, tick_volume, delta, true_range, atr_sma, dm_up, dm_down FROM x6),
s1 AS (
  SELECT symbol, rn, close AS ema_9, close AS ema_10, close AS ema_12, close AS ema_20,
    close AS ema_26, close AS ema_50, 0.0::DOUBLE AS atr, coalesce(dm_up, 0.0)::DOUBLE AS un,
    (CASE WHEN dm_up IS NULL THEN 0 ELSE 1 END)::DOUBLE AS ud,
    coalesce(dm_down, 0.0)::DOUBLE AS dn, (CASE WHEN dm_down IS NULL THEN 0 ELSE 1 END)::DOUBLE AS dd,
    0.0::DOUBLE AS obv
  FROM k WHERE rn = 0
  UNION ALL
  SELECT k.symbol, k.rn, {_step(9, 's1.ema_9', 'k.close')}, {_step(10, 's1.ema_10', 'k.close')},
    {_step(12, 's1.ema_12', 'k.close')}, {_step(20, 's1.ema_20', 'k.close')},
    {_step(26, 's1.ema_26', 'k.close')}, {_step(50, 's1.ema_50', 'k.close')},
    CASE WHEN k.rn < 13 THEN 0 WHEN k.rn = 13 THEN k.atr_sma ELSE (13 * s1.atr + k.true_range) / 14 END,
    s1.un * 13 / 14 + coalesce(k.dm_up, 0), s1.ud * 13 / 14 + (CASE WHEN k.dm_up IS NULL THEN 0 ELSE 1 END),
    s1.dn * 13 / 14 + coalesce(k.dm_down, 0), s1.dd * 13 / 14 + (CASE WHEN k.dm_down IS NULL THEN 0 ELSE 1 END),
    s1.obv + coalesce(sign(k.delta) * k.tick_volume, 0)
  FROM s1 JOIN k ON k.symbol = s1.symbol AND k.rn = s1.rn + 1),
y1 AS (SELECT x6.*, ema_9, ema_10, ema_12, ema_20, ema_26, ema_50, atr, obv,
    CASE WHEN ud > 0 THEN un / ud END AS up_avg, CASE WHEN dd > 0 THEN dn / dd END AS down_avg
  FROM x6 JOIN s1 USING (symbol, rn)),
y2 AS (SELECT *, ema_12 - ema_26 AS macd, 100 * {div('up_avg', 'atr_sma')} AS pdi,
    abs(100 * {div('down_avg', 'atr_sma')}) AS mdi FROM y1),
y3 AS (SELECT *, 100 * {fin(div('abs(pdi - mdi)', 'abs(pdi + mdi)'))} AS dx FROM y2),
y4 AS MATERIALIZED (SELECT *, {fin(f"({lag('dx')} * 13 + dx) / 14")} AS dxb FROM y3),
s2 AS (
  SELECT symbol, rn, macd AS macd_signal, coalesce(dxb, 0.0)::DOUBLE AS xn,
    (CASE WHEN dxb IS NULL THEN 0 ELSE 1 END)::DOUBLE AS xd FROM y4 WHERE rn = 0
  UNION ALL
  SELECT y4.symbol, y4.rn, {_step(9, 's2.macd_signal', 'y4.macd')},
    s2.xn * 13 / 14 + coalesce(y4.dxb, 0), s2.xd * 13 / 14 + (CASE WHEN y4.dxb IS NULL THEN 0 ELSE 1 END)
  FROM s2 JOIN y4 ON y4.symbol = s2.symbol AND y4.rn = s2.rn + 1),
z1 AS (SELECT y4.*, macd_signal, macd - macd_signal AS macd_histogram,
    CASE WHEN xd > 0 THEN xn / xd END AS adx, close - 2 * atr AS stop_loss
  FROM y4 JOIN s2 USING (symbol, rn)),
f AS (SELECT *, macd_histogram - {lag('macd_histogram')} AS macd_histogram_slope,
    {flag(f"macd > macd_signal AND {lag('macd')} <= {lag('macd_signal')}")} AS macd_bullish_cross,
    {div('resistance_level - close', 'close - stop_loss')} AS risk_reward_ratio
  FROM z1)"""


def feature_ctes(bars: str = EVENT_BARS, scans: bool = True) -> str:
    return f"WITH RECURSIVE {bars},{finite_ctes()}{scan_ctes() if scans else ''}"


INTEGERS = {"day", "month", "year", "rsi_overbought", "rsi_oversold", "macd_bullish_cross",
            "ichimoku_bearish", "ichimoku_bullish", "direction", "trend", "high_volume_zone",
            "tick_volume", "spread", "buy_volume", "sell_volume"}


def shown(column: str, expr: str | None = None, digits: int = 6) -> str:
    expr = expr or f'"{column}"'
    if column in INTEGERS:
        return f'CAST({expr} AS BIGINT) AS "{column}"'
    return f'round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS "{column}"'


def features(columns, bars: str = EVENT_BARS, scans: bool = False, digits: int = 6) -> str:
    """Unfilled feature columns."""
    picked = ", ".join(shown(c, digits=digits) for c in columns)
    return f"{feature_ctes(bars, scans)}\nSELECT symbol, time, {picked} FROM {'f' if scans else 'x6'}"


def filled(columns, bars: str = EVENT_BARS, backward: bool = True, digits: int = 6) -> str:
    """Feature columns after the forward (and backward) fill."""
    def fill(c: str) -> str:
        past = (f'last_value("{c}" IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time '
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        coming = (f'first_value("{c}" IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time '
                  "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
        return shown(c, f"coalesce({past}, {coming})" if backward else past, digits)
    picked = ",\n".join(fill(c) for c in columns)
    return f"{feature_ctes(bars)}\nSELECT symbol, time, {picked} FROM f"
