"""DuckDB statement per registered query (none where SQL cannot express the operator)."""

from __future__ import annotations

from tickloom.catalog import queries as Q
from tickloom.catalog.oracle import (
    EVENT_BARS, ORDER_BARS, div, feature_ctes, features, filled, flag, shown,
)
from tickloom.operators.indicators import COLUMNS

BAR_COLUMNS = ("open", "high", "low", "close", "tick_volume", "spread")


def _bars(bars: str = EVENT_BARS, where: str = "") -> str:
    return f"WITH {bars} SELECT symbol, time, {', '.join(shown(c) for c in BAR_COLUMNS)} FROM bars {where}"


def _cut(condition: str) -> str:
    """Bars with a time filter applied before any feature."""
    return EVENT_BARS.replace("bars AS MATERIALIZED", "all_bars AS MATERIALIZED") + (
        f",\nbars AS MATERIALIZED (SELECT * FROM all_bars WHERE {condition})")


def _ewm() -> str:
    return f"""{feature_ctes()},
g AS MATERIALIZED (SELECT symbol, rn, flow FROM x6),
e AS (SELECT symbol, rn, coalesce(flow, 0)::DOUBLE AS n, (CASE WHEN flow IS NULL THEN 0 ELSE 1 END)::DOUBLE AS d
      FROM g WHERE rn = 0
      UNION ALL
      SELECT g.symbol, g.rn, e.n * 13 / 14 + coalesce(g.flow, 0),
             e.d * 13 / 14 + (CASE WHEN g.flow IS NULL THEN 0 ELSE 1 END)
      FROM e JOIN g ON g.symbol = e.symbol AND g.rn = e.rn + 1)
SELECT symbol, time, round(CASE WHEN d > 0 THEN n / d END, 6) + 0.0 AS flow_ewm,
       {shown('dm_up_ewm', 'up_avg')}, {shown('dm_down_ewm', 'down_avg')}
FROM f JOIN e USING (symbol, rn)"""


HOLED = f"""WITH RECURSIVE {ORDER_BARS},
holes AS (SELECT *, time < DATE '1992-01-20' AND tick_volume % 2 = 0
    OR symbol[1] IN ('2', '4') AND CAST(time AS DATE) = DATE '1996-07-01' AS hole FROM bars),
h AS MATERIALIZED (SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS rn,
    CASE WHEN NOT hole THEN high END AS high, CASE WHEN NOT hole THEN low END AS low,
    CASE WHEN NOT hole AND spread % 3 <> 0 THEN close END AS close FROM holes)"""


def _gap_step(name: str, span: int, x: str) -> tuple[str, str, str]:
    """First value, next value and next weight of an exponential mean over missing values: what came
    before weighs the decay of all rows since, and both weights are scaled to one."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return (f"CAST({x} AS DOUBLE) AS {name}, 1.0::DOUBLE AS w_{name}",
            f"CASE WHEN {x} IS NULL THEN e.{name} WHEN e.{name} IS NULL THEN {x} ELSE "
            f"(e.w_{name} * (1 - {a}) * e.{name} + {a} * {x}) / (e.w_{name} * (1 - {a}) + {a}) END",
            f"CASE WHEN {x} IS NULL THEN e.w_{name} * (1 - {a}) ELSE 1 END")


def _ema_gappy() -> str:
    spans = {"ema_10": 10, "ema_12": 12, "ema_20": 20, "ema_26": 26, "ema_50": 50}
    start = ", ".join(_gap_step(n, s, "close")[0] for n, s in spans.items())
    step = ", ".join(part for n, s in spans.items() for part in _gap_step(n, s, "h.close")[1:])
    first, value, weight = _gap_step("macd_signal", 9, "m.macd")
    picked = ", ".join(shown(c, digits=Q.ORDER_RUNNING_DIGITS) for c in Q.EMA_GAPPY)
    return f"""{HOLED},
e AS (SELECT symbol, rn, {start} FROM h WHERE rn = 0
      UNION ALL SELECT h.symbol, h.rn, {step} FROM e JOIN h ON h.symbol = e.symbol AND h.rn = e.rn + 1),
m AS MATERIALIZED (SELECT e.*, time, ema_12 - ema_26 AS macd FROM e JOIN h USING (symbol, rn)),
g AS (SELECT symbol, rn, {first.replace('m.', '')} FROM m WHERE rn = 0
      UNION ALL SELECT m.symbol, m.rn, {value.replace('e.', 'g.')}, {weight.replace('e.', 'g.')}
      FROM g JOIN m ON m.symbol = g.symbol AND m.rn = g.rn + 1)
SELECT symbol, time, {picked} FROM m JOIN g USING (symbol, rn)"""


def _atr_gappy() -> str:
    return f"""{HOLED},
t AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range FROM (
    SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS pc FROM h)),
e AS (SELECT symbol, 13 AS rn, avg(true_range) AS atr FROM t WHERE rn <= 13 GROUP BY symbol
      UNION ALL SELECT t.symbol, t.rn, (e.atr * 13 + t.true_range) / 14
      FROM e JOIN t ON t.symbol = e.symbol AND t.rn = e.rn + 1)
SELECT symbol, time, {shown('true_range', digits=Q.ORDER_RUNNING_DIGITS)},
       {shown('atr', 'CASE WHEN t.rn < 13 THEN 0 ELSE atr END', digits=Q.ORDER_RUNNING_DIGITS)}
FROM t LEFT JOIN e USING (symbol, rn)"""


def _gappy(backward: bool) -> str:
    frame = ("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING" if backward
             else "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    fn = "first_value" if backward else "last_value"
    return f"""WITH {ORDER_BARS},
g AS (SELECT symbol, time, CASE WHEN spread % 3 <> 0 THEN close END AS gappy FROM bars)
SELECT symbol, time, round({fn}(gappy IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time {frame}), 6) + 0.0 AS gappy
FROM g"""


# --- scoring and decisions -------------------------------------------------------------------

def _logit(weights: dict[str, float], bias: float = 0.0) -> str:
    z = " + ".join([f"({bias}::DOUBLE)"] + [
        f"coalesce({n}::DOUBLE, 0) * ({w}::DOUBLE)" for n, w in weights.items()])
    return f"(1 / (1 + exp(-({z}))))"


def _fill_sql(c: str, backward: bool) -> str:
    past = (f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    coming = (f"first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time "
              "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    return f"coalesce({past}, {coming})" if backward else past


def _inside(rule) -> str:
    parts = ([f"{rule.feature} >= {rule.lo}::DOUBLE"] if rule.lo is not None else []) + (
        [f"{rule.feature} <= {rule.hi}::DOUBLE"] if rule.hi is not None else [])
    return flag(" AND ".join(parts))


def _votes(config) -> str:
    return " + ".join(_inside(r) for r in config.rules)


def scored_ctes(backward: bool = True, bars: str = EVENT_BARS) -> str:
    """Filled features, both stacked scores and both vote counts."""
    names = list(dict.fromkeys([*Q.P.needed_features(Q.BUY, Q.SELL, extra=Q.SCORED_ON)]))
    cols = ", ".join(f"{_fill_sql(n, backward)} AS {n}" for n in names)
    return f"""{feature_ctes(bars)},
g AS (SELECT symbol, time, tick_volume, price_range AS price_range_raw,
      {cols} FROM f),
b AS (SELECT *, {_logit(Q.BASE_A)} AS zero_pred_1, {_logit(Q.BASE_B)} AS one_pred_1 FROM g),
b2 AS (SELECT *, 1 - zero_pred_1 AS zero_pred_0, 1 - one_pred_1 AS one_pred_0 FROM b),
m AS (SELECT *, {_logit(Q.META_BUY, Q.BIAS['buy'])} AS buy_p1, {_logit(Q.META_SELL, Q.BIAS['sell'])} AS sell_p1,
      {_votes(Q.BUY)} AS buy_votes, {_votes(Q.SELL)} AS sell_votes FROM b2),
s AS (SELECT *, 1 - buy_p1 AS buy_p0, 1 - sell_p1 AS sell_p0 FROM m)"""


def _confir(side: str, config) -> str:
    return (f"CASE WHEN NOT (greatest({side}_p0, {side}_p1) >= {config.threshold}) THEN 'below_threshold' "
            f"WHEN {side}_votes >= {config.min_votes} THEN 'confirm' ELSE 'not_strong' END")


FINAL = """CASE confir_buy || '/' || confir_sell
        WHEN 'confirm/confirm' THEN 'indecision'
        WHEN 'confirm/not_strong' THEN 'buy' WHEN 'confirm/below_threshold' THEN 'buy'
        WHEN 'not_strong/confirm' THEN 'sell' WHEN 'below_threshold/confirm' THEN 'sell'
        ELSE 'do_nothing' END"""


def _tree_scores() -> str:
    """Trees walked node by node, one row for each bar and tree."""
    def value(x) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    nodes = ", ".join(f"({', '.join(map(value, n))})" for n in Q.DUMPED)
    base = (*Q.TREE_FEATURES, "tick_volume")

    def walk(name: str, source: str, models: str, columns) -> str:
        x = "CASE n.feature " + " ".join(f"WHEN '{c}' THEN CAST(b.\"{c}\" AS DOUBLE)" for c in columns) + " END"
        x = f"({x})"
        return f"""
{name}w AS (SELECT symbol, time, model, tree, 0 AS node FROM {source}
      JOIN (SELECT DISTINCT model, tree FROM nodes) t ON model IN ({models})
    UNION ALL SELECT w.symbol, w.time, w.model, w.tree, CASE WHEN {x} IS NULL OR NOT isfinite({x})
      AND isnan({x}) THEN n.missing WHEN n.test = '<' AND {x} < n.threshold
      OR n.test = '<=' AND {x} <= n.threshold THEN n.yes ELSE n.no END
    FROM {name}w w JOIN nodes n USING (model, tree, node) JOIN {source} b ON b.symbol = w.symbol AND b.time = w.time
    WHERE n.feature IS NOT NULL),
{name} AS (SELECT symbol, time, model, 1 / (1 + exp(-sum(n.value))) AS p FROM {name}w
    JOIN nodes n USING (model, tree, node) WHERE n.feature IS NULL GROUP BY ALL)"""

    picked = ", ".join(shown(c) for c in (
        "zero_pred_0", "zero_pred_1", "one_pred_0", "one_pred_1", "up_p0", "up_p1"))
    return f"""{feature_ctes()},
nodes(model, tree, node, feature, test, threshold, yes, no, missing, value) AS (VALUES {nodes}),
bars_in AS MATERIALIZED (SELECT symbol, time, {', '.join(f'"{c}"' for c in base)} FROM f),
{walk('s', 'bars_in', "'base_a', 'base_b'", base)},
based AS MATERIALIZED (SELECT b.*, a.p AS zero_pred_1, 1 - a.p AS zero_pred_0, o.p AS one_pred_1, 1 - o.p AS one_pred_0
    FROM bars_in b JOIN s a ON a.symbol = b.symbol AND a.time = b.time AND a.model = 'base_a'
    JOIN s o ON o.symbol = b.symbol AND o.time = b.time AND o.model = 'base_b'),
{walk('t', 'based', "'meta'", ('zero_pred_1', 'one_pred_0', 'stochastic_k'))},
done AS (SELECT based.*, 1 - p AS up_p0, p AS up_p1 FROM based JOIN t USING (symbol, time))
SELECT symbol, time, {picked}, CAST(up_p1 > up_p0 AS BIGINT) AS up_class FROM done"""


def _votes_many() -> str:
    """Every rule of every bar, one after another."""
    value = "CASE r.feature " + " ".join(f"WHEN '{c}' THEN f.\"{c}\"" for c in Q.MANY_FEATURES) + " END"
    return f"""{feature_ctes()},
filled AS (SELECT symbol, time, {', '.join(_fill_sql('"' + c + '"', True) + f' AS "{c}"' for c in Q.MANY_FEATURES)} FROM f),
rules AS ({' UNION ALL '.join(
    f"""SELECT 's' || p_partkey AS strategy, CASE WHEN p_size % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
    '{c}' AS feature, {lo} AS lo, {hi} AS hi FROM part WHERE {where}"""
    for c, lo, hi, where in Q.MANY_RULES)}),
votes AS (SELECT f.symbol, f.time, strategy, side, sum(CASE WHEN v IS NOT NULL AND (lo IS NULL OR v >= lo)
    AND (hi IS NULL OR v <= hi) THEN 1 ELSE 0 END) AS votes
  FROM (SELECT f.symbol, f.time, r.strategy, r.side, r.lo, r.hi, {value} AS v FROM filled f, rules r) f
  GROUP BY ALL)
SELECT strategy, side, CAST(count(*) AS BIGINT) AS bars, CAST(sum(votes) AS BIGINT) AS votes,
       CAST(max(votes) AS BIGINT) AS most, CAST(count_if(votes >= 2) AS BIGINT) AS strong
FROM votes GROUP BY ALL"""


def _side_votes(side: str, config) -> str:
    """The side's case with its own rules in place of the common vote column."""
    return _confir(side, config).replace(f"{side}_votes", f"({_votes(config)})")


def _strategy_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{buy.name}' AS strategy, symbol, time AS datetime, buy_p0 AS class0_buy, "
        f"buy_p1 AS class1_buy, sell_p0 AS class0_sell, sell_p1 AS class1_sell, "
        f"{_side_votes('buy', buy)} AS confir_buy, {_side_votes('sell', sell)} AS confir_sell "
        f"FROM s WHERE symbol = '{buy.symbol}'" for buy, sell in Q.STRATEGIES)


def _strategy_answers() -> str:
    def answer(side: str, c) -> str:
        return (f"CASE WHEN NOT (greatest({side}_p0, {side}_p1) >= {c.threshold}) THEN 'below_threshold' "
                f"WHEN ({_votes(c)}) >= {c.service_votes} THEN '{side.upper()}' ELSE 'not_strong' END")
    return " UNION ALL ".join(
        f"SELECT '{buy.name}' AS name, symbol, time, {answer('buy', buy)} AS b, {answer('sell', sell)} AS s "
        f"FROM s WHERE symbol = '{buy.symbol}'" for buy, sell in Q.STRATEGIES)


def decided_ctes(bars: str = EVENT_BARS) -> str:
    return f"""{scored_ctes(bars=bars)},
v AS (SELECT symbol, time AS datetime, buy_p0 AS class0_buy, buy_p1 AS class1_buy,
      sell_p0 AS class0_sell, sell_p1 AS class1_sell,
      {_confir('buy', Q.BUY)} AS confir_buy, {_confir('sell', Q.SELL)} AS confir_sell FROM s),
d AS (SELECT *, {FINAL} AS final_decision,
      upper(substr(symbol, 1, 3) || '/ usd') AS currency_pair FROM v)"""


P_SHOWN = ", ".join(shown(c) for c in ("class0_buy", "class1_buy", "class0_sell", "class1_sell"))


def answered_ctes() -> str:
    def answer(side: str, config) -> str:
        return (f"CASE WHEN NOT (greatest({side}_p0, {side}_p1) >= {config.threshold}) THEN 'below_threshold' "
                f"WHEN {side}_votes >= {config.service_votes} THEN '{side.upper()}' ELSE 'not_strong' END")
    return f"""{scored_ctes(backward=False)},
a0 AS (SELECT symbol, time, tick_volume, {answer('sell', Q.SELL)} AS action_sell,
       {answer('buy', Q.BUY)} AS action_buy FROM s),
a AS (SELECT *, CASE WHEN action_sell = 'SELL' AND action_buy = 'BUY' THEN 'INDIRECTION'
        WHEN action_sell = 'SELL' THEN 'SELL' WHEN action_buy = 'BUY' THEN 'BUY' ELSE '' END AS action FROM a0)"""


def _v1() -> str:
    def side(s: str, config) -> str:
        return (f"CASE WHEN NOT (greatest({s}_p0, {s}_p1) >= {config.threshold}) THEN '' "
                f"WHEN {s}_p1 > {s}_p0 THEN '{s.upper()}' ELSE 'HOLD' END")
    return f"""{scored_ctes(backward=False)},
a AS (SELECT symbol, time, {side('sell', Q.SELL)} AS action_sell, {side('buy', Q.BUY)} AS action_buy FROM s)
SELECT *, CASE action_sell || '/' || action_buy WHEN 'SELL/BUY' THEN 'INDIRECTION' WHEN 'HOLD/HOLD' THEN 'HOLD'
  WHEN 'SELL/' THEN 'SELL' WHEN '/BUY' THEN 'BUY' ELSE '' END AS action FROM a"""


def _votes_sql(config) -> str:
    return (f"SELECT symbol, time, '{config.name}' AS strategy, '{config.side}' AS side, "
            f"CAST({config.side}_votes AS BIGINT) AS votes FROM s")


# --- reviews ---------------------------------------------------------------------------------

RESPONSES = r"""
r0 AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS p FROM events),
r AS (SELECT event_id AS response_id, ts, event_type AS kind,
  CASE event_type WHEN 'error' THEN 'Error: 500, retry ' || event_id
    WHEN 'view' THEN 'FINAL DECISION: [CONFIRM]' || chr(10)
    WHEN 'click' THEN 'FINAL DECISION: CONFIRM** ' || chr(10)
    WHEN 'signup' THEN '**FINAL DECISION: REJECT** ' || chr(10) ELSE 'no verdict' || chr(10) END
  || CASE event_id % 3 WHEN 0 THEN 'Justification: seen ' || event_id || chr(9) || 'times ' || chr(10) || chr(10) || 'more' || chr(10)
    WHEN 1 THEN 'Justification:' || chr(10) || ' level ' || p || chr(10) ELSE '' END
  || 'Trade Execution' || chr(10) || '- Entry: [' || p || CASE WHEN event_id % 5 = 0 THEN '-' || (p + 7) ELSE '' END || ']' || chr(10)
  || CASE WHEN event_id % 7 <> 0 THEN '- Stop Loss: [' || (p - 5) || ']' || chr(10) ELSE '' END
  || CASE WHEN event_id % 4 = 0 THEN '- take profit : ' || (p + 9) || chr(10) ELSE '' END
  || '- Take Profit: [' || (p + 11) || ']' || chr(10)
  || CASE WHEN event_id % 6 = 0 THEN '*Entry*: [' || p || '] *Stop Loss*: [' || (p - 1) || ']' || chr(10) ELSE '' END
  || CASE event_id % 8 WHEN 0 THEN '{"action": "' || event_type || '", "score": ' || event_id || '}' WHEN 1 THEN '{broken: }' ELSE '' END
  AS response FROM r0)"""

STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
DECISION = (r"CASE WHEN regexp_matches(response, 'FINAL DECISION: (CONFIRM|REJECT)') "
            r"THEN regexp_extract(response, 'FINAL DECISION: (CONFIRM|REJECT)', 1) ELSE 'UNKNOWN' END")
JUSTIFICATION = ("CASE WHEN contains(response, 'Justification:') THEN "
                 + STRIP.format(r"regexp_extract(response, 'Justification:((?s:.*?))(?:\n\n|\z)', 1)")
                 + " ELSE 'No justification provided' END")


def _price(label: str, strict: bool = False) -> str:
    pattern = (rf"(?i)\*{label}\*:\s*\[([\d\.-]+-?[\d\.-]*)\]" if strict
               else rf"(?i){label}\s*:\s*\[?([\d\.-]+(?:-[\d\.-]+)?)\]?")
    return f"list_extract(regexp_extract_all(response, '{pattern}', 1), -1)"


def parsed_ctes() -> str:
    return f"""WITH {RESPONSES},
pr AS (SELECT response_id, ts, response, kind, {DECISION} AS agent_decision, {JUSTIFICATION} AS justification,
  {_price('Entry')} AS entry, {_price('Stop Loss')} AS stop_loss, {_price('Take Profit')} AS take_profit FROM r)"""


ZONES = ("strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS timestamp_local, "
         "strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS timestamp_market")

RECORD = (r"FINAL DECISION:\s*((?s:.*?))\*\*(?s:.*?)Trade Execution(?s:.*?)- Entry:\s*\[([\d\.-]+)\]"
          r"(?s:.*?)- Stop Loss:\s*\[([\d\.]+)\](?s:.*?)- Take Profit:\s*\[([\d\.]+)\]")


def _as_of(columns) -> str:
    """Forward fill only, with the lagging span as a history cut at the row has it."""
    return filled(columns, backward=False).replace(
        'last_value("ichimoku_lagging" IGNORE NULLS)',
        "last_value(CASE WHEN rn >= 26 THEN close END IGNORE NULLS)")


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    for name, columns in Q.FINITE.items():
        sql[name] = features(columns)
    for name, columns in Q.RUNNING.items():
        sql[name] = features(columns, scans=True)
    for name, columns in Q.DAILY_FINITE.items():
        sql[name] = features(columns, ORDER_BARS)
    for name, columns in Q.DAILY_RUNNING.items():
        sql[name] = features(columns, ORDER_BARS, True, Q.ORDER_RUNNING_DIGITS)
    sql["feature_table"] = filled(COLUMNS)
    sql["feature_table_as_of"] = _as_of(COLUMNS)
    sql["daily_feature_table"] = filled(COLUMNS, ORDER_BARS, digits=Q.ORDER_TABLE_DIGITS)
    sql["prefix_groups"] = f"""WITH {ORDER_BARS} SELECT symbol, date_diff('day', DATE '1970-01-01', time) AS day,
CAST(coalesce(sum(tick_volume) OVER w, 0) AS BIGINT) AS bars_before,
round(last_value(CASE WHEN spread % 3 <> 0 THEN close END IGNORE NULLS) OVER w, 6) + 0.0 AS close_before
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    sql["fill_forward"] = _gappy(False)
    sql["fill_backward"] = _gappy(True)
    sql["scan_bars"] = sql["snapshot_roundtrip"] = sql["build_bars_hourly"] = _bars()
    sql["stream_bars_live"] = _bars()
    sql["build_bars_daily"] = _bars(ORDER_BARS)
    sql["epoch_to_ts"] = ("SELECT event_id, make_timestamp((1704067200 + event_id * 60) * 1000000) "
                          "AS time FROM events")
    picked = ", ".join(shown(c) for c in ("ema_20", "obv", "ma_10"))
    sql["filter_since"] = (f"{feature_ctes(_cut('time >= TIMESTAMP ' + repr('2024-01-10 00:00:00')))}\n"
                           f"SELECT symbol, time, {picked} FROM f")
    sql["features_as_of"] = filled(("rsi", "ema_50", "cmf", "ichimoku_lagging"),
                                   _cut("time <= TIMESTAMP '2024-01-20 12:00:00'"))
    sql["append_dedup_last"] = _bars().replace(
        'CAST("close" AS DOUBLE)', "(CASE WHEN tick_volume % 2 = 0 THEN close + 1 ELSE close END)")
    sql["bar_store"] = sql["append_dedup_last"]
    sql["bar_store_days"] = (f"SELECT * FROM ({sql['bar_store']}) "
                             "WHERE time >= DATE '2024-01-10' AND time < DATE '2024-01-14'")
    known = filled(Q.RESTART_COLUMNS, ORDER_BARS, False, Q.ORDER_RUNNING_DIGITS)
    sql["features_restart"] = f"""WITH q AS (SELECT o_orderkey AS request_id, o_orderpriority AS symbol,
CAST(o_orderdate AS TIMESTAMP) + INTERVAL 36 HOUR AS to_time FROM orders)
SELECT request_id, q.symbol, to_time, a.time AS bar_time, {', '.join(f'a."{c}"' for c in Q.RESTART_COLUMNS)}
FROM q ASOF LEFT JOIN ({known}) a ON q.symbol = a.symbol AND q.to_time >= a.time"""
    sql["safe_division"] = (
        f"WITH {EVENT_BARS} SELECT symbol, time, {shown('body_share', div('close - open', 'high - low'))}, "
        f"{shown('close_per_extra', div('close', 'tick_volume - 1'))} FROM bars")
    sql["tz_projection"] = f"SELECT event_id, {ZONES} FROM events"
    sql["rolling_sums"] = (
        f"{feature_ctes(scans=False)} SELECT symbol, time, {shown('volume_sum_20', 'vol_sum')}, "
        f"{shown('flow_sum_20', 'flow_sum')}, {shown('price_up')} FROM x6")
    sql["ewm_adjusted"] = _ewm()
    sql["ema_gappy"] = _ema_gappy()
    sql["atr_gappy"] = _atr_gappy()

    sql["stacked_logit"] = f"{scored_ctes()} SELECT symbol, time, " + ", ".join(shown(c) for c in (
        "zero_pred_1", "one_pred_1", "buy_p0", "buy_p1", "sell_p0", "sell_p1")) + " FROM s"
    sql["confidence_gate"] = (f"{scored_ctes()} SELECT symbol, time, "
                              f"greatest(buy_p0, buy_p1) >= {Q.BUY.threshold} AS confident FROM s")
    both = f"{scored_ctes()} {_votes_sql(Q.BUY)} UNION ALL {_votes_sql(Q.SELL)}"
    sql["rule_votes_wide"] = sql["rule_votes_long"] = both
    head = decided_ctes()
    sql["verdict_join"] = f"{head} SELECT symbol, datetime, {P_SHOWN}, confir_buy, confir_sell FROM v"
    sql["final_decision"] = (f"{head} SELECT symbol, datetime, {P_SHOWN}, confir_buy, confir_sell, "
                             "final_decision, currency_pair FROM d")
    sql["daily_final_decision"] = (
        f"{decided_ctes(ORDER_BARS)} SELECT symbol, datetime, {P_SHOWN}, confir_buy, confir_sell, "
        "final_decision, currency_pair FROM d")
    sql["rule_votes_many"] = _votes_many()
    sql["tree_scores"] = _tree_scores()
    sql["rule_verdict_long"] = f"{scored_ctes()} " + " UNION ALL ".join(
        f"SELECT symbol, time, '{c.name}' AS strategy, '{c.side}' AS side, "
        f"CAST({c.side}_votes AS BIGINT) AS votes, {_confir(c.side, c)} AS verdict FROM s"
        for c in (Q.BUY, Q.SELL))
    sql["strategy_decisions"] = (
        f"{scored_ctes()}, v AS ({_strategy_rows()}) SELECT strategy, symbol, datetime, {P_SHOWN}, "
        f"confir_buy, confir_sell, {FINAL} AS final_decision, symbol AS currency_pair FROM v")
    sql["strategy_requests"] = f"""{scored_ctes(backward=False)}, a0 AS ({_strategy_answers()}),
a AS (SELECT *, CASE WHEN s = 'SELL' AND b = 'BUY' THEN 'INDIRECTION' WHEN s = 'SELL' THEN 'SELL'
      WHEN b = 'BUY' THEN 'BUY' ELSE '' END AS action FROM a0),
q AS (SELECT event_id AS request_id, ts AS to_time,
      ['Alpha-v2', 'Alpha-beta', 'Gamma', 'Delta'][event_id % 4 + 1] AS strategy,
      ['alpha', 'beta', 'gamma', NULL][event_id % 4 + 1] AS name,
      ['click', 'click', 'view', NULL][event_id % 4 + 1] AS symbol FROM events)
SELECT request_id, strategy, to_time, q.symbol, a.time AS bar_time,
       CASE WHEN q.name IS NULL THEN 'NO_STRG' ELSE a.action END AS action
FROM q ASOF LEFT JOIN a ON q.name = a.name AND q.to_time >= a.time"""
    sql["model_checks"] = f"WITH {EVENT_BARS} " + " UNION ALL ".join(
        f"SELECT '{side}' AS side, symbol, count(*) AS n, count(*) AS n_proper, count(*) AS n_whole, "
        f"count(*) AS n_likelier, CAST({len(c.meta) + 4} AS BIGINT) AS meta_inputs "
        "FROM bars GROUP BY symbol" for side, c in Q.MODEL_INPUTS.items())
    sql["model_decisions"] = (f"WITH {EVENT_BARS} SELECT symbol, count(*) AS n, count(*) AS n_legal, "
                              "count(*) AS n_times FROM bars GROUP BY symbol")
    sql["verdict_counts"] = f"{head} SELECT confir_buy, confir_sell, count(*) AS n FROM v GROUP BY 1, 2"
    sql["decision_counts"] = f"{head} SELECT final_decision, count(*) AS n FROM d GROUP BY 1"
    sql["latest_decision"] = (
        f"{head} SELECT symbol, datetime, {P_SHOWN}, confir_buy, confir_sell, final_decision, "
        "currency_pair, final_decision IN ('buy', 'sell') AS actionable FROM d "
        "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) = 1")
    sql["actionable"] = (f"{head} SELECT symbol, datetime, final_decision FROM d "
                         "WHERE final_decision IN ('buy', 'sell')")
    sql["fresh_decisions"] = (f"{head} SELECT symbol, datetime, final_decision FROM d "
                              f"WHERE TIMESTAMP '{Q.NOW}' - datetime < INTERVAL 1 HOUR")
    sql["normalise_pair"] = """WITH raw AS (SELECT event_id, substr(event_type, 1, 3) || '/ ' ||
CASE WHEN event_id % 4 = 0 THEN 'us' ELSE 'usd' END AS text FROM events),
clean AS (SELECT event_id, upper(replace(text, ' ', '')) AS currency_pair FROM raw)
SELECT * FROM clean WHERE regexp_full_match(currency_pair, '[A-Z]{3}/[A-Z]{3}')"""
    answered = answered_ctes()
    sql["service_action"] = f"{answered} SELECT symbol, time, action_sell, action_buy, action FROM a"
    sql["service_action_v1"] = _v1()
    sql["volume_confirm"] = (
        f"{answered} SELECT symbol, time, CASE WHEN action = 'SELL' AND tick_volume < {Q.SELL.min_volume} "
        f"OR action = 'BUY' AND tick_volume < {Q.BUY.min_volume} THEN action || '_NO_VOL' "
        "ELSE action END AS action FROM a")
    sql["decisions_as_of"] = f"""{answered},
q AS (SELECT event_id AS request_id, 'Str-' || event_type || '-v2' AS strategy, ts - INTERVAL 90 MINUTE AS to_time,
      CASE WHEN event_type <> 'signup' THEN event_type END AS symbol FROM events)
SELECT request_id, strategy, to_time, a.time AS bar_time,
       CASE WHEN q.symbol IS NULL THEN 'NO_STRG' ELSE a.action END AS action
FROM q ASOF LEFT JOIN a ON q.symbol = a.symbol AND q.to_time >= a.time"""
    sql["stream_requests"] = sql["decisions_as_of"]

    responses = f"WITH {RESPONSES} SELECT response_id, "
    sql["extract_decision"] = f"{responses} {DECISION} AS agent_decision FROM r"
    sql["extract_justification"] = f"{responses} {JUSTIFICATION} AS justification FROM r"
    sql["extract_execution"] = (
        f"{responses} {_price('Entry')} AS \"Entry\", {_price('Stop Loss')} AS \"Stop_Loss\", "
        f"{_price('Take Profit')} AS \"Take_Profit\" FROM r")
    sql["extract_execution_strict"] = (
        f"{responses} {_price('Entry', True)} AS entry, {_price('Stop Loss', True)} AS stop_loss, "
        f"{_price('Take Profit', True)} AS take_profit FROM r")
    block = "regexp_extract(response, '(?s)\\{.*\\}')"
    sql["extract_json"] = (
        f"SELECT response_id, json_extract_string(j, '$.action') AS action, "
        f"CAST(json_extract_string(j, '$.score') AS DOUBLE) AS score FROM (WITH {RESPONSES} SELECT "
        f"response_id, CASE WHEN json_valid({block}) THEN {block} END AS j FROM r)")
    sql["split_decision"] = (
        f"{responses} CASE WHEN contains(response, 'FINAL DECISION:') THEN "
        + STRIP.format("string_split(response, 'FINAL DECISION:')[2]") + " ELSE 'invalid' END AS answer FROM r")
    reviewed = parsed_ctes()
    sql["review_table"] = (
        f"{reviewed} SELECT {ZONES}, upper(kind) AS currency_pair, "
        "CASE WHEN response_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS model_suggestion, agent_decision, "
        "justification, coalesce(entry, '') AS entry, coalesce(stop_loss, '') AS stop_loss, "
        "coalesce(take_profit, '') AS take_profit FROM pr")
    complete = "entry IS NOT NULL AND stop_loss IS NOT NULL AND take_profit IS NOT NULL"
    answered_only = "agent_decision IN ('CONFIRM', 'REJECT')"
    sql["exec_valid"] = (
        f"{reviewed} SELECT response_id, entry, stop_loss, take_profit, "
        "regexp_full_match(entry, '[0-9.-]+') AND regexp_full_match(stop_loss, '[0-9.-]+') "
        "AND regexp_full_match(take_profit, '[0-9.-]+') AS numeric, "
        "round(string_split(entry, '-')[1]::DOUBLE, 6) AS entry_low, "
        "round(string_split(entry, '-')[-1]::DOUBLE, 6) AS entry_high "
        f"FROM pr WHERE {answered_only} AND {complete}")
    sql["exec_quarantine"] = (
        f"{reviewed} SELECT response_id, ts, response FROM pr WHERE {answered_only} AND NOT ({complete})")
    sql["build_requests"] = (
        f"{head}, h AS (SELECT *, datetime AS ts FROM d WHERE final_decision IN ('buy', 'sell')), "
        f"z AS (SELECT *, {ZONES} FROM h) "
        "SELECT symbol, datetime, timestamp_local, timestamp_market, 'Review a ' || upper(final_decision) "
        "|| ' signal for ' || currency_pair || '. Local time ' || timestamp_local || ', market time ' "
        "|| timestamp_market || '. State FINAL DECISION (CONFIRM or REJECT), Justification, Entry, "
        "Stop Loss and Take Profit.' AS request FROM z")
    stamp = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    sql["log_records"] = (f"WITH {RESPONSES} SELECT "
                          + STRIP.format(f"'Timestamp: ' || {stamp} || chr(10) || response")
                          + " AS record FROM r")
    sql["parse_log"] = (
        f"WITH {RESPONSES} SELECT date_trunc('second', ts) AS timestamp, "
        + STRIP.format(f"regexp_extract(response, '{RECORD}', 1)") + " AS decision, "
        + ", ".join(f"regexp_extract(response, '{RECORD}', {i}) AS {n}" for i, n in (
            (2, "entry"), (3, "stop_loss"), (4, "take_profit")))
        + f" FROM r WHERE regexp_matches(response, '{RECORD}')")
    sql["stream_bars"] = _bars(
        where="WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
    sql["stream_dedup"] = _bars()
    sql["stream_keep_last"] = sql["append_dedup_last"]
    sql["stream_features"] = sql["stream_features_late"] = _as_of(Q.STREAM_COLUMNS)
    sql["stream_decisions"] = sql["service_action"]
    sql["stream_log"] = sql["stream_log_growing"] = sql["parse_log"]
    sql["log_latest"] = "SELECT max(date_trunc('second', ts)) AS latest FROM events"
    return sql
