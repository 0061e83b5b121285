"""From bars to decisions, in batch and as of any time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import decide as D
from tickloom.operators.asof import as_of_join
from tickloom.operators.rules import confidence_gate, verdict, votes
from tickloom.plans.features import feature_table
from tickloom.plans.presets import StrategyConfig
from tickloom.schema import DECISION_COLUMNS

# Adds the probability columns ``{prefix}_p0`` and ``{prefix}_p1`` to a feature table.
Scorer = Callable[[DataFrame, StrategyConfig, str], DataFrame]


def needed_features(*configs: StrategyConfig, extra: Sequence[str] = ()) -> list[str]:
    names = [n for c in configs for n in c.features] + list(extra)
    base = ("tick_volume", "open", "high", "low", "close", "spread")
    return [n for n in dict.fromkeys(names) if n not in base]


def verdict_columns(config: StrategyConfig, prefix: str) -> list[Column]:
    """Both probabilities of a side and its verdict."""
    p0, p1, side = F.col(f"{prefix}_p0"), F.col(f"{prefix}_p1"), config.side
    return [p0.alias(f"class0_{side}"), p1.alias(f"class1_{side}"),
            verdict(p0, p1, config.threshold, votes(config.rules), config.min_votes)
            .alias(f"confir_{side}")]


def answer_column(config: StrategyConfig, prefix: str) -> Column:
    """The request service's answer of a side."""
    gate = confidence_gate(F.col(f"{prefix}_p0"), F.col(f"{prefix}_p1"), config.threshold)
    enough = votes(config.rules) >= (config.service_votes or config.min_votes)
    return (F.when(~gate, "below_threshold").when(enough, config.side.upper())
            .otherwise("not_strong").alias(f"action_{config.side}"))


def decide(
    bars: DataFrame, buy: StrategyConfig, sell: StrategyConfig, scorer: Scorer,
    extra: Sequence[str] = (), view: str = "history", bar_seconds: int = 3600,
) -> DataFrame:
    """Decision table of all symbols in one pass, judged by one strategy.

    Both sides are scored on the same feature row, so their verdicts meet without a join.
    """
    features = feature_table(bars, needed_features(buy, sell, extra=extra), view,
                             bar_seconds=bar_seconds)
    scored = scorer(scorer(features, buy, "buy"), sell, "sell")
    both = [*verdict_columns(buy, "buy"), *verdict_columns(sell, "sell")]
    return D.final_decision(scored.select("symbol", F.col("time").alias("datetime"), *both).select(
        "symbol", *DECISION_COLUMNS))


def answer_rows(
    features: DataFrame, buy: StrategyConfig, sell: StrategyConfig, scorer: Scorer,
) -> DataFrame:
    """The request service's answer for every feature row."""
    scored = scorer(scorer(features, buy, "buy"), sell, "sell")
    return _with_action(scored.select("symbol", "time", "tick_volume",
                                      answer_column(sell, "sell"), answer_column(buy, "buy")))


def _with_action(answers: DataFrame) -> DataFrame:
    return answers.withColumn(
        "action", D.service_action(F.col("action_sell"), F.col("action_buy")))


def service_answers(
    bars: DataFrame, buy: StrategyConfig, sell: StrategyConfig, scorer: Scorer,
    extra: Sequence[str] = (), bar_seconds: int = 3600,
) -> DataFrame:
    """The request service's answer at every bar, each as if the history ended there.

    One pass over the ``as_of`` features replaces a recompute per request: every feature of a bar
    depends on earlier bars only, and the lagging span takes its cut-off value.
    """
    needed = needed_features(buy, sell, extra=extra)
    features = feature_table(bars, needed, "as_of", bar_seconds=bar_seconds)
    return answer_rows(features, buy, sell, scorer)


# --- many strategies, each on its own symbol -------------------------------------------------

Pair = tuple[StrategyConfig, StrategyConfig]    # buy and sell side of one strategy


def routed(
    bars: DataFrame, strategies: Sequence[Pair], scorer: Scorer,
    judged: Callable[[StrategyConfig, str], list[Column]],
    extra: Sequence[str] = (), view: str = "history", bar_seconds: int = 3600,
) -> DataFrame:
    """One row per strategy and bar of its symbol, with the ``judged`` columns of both sides.

    Features are built once, for the symbols that some strategy names; scoring, judging and
    routing are projections over those rows, and nothing shuffles for them. A bar whose symbol has
    several strategies gives a row for each.
    """
    if not strategies:
        raise ValueError("no strategy given")
    for buy, sell in strategies:
        if (buy.name, buy.symbol) != (sell.name, sell.symbol):
            raise ValueError(f"sides of different strategies: {buy.name}, {sell.name}")
    if len({buy.name for buy, _ in strategies}) < len(strategies):
        raise ValueError("strategy names must differ")
    sides = [c for pair in strategies for c in pair]
    named = bars.filter(F.col("symbol").isin(sorted({c.symbol for c in sides})))
    scored = feature_table(named, needed_features(*sides, extra=extra), view,
                           bar_seconds=bar_seconds)
    cases = []
    for number, (buy, sell) in enumerate(strategies):
        kept, b, s = scored.columns, f"_buy{number}", f"_sell{number}"
        # A scorer may leave its own working columns; the next one starts without them.
        scored = scorer(scorer(scored, buy, b).select(*kept, f"{b}_p0", f"{b}_p1"), sell, s).select(
            *kept, *[f"{p}_{x}" for p in (b, s) for x in ("p0", "p1")])
        cases.append(F.when(F.col("symbol") == buy.symbol, F.struct(
            F.lit(buy.name).alias("strategy"), *judged(buy, b), *judged(sell, s))))
    rows = F.explode(F.array_compact(F.array(*cases))).alias("_v")
    return scored.select("symbol", "time", "tick_volume", rows).select(
        "symbol", "time", "tick_volume", "_v.*")


def strategy_decisions(
    bars: DataFrame, strategies: Sequence[Pair], scorer: Scorer, extra: Sequence[str] = (),
    view: str = "history", bar_seconds: int = 3600,
) -> DataFrame:
    """Decision table of many strategies, each over the bars of its own symbol."""
    rows = routed(bars, strategies, scorer, verdict_columns, extra, view, bar_seconds)
    return D.final_decision(rows.withColumnRenamed("time", "datetime").select(
        "strategy", "symbol", *DECISION_COLUMNS))


def strategy_answers(
    bars: DataFrame, strategies: Sequence[Pair], scorer: Scorer, extra: Sequence[str] = (),
    bar_seconds: int = 3600,
) -> DataFrame:
    """The request service's answers of many strategies, one row per strategy and bar."""
    rows = routed(bars, strategies, scorer, lambda c, prefix: [answer_column(c, prefix)], extra,
                  "as_of", bar_seconds)
    return _with_action(rows.select(
        "strategy", "symbol", "time", "tick_volume", "action_sell", "action_buy"))


def strategy_of(strategies: Sequence[StrategyConfig]) -> tuple[Column, Column]:
    """Name and symbol of the strategy whose prefix fits a request's ``strategy`` best."""
    name = symbol = F.lit(None).cast("string")
    for alias, c in sorted(((a, c) for c in strategies for a in c.aliases), key=lambda x: len(x[0])):
        fits = F.col("strategy").startswith(alias)
        name = F.when(fits, c.name).otherwise(name)
        symbol = F.when(fits, c.symbol).otherwise(symbol)
    return name, symbol


def decisions_as_of(
    requests: DataFrame, answers: DataFrame, strategies: Sequence[StrategyConfig],
    bar_seconds: int = 3600,
) -> DataFrame:
    """Answer ``(strategy, to_time)`` requests from a table of answers keyed ``(strategy, time)``.

    A request names a strategy by prefix (the longest that fits) and gets that strategy's own
    answer, also where several strategies judge one symbol. An unknown one gets ``NO_STRG``, one
    before the first bar gets NULL. ``symbol`` is the strategy's.
    """
    name, symbol = strategy_of(strategies)
    named = requests.withColumns({"_strategy": name, "symbol": symbol})
    known = answers.select(F.col("strategy").alias("_strategy"), F.col("time").alias("bar_time"),
                           "action_sell", "action_buy", "action")
    found = as_of_join(named, known, "bar_time", "to_time",
                       ["bar_time", "action_sell", "action_buy", "action"], bar_seconds,
                       key="_strategy")
    return found.withColumn("action", F.when(F.col("_strategy").isNull(), "NO_STRG").otherwise(
        F.col("action"))).drop("_strategy")
