"""From two side verdicts to a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import DECISION_COLUMNS, STALE_CHECK_COLUMNS, require_columns

ACTIONABLE = ("sell", "buy")


def verdict_join(buy: DataFrame, sell: DataFrame) -> DataFrame:
    """Both sides of a bar; a time repeated on one side fans out."""
    return buy.join(sell, ["symbol", "datetime"]).select("symbol", *DECISION_COLUMNS)


def decision(buy: Column, sell: Column) -> Column:
    """The 3x3 verdict table; any other verdict gives ``unknown``."""
    known = ("confirm", "not_strong", "below_threshold")
    return (F.when(~F.coalesce(buy.isin(*known) & sell.isin(*known), F.lit(False)), "unknown")
            .when((buy == "confirm") & (sell == "confirm"), "indecision")
            .when(buy == "confirm", "buy")
            .when(sell == "confirm", "sell")
            .otherwise("do_nothing"))


def final_decision(joined: DataFrame, pair: Column | None = None) -> DataFrame:
    """Decision column and the pair the decision is about."""
    return joined.withColumn("final_decision", decision(F.col("confir_buy"), F.col("confir_sell"))
                             ).withColumn("currency_pair", F.col("symbol") if pair is None else pair)


def verdict_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("confir_buy", "confir_sell").agg(F.count(F.lit(1)).alias("n"))


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("final_decision").agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Newest row per symbol of a bar table, whose ``(symbol, time)`` are unique (otherwise all
    rows of the newest time).

    A hash aggregation finds the newest times, one row a symbol, and a join fetches their rows:
    nothing is sorted. ``df`` is read twice: pass a written table.
    """
    newest = df.groupBy("symbol").agg(F.max(time).alias(time))
    return df.join(newest, ["symbol", time], "left_semi")


def latest_decision(decided: DataFrame) -> DataFrame:
    """Newest decision per symbol and whether it asks for a trade."""
    return latest(decided).withColumn(
        "actionable", F.col("final_decision").isin(*ACTIONABLE))


def actionable(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("final_decision").isin(*ACTIONABLE))


def fresh(decided: DataFrame, now: str, time: str = "timestamp") -> DataFrame:
    """Rows younger than one hour at ``now`` (a fixed instant, so reruns agree)."""
    newest = F.lit(now).cast("timestamp_ntz")
    return decided.filter(F.col(time) > newest - F.expr("INTERVAL 1 HOUR"))


def review_candidates(decided: DataFrame, now: str) -> DataFrame:
    """Fresh, actionable decisions with a valid pair, after a check of the input columns."""
    checked = require_columns(decided, STALE_CHECK_COLUMNS)
    return normalise_pair(actionable(fresh(checked, now)))


def normalise_pair(df: DataFrame, column: str = "currency_pair") -> DataFrame:
    """Pair without spaces, upper case; rows that are not ``AAA/BBB`` are dropped."""
    pair = F.upper(F.replace(F.col(column), F.lit(" "), F.lit("")))
    return df.withColumn(column, pair).filter(F.col(column).rlike("^[A-Z]{3}/[A-Z]{3}$"))


def service_action(sell: Column, buy: Column) -> Column:
    """Answer of the request service from the side answers SELL / BUY / other."""
    return (F.when((sell == "SELL") & (buy == "BUY"), "INDIRECTION")
            .when((sell == "HOLD") & (buy == "HOLD"), "HOLD")
            .when(sell == "SELL", "SELL").when(buy == "BUY", "BUY").otherwise(""))


def service_action_v1(sell: Column, buy: Column) -> Column:
    """The stricter first version: one side must be silent for the other to count."""
    return (F.when((sell == "SELL") & (buy == "BUY"), "INDIRECTION")
            .when((sell == "HOLD") & (buy == "HOLD"), "HOLD")
            .when((sell == "SELL") & (buy == ""), "SELL")
            .when((sell == "") & (buy == "BUY"), "BUY").otherwise(""))


def class_action(p0: Column, p1: Column, confident: Column, action: str) -> Column:
    """``action`` if class 1 leads, HOLD if not, nothing without confidence."""
    return F.when(~F.coalesce(confident, F.lit(False)), "").when(p1 > p0, action).otherwise("HOLD")


def volume_confirm(action: Column, volume: Column, min_sell: int, min_buy: int) -> Column:
    """Mark a trade whose bar volume is under the side's minimum."""
    thin = ((action == "SELL") & (volume < min_sell)) | ((action == "BUY") & (volume < min_buy))
    return F.when(thin, F.concat(action, F.lit("_NO_VOL"))).otherwise(action)
