"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BAR = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("tick_volume", T.LongType()),
    T.StructField("spread", T.IntegerType()),
])

# Columns in one exported file per symbol, before the symbol column is attached.
EXPORT_BAR = T.StructType([f for f in BAR.fields if f.name != "symbol"] + [
    T.StructField("real_volume", T.LongType()),
])

DECISION_COLUMNS = [
    "datetime", "class0_buy", "class1_buy", "class0_sell", "class1_sell",
    "confir_buy", "confir_sell",
]

STALE_CHECK_COLUMNS = ["timestamp", "currency_pair", "final_decision", "confidence_score"]

REVIEW = T.StructType([T.StructField(c, T.StringType()) for c in (
    "timestamp_local", "timestamp_market", "currency_pair", "model_suggestion",
    "agent_decision", "justification", "entry", "stop_loss", "take_profit",
)])

EXECUTION = T.StructType([T.StructField(c, T.StringType()) for c in (
    "Entry", "Stop_Loss", "Take_Profit",
)])

PARSED_LOG = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("decision", T.StringType()),
    T.StructField("entry", T.StringType()),
    T.StructField("stop_loss", T.StringType()),
    T.StructField("take_profit", T.StringType()),
])

RULE = T.StructType([
    T.StructField("strategy", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
    T.StructField("min_votes", T.LongType()),
    T.StructField("threshold", T.DoubleType()),
])


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail early, naming what is missing; returns ``df`` so that calls chain."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
