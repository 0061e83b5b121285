"""Running recursions over missing prices, against pandas and a plain loop."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tickloom.operators.blocks import exclusive_affine
from tickloom.plans.features import feature_table
from tickloom.schema import BAR


def holed(spark, n=700):
    rng = random.Random(6)
    rows, closes = [], {}
    for symbol, miss, start in (("A", 0.3, 0), ("B", 0.97, 40), ("C", 0.0, 0), ("D", 1.0, 0)):
        series = [None if i < start or rng.random() < miss else 100 + rng.random() for i in range(n)]
        if symbol == "A":
            series[200:520] = [None] * 320          # longer than several chunks
        closes[symbol] = pd.Series([np.nan if c is None else c for c in series])
        rows += [(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1.0, 200.0, 50.0, c, 1, 1)
                 for i, c in enumerate(series)]
    return spark.createDataFrame(rows, BAR), closes


@pytest.mark.parametrize("chunk", [1024, 64, 27])
def test_means_over_gaps_equal_pandas(spark, chunk):
    bars, closes = holed(spark)
    out = feature_table(bars, ["ema_10", "ema_50", "macd", "macd_signal"], "raw", chunk_rows=chunk,
                        gaps=True).toPandas().sort_values(["symbol", "time"])
    for symbol, close in closes.items():
        got = out[out.symbol == symbol]
        macd = (close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean())
        for name, want in (("ema_10", close.ewm(span=10, adjust=False).mean()),
                           ("ema_50", close.ewm(span=50, adjust=False).mean()), ("macd", macd),
                           ("macd_signal", macd.ewm(span=9, adjust=False).mean())):
            np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(), rtol=1e-9,
                                       atol=1e-9, err_msg=f"{symbol} {name}")


def test_complete_bars_give_the_same_either_way(spark, make_bars):
    bars = make_bars({"A": [100 + (i * 37 % 11) for i in range(200)]})
    columns = ["ema_20", "macd_signal", "atr", "adx", "macd_bullish_cross"]
    one, two = (feature_table(bars, columns, "raw", chunk_rows=64, gaps=g).orderBy("time").toPandas()
                for g in (False, True))
    for c in columns:
        np.testing.assert_allclose(one[c].to_numpy(float), two[c].to_numpy(float), rtol=1e-9)


def test_maps_compose_in_order(spark):
    rng = random.Random(2)
    maps = [(s, n, c, rng.choice([0.0, 1.0, 1e-200, rng.random()]), rng.random())
            for s in "AB" for n in "xy" for c in range(-1, 90) if (c + len(s)) % 7]
    frame = spark.createDataFrame(maps, "symbol string, scan string, _c long, a double, b double")
    got = {tuple(r[:3]): (r["a"], r["b"])
           for r in exclusive_affine(frame.repartition(5), "_c", 4, 4).collect()}
    state = {}
    for s, n, c, a, b in maps:
        before = state.get((s, n), (1.0, 0.0))
        assert got[s, n, c] == pytest.approx(before, abs=1e-12)
        state[s, n] = (before[0] * a, before[1] * a + b)
    assert len(got) == len(maps)
