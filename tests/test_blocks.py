"""Prefixes, running recursions and fills over chunked series."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks as B
from tickloom.operators import scan as scan_module
from tickloom.operators.fill import fill, fill_backward
from tickloom.plans.features import feature_table


@pytest.fixture
def summaries(spark):
    rng = random.Random(1)
    rows = [(s, c, rng.randint(1, 9), float(c) if rng.random() < 0.3 else None)
            for s in ("A", "B") for c in range(-1, 90)]
    return rows, spark.createDataFrame(rows, "symbol string, _c long, n long, v double")


@pytest.mark.parametrize("fan", [1000, 10, 8, 3])
def test_prefix_levels_agree(summaries, fan):
    rows, df = summaries
    got = {(r["symbol"], r["_c"]): (r["n"], r["v"]) for r in B.exclusive_prefix(
        df, "_c", sums=["n"], lasts=["v"], fan=fan).collect()}
    for symbol in ("A", "B"):
        total, last = 0, None
        for s, c, n, v in rows:
            if s == symbol:
                assert got[(s, c)] == (total, last)
                total, last = total + n, v if v is not None else last


def test_positions_across_buckets(make_bars):
    bars = make_bars({"A": list(range(500)), "B": list(range(30))}, skip=set(range(50, 120)))
    series = B.index_rows(bars, chunk_rows=64)
    rows = series.frame.orderBy("symbol", "time").collect()
    a = [r["_i"] for r in rows if r["symbol"] == "A"]
    assert a == list(range(430)) and [r["_i"] for r in rows if r["symbol"] == "B"] == list(range(30))


def test_halo_holds_the_neighbours(make_bars):
    series = B.index_rows(make_bars({"A": list(range(300))}), chunk_rows=64)
    chunk = B.spread(series, back=5, ahead=3).filter("_c = 2").select("_i", "_j").collect()
    assert sorted(r["_i"] for r in chunk) == list(range(123, 195))
    assert min(r["_j"] for r in chunk) == -5


def test_frames_wider_than_a_chunk_are_refused(make_bars):
    series = B.index_rows(make_bars({"A": list(range(300))}), chunk_rows=64)
    with pytest.raises(ValueError):
        B.spread(series, back=65)


def test_chunks_shrink_for_fast_decay():
    assert scan_module.safe_chunk_rows([1 / 3], 1024) < 1024
    assert scan_module.safe_chunk_rows([0.8, 1.0], 1024) == 1024


def test_many_summaries_take_the_two_level_path(make_bars):
    bars = make_bars({"A": [float(x % 17) for x in range(700)]})
    names = ["obv", "ema_20", "stochastic_k", "cmf"]
    plain = feature_table(bars, names, "history").orderBy("time").collect()
    cut = feature_table(bars, names, "history", chunk_rows=128).orderBy("time").collect()
    for left, right in zip(plain, cut):
        for n in names:
            assert left[n] == pytest.approx(right[n], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk_rows", [1024, 64])
def test_fills(make_bars, chunk_rows):
    bars = make_bars({"A": list(range(1, 301))}).withColumn(
        "x", F.when(F.col("close") % 90 == 70, F.col("close")))
    series = B.index_rows(bars, chunk_rows, reuse=True)
    own = B.spread(series, 0)
    both = [r["x"] for r in fill(own, ["x"]).orderBy("time").collect()]
    back = [r["x"] for r in fill_backward(own, ["x"]).orderBy("time").collect()]
    marks = [70, 160, 250]
    for i, close in enumerate(range(1, 301)):
        past = [m for m in marks if m <= close]
        assert both[i] == (past[-1] if past else 70)
        coming = [m for m in marks if m >= close]
        assert back[i] == (coming[0] if coming else None)
