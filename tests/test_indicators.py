"""Indicators against formulas written in pandas, on small hand-made series."""

import numpy as np
import pandas as pd
import pytest

from tickloom.plans import features as P
from tickloom.operators import indicators as I


def collect(df):
    return df.toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)


def closes(n, seed=3):
    return np.round(100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n)), 2).tolist()


def same(left, right, tolerance=1e-9):
    np.testing.assert_allclose(np.asarray(left, dtype=float), np.asarray(right, dtype=float),
                               rtol=tolerance, atol=tolerance, equal_nan=True)


def true_range(p):
    prev = p.close.shift()
    return pd.concat([p.high - p.low, (p.high - prev).abs(), (p.low - prev).abs()], axis=1).max(axis=1)


def wilder(tr, n=14):
    out = np.zeros(len(tr))
    if len(tr) >= n:
        out[n - 1] = tr[:n].mean()
        for i in range(n, len(tr)):
            out[i] = (out[i - 1] * (n - 1) + tr.iloc[i]) / n
    return out


def adx(p, n=14):
    up, down = p.high.diff().clip(lower=0), p.low.diff().clip(upper=0)
    atr = true_range(p).rolling(n).mean()
    plus = 100 * up.ewm(alpha=1 / n).mean() / atr
    minus = (100 * down.ewm(alpha=1 / n).mean() / atr).abs()
    dx = (plus - minus).abs() / (plus + minus).abs() * 100
    return ((dx.shift() * (n - 1) + dx) / n).ewm(alpha=1 / n).mean()


@pytest.mark.parametrize("chunk_rows", [1024, 128])
def test_running_columns(make_bars, chunk_rows):
    bars = make_bars({"A": closes(300), "B": closes(40, 9)})
    names = ["ema_10", "ema_50", "macd_signal", "macd_histogram_slope", "atr", "adx", "obv"]
    got = collect(P.feature_table(bars, names, "raw", chunk_rows=chunk_rows))
    for symbol, p in got.groupby("symbol"):
        p = p.reset_index(drop=True)
        same(p.ema_10, p.close.ewm(span=10, adjust=False).mean())
        same(p.ema_50, p.close.ewm(span=50, adjust=False).mean())
        macd = p.close.ewm(span=12, adjust=False).mean() - p.close.ewm(span=26, adjust=False).mean()
        signal = macd.ewm(span=9, adjust=False).mean()
        same(p.macd_signal, signal)
        same(p.macd_histogram_slope, (macd - signal).diff(), 1e-8)
        same(p.atr, wilder(true_range(p)))
        same(p.adx, adx(p), 1e-8)
        same(p.obv, (np.sign(p.close.diff()) * p.tick_volume).fillna(0).cumsum())


def test_rolling_columns(make_bars):
    got = collect(P.feature_table(make_bars({"A": closes(130)}), None, "raw"))
    p = got
    same(p.ma_20, p.close.rolling(20).mean())
    same(p.close_std_50, p.close.rolling(50).std(), 1e-8)
    same(p.return_std_20, p.close.pct_change().rolling(20).std(), 1e-8)
    same(p.stochastic_d, p.stochastic_k.rolling(3).mean())
    same(p.fib_382, (lambda h, l: h - (h - l) * 0.382)(
        p.high.rolling(100).max().shift(), p.low.rolling(100).min().shift()))
    same(p.ichimoku_span_b, ((p.high.rolling(52).max() + p.low.rolling(52).min()) / 2).shift(26))
    same(p.ichimoku_lagging, p.close.shift(-26))
    typical = (p.high + p.low + p.close) / 3
    spread = typical.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
    same(p.keltner_upper, typical.rolling(20).mean() + 2 * spread)
    share = p.close.rolling(50).apply(lambda x: pd.cut(x, bins=10).value_counts().max() / len(x))
    same(p.price_cluster, share)
    same(p.support_strength, p.low.rolling(100).apply(lambda x: (x == x.min()).mean()))
    assert p.columns.is_unique and set(I.COLUMNS) <= set(p.columns)


@pytest.mark.parametrize("rows", [1, 13, 14, 99, 100, 101])
def test_warm_up(make_bars, rows):
    got = collect(P.feature_table(
        make_bars({"A": closes(rows)}), ["rsi", "fib_236", "support_strength", "atr"], "raw"))
    assert got.rsi.notna().sum() == max(0, rows - 13)
    assert got.fib_236.notna().sum() == max(0, rows - 100)
    assert got.support_strength.notna().sum() == max(0, rows - 99)
    assert got.atr.notna().all() and (got.atr[:13] == 0).all()


def test_constant_and_flat(make_bars):
    got = collect(P.feature_table(make_bars({"A": [5.0] * 60}, flat=True), None, "raw"))
    assert got.rsi.isna().all()              # no gain, no loss
    assert got.cmf.isna().all()              # flat bars carry no flow
    assert got.price_cluster.dropna().eq(1.0).all()
    assert got.bb_std.dropna().eq(0.0).all()
    assert got.risk_reward_ratio.isna().all()


def test_only_gains_give_hundred(make_bars):
    got = collect(P.rsi(make_bars({"A": list(range(1, 31))})))
    assert got.rsi.dropna().eq(100.0).all() and got.rsi.notna().sum() == 17


def test_symbols_do_not_leak(make_bars):
    a, b = closes(60, 1), closes(60, 2)
    both = collect(P.feature_table(make_bars({"A": a, "B": b}), ["rsi", "ema_20", "obv"], "raw"))
    alone = collect(P.feature_table(make_bars({"B": b}), ["rsi", "ema_20", "obv"], "raw"))
    pd.testing.assert_frame_equal(both[both.symbol == "B"].reset_index(drop=True), alone)


def test_gaps_in_time_count_rows(make_bars):
    bars = make_bars({"A": closes(80)}, skip=set(range(20, 40)))
    got = collect(P.feature_table(bars, ["ma_10"], "raw"))
    same(got.ma_10, got.close.rolling(10).mean())


@pytest.mark.parametrize("view", ["history", "as_of", "causal"])
def test_chunk_size_does_not_matter(make_bars, view):
    bars = make_bars({"A": closes(420), "B": closes(150, 5)}, flat=False)
    whole = collect(P.feature_table(bars, None, view))
    cut = collect(P.feature_table(bars, None, view, chunk_rows=128))
    for name in whole.columns[2:]:
        same(whole[name], cut[name], 1e-8)


def test_history_fill_leaves_no_gap(make_bars):
    got = collect(P.feature_table(make_bars({"A": closes(130)}), None, "history"))
    assert not got.isna().any().any()


def test_appending_bars_keeps_causal_rows(make_bars):
    full = closes(160)
    longer = collect(P.feature_table(make_bars({"A": full}), None, "as_of"))
    shorter = collect(P.feature_table(make_bars({"A": full[:120]}), None, "as_of"))
    for name in shorter.columns[2:]:
        same(longer[name][:120], shorter[name])


def test_as_of_equals_cut_history(make_bars):
    """The last row of a history cut anywhere equals that row of the as-of table."""
    full = closes(140)
    table = collect(P.feature_table(make_bars({"A": full}), None, "as_of"))
    for n in (30, 101, 140):
        cut = collect(P.feature_table(make_bars({"A": full[:n]}), None, "history")).iloc[-1]
        row = table.iloc[n - 1]
        for name in table.columns[2:]:
            if row[name] == row[name] and row[name] is not None:
                assert cut[name] == pytest.approx(row[name], rel=1e-9, abs=1e-9), (n, name)


def test_custom_periods(make_bars):
    bars = make_bars({"A": closes(90)})
    got = collect(P.rsi(bars, 5))
    delta = got.close.diff()
    gain, loss = delta.where(delta > 0, 0).rolling(5).mean(), (-delta.where(delta < 0, 0)).rolling(5).mean()
    same(got.rsi, 100 - 100 / (1 + gain / loss))
    got = collect(P.ema(bars, 2, 3, 200))
    for span in (2, 3, 200):
        same(got[f"ema_{span}"], got.close.ewm(span=span, adjust=False).mean())
    got = collect(P.adx(bars, 7))
    same(got.adx, adx(got, 7), 1e-8)
    lines = collect(P.ichimoku(bars, 3, 5, 8, 4))
    same(lines.ichimoku_span_a, ((lines.ichimoku_conversion + lines.ichimoku_base) / 2).shift(4))


def test_unknown_view_is_refused(make_bars):
    with pytest.raises(ValueError):
        P.feature_table(make_bars({"A": [1.0]}), ["rsi"], "other")
