"""Strategy configuration and the shipped presets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tickloom.schema import RULE


@dataclass(frozen=True)
class Rule:
    """Interval on one feature; an open end is None. Bounds are inclusive."""

    feature: str
    lo: float | None = None
    hi: float | None = None


@dataclass(frozen=True)
class StrategyConfig:
    """One side (buy or sell) of a strategy."""

    name: str
    side: str
    symbol: str
    threshold: float
    min_votes: int
    rules: tuple[Rule, ...]
    base_a: tuple[str, ...] = ()
    base_b: tuple[str, ...] = ()
    meta: tuple[str, ...] = ()
    service_votes: int | None = None   # votes asked for by the request service
    min_volume: int | None = None
    aliases: tuple[str, ...] = field(default=())   # request-name prefixes

    @property
    def features(self) -> list[str]:
        """Feature columns the side needs, without the base probabilities."""
        names = [r.feature for r in self.rules] + [*self.base_a, *self.base_b, *self.meta]
        return [n for n in dict.fromkeys(names) if n not in PROBABILITIES]


PROBABILITIES = ("zero_pred_0", "zero_pred_1", "one_pred_0", "one_pred_1")


def rules_frame(spark: SparkSession, *configs: StrategyConfig) -> DataFrame:
    """The rules as rows, each with the votes and the threshold its side asks for."""
    return spark.createDataFrame(
        [(c.name, c.side, r.feature, r.lo, r.hi, c.min_votes, c.threshold)
         for c in configs for r in c.rules], RULE)


# Thresholds, rule bounds, votes and model inputs of the shipped strategies. Bounds
# are in price units of the pair. A column listed twice (bb_width, bb_std) is a model input twice.

EURUSD_SELL = StrategyConfig(
    name="eurusd_h1", side="sell", symbol="EURUSD", aliases=("eurusd_h1",),
    threshold=0.6350406453614887, min_votes=4, service_votes=4, min_volume=3642,
    rules=(
        Rule("obv", -8902.0),
        Rule("cmf", -0.004935601531600464),
        Rule("adx", 22.523426795906914),
        Rule("rsi_lag_10", 39.64334705075517, 60.59907834101579),
        Rule("return_std_20", 0.0008333715753742228),
        Rule("volume_ratio", 0.8832762146127926),
        Rule("atr", 0.002215251727417138),
        Rule("liquidity_index", 0.5278289060516576),
    ),
    base_a=("tick_volume", "bb_std", "volume_lag_1", "volume_lag_2", "volume_lag_5",
            "volume_lag_10", "price_change_1", "price_change_5", "close_std_10", "close_std_20",
            "close_std_50", "atr", "adx", "volume_oscillator", "bb_width",
            "macd_histogram_slope", "price_range", "bb_width", "return_std_20",
            "liquidity_index"),
    base_b=("tick_volume", "volume_lag_1", "volume_lag_2", "volume_lag_3", "volume_lag_10",
            "price_change_1", "price_change_5", "close_std_10", "close_std_20", "close_std_50",
            "atr", "adx", "volume_oscillator", "bb_width", "macd_histogram_slope",
            "price_range", "bb_std", "bb_width", "return_std_20", "liquidity_index"),
    meta=("tick_volume", "volume_lag_1", "volume_lag_2", "volume_lag_3", "volume_lag_5",
          "volume_lag_10", "rsi_lag_10", "close_std_10", "close_std_50", "atr", "obv", "adx",
          "ichimoku_lagging", "volume_ma", "volume_ratio", "volume_oscillator", "cmf",
          "body_size", "volatility", "spread_ratio", "tick_price_impact", "return_std_20",
          "liquidity_index", *PROBABILITIES),
)

EURUSD_BUY = StrategyConfig(
    name="eurusd_h1", side="buy", symbol="EURUSD", aliases=("eurusd_h1",),
    threshold=0.6098459517214893, min_votes=6, service_votes=6, min_volume=3328,
    rules=(
        Rule("volume_oscillator", -28.5396861756958, 71.37023040351092),
        Rule("rsi_lag_5", 49.288617886178685, 98.50560398505462),
        Rule("atr", 0.001396535106622054, 0.004038045176624583),
        Rule("volume_lag_1", 6808.0),
        Rule("obv", -190251.0),
        Rule("liquidity_index", 0.5281126701738172, 1.0330107540995082),
        Rule("macd_histogram_slope", -1.2553173171557606e-06),
        Rule("return_std_20", 0.0009053769452826013, 0.0043951260677922216),
        Rule("cmf", -0.0052163919280026096),
        Rule("price_range", 0.0024100000000000232, 0.02176),
    ),
    base_a=("tick_volume", "day", "bb_std", "volume_lag_1", "volume_lag_2", "volume_lag_10",
            "price_change_1", "close_std_10", "close_std_50", "atr", "volume_oscillator",
            "bb_width", "ichimoku_distance", "price_range", "volatility", "bb_width",
            "return_std_20", "liquidity_index"),
    base_b=("tick_volume", "day", "bb_std", "volume_lag_1", "volume_lag_2", "volume_lag_3",
            "volume_lag_5", "volume_lag_10", "price_change_1", "close_std_10", "close_std_20",
            "close_std_50", "atr", "adx", "volume_ma", "volume_ratio", "volume_oscillator",
            "bb_width", "ichimoku_distance", "price_range", "volatility", "bb_std", "bb_width",
            "return_std_20", "liquidity_index"),
    meta=("tick_volume", "month", "volume_lag_1", "volume_lag_2", "volume_lag_3",
          "volume_lag_5", "rsi_lag_5", "volume_lag_10", "rsi_lag_10", "price_change_1",
          "price_change_5", "close_std_50", "atr", "obv", "volume_ma", "volume_ratio",
          "volume_oscillator", "cmf", "macd_histogram_slope", "price_range", "body_size",
          "volatility", "return_std_20", "liquidity_index", *PROBABILITIES),
)

USDJPY_SELL = StrategyConfig(
    name="usdjpy_h1", side="sell", symbol="USDJPY", aliases=("usdjpy_h1",),
    threshold=0.6916390507233896, min_votes=6, service_votes=7,
    rules=(
        Rule("atr", 0.219857330189408, 1.1685834831218533),
        Rule("volume_lag_3", 7235.0, 65350.0),
        Rule("volume_lag_5", 7274.0, 65350.0),
        Rule("adx", 28.146064682648415, 72.15325451924065),
        Rule("volume_lag_1", 7251.0, 65350.0),
        Rule("rsi_lag_5", 51.709027169149365, 99.54545454545422),
        Rule("volume_ma", 3683.5, 22913.1),
        Rule("spread_volatility", 1.6589167144263486, 4.4721359550220585),
        Rule("volume_oscillator", -14.1629144494474, 32.547319751481005),
        Rule("liquidity_index", 0.5532688119030449, 0.8029032631471555),
    ),
    base_a=("tick_volume", "volume_lag_2", "volume_lag_5", "price_change_5", "close_std_10",
            "atr", "adx", "volume_ratio", "cmf", "bb_width", "price_range", "bb_width",
            "return_std_20", "liquidity_index"),
    base_b=("tick_volume", "volume_lag_2", "volume_lag_5", "price_change_5", "close_std_10",
            "atr", "adx", "cmf", "bb_width", "price_range", "bb_width", "return_std_20",
            "liquidity_index"),
    meta=("tick_volume", "ema_50", "volume_lag_1", "volume_lag_2", "volume_lag_3",
          "volume_lag_5", "rsi_lag_5", "volume_lag_10", "rsi_lag_10", "close_std_10",
          "close_std_50", "atr", "macd_histogram", "obv", "adx", "ichimoku_span_a", "volume_ma",
          "volume_oscillator", "cmf", "ichimoku_distance", "macd_histogram_slope",
          "price_range", "body_size", "volatility", "spread_ratio", "spread_ma",
          "spread_volatility", "tick_price_impact", "return_std_20", "liquidity_index",
          *PROBABILITIES, "year"),
)

USDJPY_BUY = StrategyConfig(
    name="usdjpy_h1", side="buy", symbol="USDJPY", aliases=("usdjpy_h1",),
    threshold=0.6728549941923228, min_votes=6, service_votes=7,
    rules=(
        Rule("rsi_lag_10", None, 51.47),
        Rule("atr", 0.18, 0.34),
        Rule("obv", 595509.0),
        Rule("adx", 28.34),
        Rule("macd_histogram_slope", -0.0017),
        Rule("volume_ratio", 1.32),
        Rule("price_range", None, 0.33),
        Rule("body_size", 0.209),
        Rule("return_std_20", None, 0.0016),
        Rule("liquidity_index", 0.64),
    ),
    base_a=("tick_volume", "day", "volume_lag_2", "volume_lag_5", "volume_lag_10",
            "price_change_5", "close_std_10", "close_std_50", "atr", "adx", "volume_ma",
            "bb_width", "ichimoku_distance", "macd_histogram_slope", "price_range", "spread_ma",
            "bb_width", "return_std_20"),
    base_b=("tick_volume", "day", "ema_20", "volume_lag_2", "volume_lag_5", "volume_lag_10",
            "price_change_1", "price_change_5", "close_std_10", "close_std_50", "atr", "adx",
            "volume_ma", "volume_ratio", "bb_width", "ichimoku_distance",
            "macd_histogram_slope", "price_range", "body_size", "spread_ma", "bb_width",
            "return_std_20", "liquidity_index"),
    meta=("month", "volume_lag_1", "volume_lag_2", "volume_lag_3", "volume_lag_5",
          "volume_lag_10", "rsi_lag_10", "close_std_10", "close_std_50", "atr",
          "macd_histogram", "obv", "adx", "ichimoku_lagging", "volume_ma", "volume_ratio",
          "volume_oscillator", "macd_histogram_slope", "price_range", "body_size", "volatility",
          "spread_ratio", "spread_ma", "tick_price_impact", "return_std_20", "liquidity_index",
          *PROBABILITIES),
)

PRESETS = (EURUSD_SELL, EURUSD_BUY, USDJPY_SELL, USDJPY_BUY)
