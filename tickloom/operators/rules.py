"""Confidence gate and interval-rule votes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import holds
from tickloom.plans.presets import Rule, StrategyConfig


def confidence_gate(p0: Column, p1: Column, threshold: float | Column) -> Column:
    """True if either class is at least ``threshold`` likely (confidence, not direction)."""
    return holds(F.greatest(p0, p1) >= threshold)


def rule_holds(rule: Rule) -> Column:
    """Inside the interval, bounds included; a missing value is outside."""
    value = F.col(rule.feature)
    sides = [F.lit(True)]
    if rule.lo is not None:
        sides.append(value >= rule.lo)
    if rule.hi is not None:
        sides.append(value <= rule.hi)
    return holds(value.isNotNull() & reduce(lambda a, b: a & b, sides))


def votes(rules: Sequence[Rule]) -> Column:
    """Number of rules that hold, as one generated expression."""
    return reduce(add, [rule_holds(r).cast("int") for r in rules], F.lit(0))


def rule_votes_wide(features: DataFrame, configs: Sequence[StrategyConfig]) -> DataFrame:
    """One row per bar and configuration with its votes; a projection, nothing shuffles."""
    cases = F.array(*[F.struct(F.lit(c.name).alias("strategy"), F.lit(c.side).alias("side"),
                               votes(c.rules).cast("long").alias("votes")) for c in configs])
    return features.select("symbol", "time", F.explode(cases).alias("_v")).select(
        "symbol", "time", "_v.strategy", "_v.side", "_v.votes")


def rule_votes_long(features: DataFrame, rules: DataFrame) -> DataFrame:
    """The same votes with the rules as a table: unpivot, join on the feature, count.

    Suits rule sets that change without a redeploy. The unpivot keeps only features some rule
    names; votes are summed before the shuffle.
    """
    return _tested(features, rules, []).groupBy("symbol", "time", "strategy", "side").agg(
        F.sum("_vote").alias("votes"))


BOOK, BARS = 4096, 256      # rules, and bars, that a task handles at once


def rule_votes_bitmaps(features: DataFrame, rules: DataFrame,
                       strong: int | None = None) -> DataFrame:
    """The same votes for any number of strategies: one plan, whatever their number.

    The bounds of a book's rules cut a feature's values into elementary intervals; on each of them,
    and on each bound, the same rules hold. Their bitmap is looked up with one search a value, and a
    strategy's votes are the bits set within its stretch. Rules are dealt to books of some ``BOOK``
    rules, whole strategies each, and every bar is sent to every book: one row for the votes of all
    its strategies. Where books are few, bars are dealt to shards that each book meets one by one.

    With ``strong``, the bars that a strategy meets in one task are combined before they leave it:
    ``bars``, the sum of their ``votes``, the ``most`` of one bar, and how many have ``strong`` votes
    or more. A strategy then has a few rows, to be combined again.
    """
    sizes = {r["feature"]: r["count"] for r in rules.groupBy("feature").count().collect()}
    named = sorted(n for n in sizes if n is not None)
    tasks = 8 * features.sparkSession.sparkContext.defaultParallelism
    books = -(-sum(sizes.values()) // BOOK) or 1
    shards = -(-tasks // books)
    bars = features.select(
        F.explode(F.sequence(F.lit(0), F.lit(books - 1))).alias("_book"),
        F.pmod(F.xxhash64("symbol", "time"), F.lit(shards)).cast("int").alias("_shard"),
        F.lit(True).alias("_bar"), "symbol", "time",
        *[F.col(n).cast("double").alias(f"_value{i}") for i, n in enumerate(named)])
    number = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(named) for x in (n, i)]),
                          F.col("feature")) if named else F.lit(None).cast("int")
    dealt = rules.select(
        F.pmod(F.xxhash64("strategy", "side"), F.lit(books)).cast("int").alias("_book"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"),
        F.lit(False).alias("_bar"), "strategy", "side", number.alias("_feature"),
        F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    met = bars.unionByName(dealt, allowMissingColumns=True).repartitionById(
        tasks, F.pmod(F.col("_book") * F.lit(shards) + F.col("_shard"), F.lit(tasks))
    ).sortWithinPartitions("_book", "_shard", "_bar", "strategy", "side")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, book, parts, sums = None, [], None, None     # a book's rules come before its bars
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                             for n in ("_book", "_shard", "_bar")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if low == high:
                    continue
                some = batch.slice(low, high - low)
                if place != tuple(keys[low, :2].tolist()):
                    if sums is not None:
                        yield _summed(parts[0], sums)
                    place, book, parts, sums = tuple(keys[low, :2].tolist()), [], None, None
                if not keys[low, 2]:
                    book.append(some.select(["strategy", "side", "_feature", "lo", "hi"]))
                    continue
                if parts is None:
                    parts = _book(pa.Table.from_batches(book)) if book else ()
                for at in range(0, some.num_rows if parts else 0, BARS):
                    piece = some.slice(at, BARS)
                    votes = _counted(piece, *parts)
                    if strong is None:
                        yield _voted(piece, parts[0], votes)
                    else:
                        sums = _combined(sums, votes, strong)
        if sums is not None:
            yield _summed(parts[0], sums)

    return met.mapInArrow(count, "symbol string, time timestamp_ntz, strategy string, side string, "
                                 "votes long" if strong is None else
                          "strategy string, side string, bars long, votes long, most long, strong long")


def _book(rules: pa.Table) -> tuple:
    """Of the rules of whole strategies, in their order: the strategies' names, and per feature the
    bounds, the bitmap of each elementary interval, and where the rules of a strategy begin."""
    part = rules.to_pandas()
    key = part.groupby(["strategy", "side"], sort=False, dropna=False).ngroup().to_numpy()
    names = part.drop_duplicates(["strategy", "side"])[["strategy", "side"]]
    number, low, high = (part[c].to_numpy(float, na_value=np.nan) for c in ("_feature", "lo", "hi"))
    low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
    tables = []
    for feature in np.unique(number[~np.isnan(number)]).astype(int).tolist():
        every = np.flatnonzero(number == feature)
        for at in range(0, len(every), BOOK):       # bitmaps are as wide as high
            own = every[at:at + BOOK]
            lo, hi, whose = low[own], high[own], key[own]
            bounds = np.unique(np.concatenate([lo, hi]))
            # interval 2k + 1 is bound k itself, 2k what lies before it; the last lies behind all
            interval = np.arange(2 * len(bounds) + 1)[:, None]
            held = ((interval >= 2 * np.searchsorted(bounds, lo) + 1)
                    & (interval <= 2 * np.searchsorted(bounds, hi) + 1))
            begin = np.flatnonzero(np.diff(whose, prepend=-1))
            tables.append((f"_value{feature}", bounds, np.packbits(held, axis=1), len(own), begin,
                           whose[begin]))
    return names, tables


def _counted(bars: pa.RecordBatch, names: pd.DataFrame, tables: list) -> np.ndarray:
    """The votes of each bar (row) for each strategy."""
    votes = np.zeros((bars.num_rows, len(names)), np.int32)
    for feature, bounds, bitmaps, n, begin, whose in tables:
        value = bars.column(feature).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(~np.isnan(value))
        place = np.searchsorted(bounds, value[known])
        at_bound = (place < len(bounds)) & (bounds[np.minimum(place, len(bounds) - 1)] == value[known])
        bits = np.unpackbits(bitmaps[2 * place + at_bound], axis=1, count=n)
        if len(begin) < n:
            bits = np.add.reduceat(bits, begin, axis=1, dtype=np.int32)
        if len(whose) == len(names):
            votes[known] += bits
        else:
            votes[np.ix_(known, whose)] += bits
    return votes


def _voted(bars: pa.RecordBatch, names: pd.DataFrame, votes: np.ndarray) -> pa.RecordBatch:
    bar = pa.array(np.repeat(np.arange(bars.num_rows), len(names)))
    own = pa.array(np.tile(np.arange(len(names)), bars.num_rows))
    return pa.RecordBatch.from_arrays(
        [bars.column("symbol").take(bar), bars.column("time").take(bar),
         pa.array(names["strategy"], pa.string()).take(own),
         pa.array(names["side"], pa.string()).take(own), pa.array(votes.ravel(), pa.int64())],
        names=["symbol", "time", "strategy", "side", "votes"])


def _combined(sums: np.ndarray | None, votes: np.ndarray, strong: int) -> np.ndarray:
    """Per strategy the bars, sum, maximum and number of strong votes so far."""
    own = np.stack([np.full(votes.shape[1], len(votes)), votes.sum(axis=0, dtype=np.int64),
                    votes.max(axis=0), (votes >= strong).sum(axis=0)])
    if sums is None:
        return own
    return np.stack([sums[0] + own[0], sums[1] + own[1], np.maximum(sums[2], own[2]), sums[3] + own[3]])


def _summed(names: pd.DataFrame, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(names["strategy"], pa.string()), pa.array(names["side"], pa.string()),
         *[pa.array(c, pa.int64()) for c in sums]],
        names=["strategy", "side", "bars", "votes", "most", "strong"])


def _tested(features: DataFrame, rules: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Every rule of every bar, with its vote 0 or 1."""
    named = sorted(r["feature"] for r in rules.select("feature").distinct().collect())
    ids = ["symbol", "time", *kept]
    long = features.select(*ids, *[F.col(n).cast("double").alias(n) for n in named]
                           ).unpivot(ids, named, "feature", "value")
    value = F.col("value")
    inside = (value.isNotNull() & (F.col("lo").isNull() | (value >= F.col("lo")))
              & (F.col("hi").isNull() | (value <= F.col("hi"))))
    return long.join(rules, "feature").withColumn("_vote", holds(inside).cast("long"))


def rule_verdict_long(scored: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdicts from the rule table alone, which also names the votes and the threshold.

    ``scored`` carries ``buy_p0``, ``buy_p1``, ``sell_p0`` and ``sell_p1`` beside the features. A
    side without a rule has no row in the table, hence no verdict.
    """
    def own(p: str) -> Column:
        return F.when(F.col("side") == "buy", F.col(f"buy_{p}")).when(
            F.col("side") == "sell", F.col(f"sell_{p}"))

    chances = [f"{side}_{p}" for side in ("buy", "sell") for p in ("p0", "p1")]
    counted = _tested(scored, rules, chances).groupBy("symbol", "time", "strategy", "side").agg(
        F.sum("_vote").alias("votes"), F.max(own("p0")).alias("p0"), F.max(own("p1")).alias("p1"),
        F.max("min_votes").alias("_min_votes"), F.max("threshold").alias("_threshold"))
    return counted.select("symbol", "time", "strategy", "side", "votes", verdict(
        F.col("p0"), F.col("p1"), F.col("_threshold"), F.col("votes"), F.col("_min_votes"))
        .alias("verdict"))


def verdict(p0: Column, p1: Column, threshold: float | Column, count: Column,
            min_votes: int | Column) -> Column:
    """``below_threshold``, else ``confirm`` with enough votes, else ``not_strong``."""
    return (F.when(~confidence_gate(p0, p1, threshold), "below_threshold")
            .when(count >= min_votes, "confirm").otherwise("not_strong"))


def side_verdict(scored: DataFrame, config: StrategyConfig, p0: str, p1: str) -> DataFrame:
    """Verdict table of one side: symbol, datetime, both probabilities, verdict."""
    side = config.side
    return scored.select(
        "symbol", F.col("time").alias("datetime"),
        F.col(p0).alias(f"class0_{side}"), F.col(p1).alias(f"class1_{side}"),
        verdict(F.col(p0), F.col(p1), config.threshold, votes(config.rules),
                config.min_votes).alias(f"confir_{side}"))
