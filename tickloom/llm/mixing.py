"""Mixing sources to target weights by entropy balancing.

Among all document rates r with 0 <= r <= cap whose words meet every source's target, the one
closest in relative entropy to r = 1 is exponentially tilted: r = min(cap, exp(tilt * size)).
The tilts solve the convex dual, one variable a source; its gradient and curvature are sums over
the corpus, so each Newton step is one distributed aggregation over the (source, size) histogram,
which holds all that the sums depend on. Rates are then rounded into whole copies: floor, plus one
where a hash of the document falls below the remaining fraction. The hash is turned by one of
`SEEDS` fixed angles; each source takes the angle whose total lands nearest its target.

The driver holds one row a source; documents never leave the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, local, written

WEIGHTS = (5.0, 2.0, 1.0)
SEEDS = 64
TURN = 2654435769          # 2^32 over the golden ratio: the angles spread evenly
STEPS, TOLERANCE = 60, 1e-7
TILTS = pa.schema([("ix", pa.int32()), ("tilt", pa.float64())])
PLAN = pa.schema([("source", pa.string()), ("ix", pa.int32()), ("source_size", pa.int64()),
                  ("target", pa.float64()), ("tilt", pa.float64()), ("seed", pa.int32())])


@dataclass
class Source:
    name: str | None
    size: int
    docs: int
    target: float = 0.0
    tilt: float = 0.0      # per word
    seed: int = 0


def targets(sizes: list[float], share: float = 1.5, cap: float = 2.0,
            weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """share * all sizes, dealt by weight; what lies above cap * size is dealt again by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    found = [0.0] * len(sizes)
    open_, rest = [i for i, size in enumerate(sizes) if size > 0], share * sum(sizes)
    while open_:
        level = rest / sum(weight[i] for i in open_)
        full = [i for i in open_ if weight[i] * level > cap * sizes[i]]
        for i in full or open_:
            found[i] = cap * sizes[i] if full else weight[i] * level
        rest -= sum(found[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return found


def rate(size: Column, tilt: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(tilt * size, F.lit(700.0))))


def copies(size: str, tilt: str, seed: str, key: str, cap: float) -> str:
    """SQL for the whole copies of a document. One without words has rate 1: it is kept once."""
    wanted = f"least({cap}D, exp(least({tilt} * {size}, 700D)))"
    unit = f"pmod(pmod({key}, {1 << 32}L) + {seed} * {TURN}L, {1 << 32}L) / {float(1 << 32)}D"
    return f"(floor({wanted}) + cast({unit} < {wanted} - floor({wanted}) as long))"


def measured(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds mix_size (words; null text: 0) and mix_key (a hash of id and text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.withColumn("mix_size", F.regexp_count(text, F.lit(WORD)).cast("long"))
            .withColumn("mix_key", F.xxhash64(F.col(id_col), F.xxhash64(text))))


def balance(sized: DataFrame, share: float = 1.5, cap: float = 2.0,
            weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row a source: source, source_size, target, tilt, seed. `sized` has source, mix_size
    and mix_key and is read a few times: pass a stored table."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(
        F.sum("mix_size").alias("size"), F.count("*").alias("docs")).collect()
    sources = [Source(r["source"], r["size"], r["docs"])
               for r in sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))]
    for source, target in zip(sources, targets([s.size for s in sources], share, cap, weights)):
        source.target = target
    histogram = written(_indexed(
        sized.filter("mix_size > 0").groupBy("source", "mix_size").agg(F.count("*").alias("docs")),
        sources).select("ix", "mix_size", "docs"), "mix-histogram")
    _newton(histogram, sources, cap)
    _seeds(_indexed(sized.filter("mix_size > 0"), sources), sources, cap)
    return _frame(spark, sources)


def _newton(histogram: DataFrame, sources: list[Source], cap: float) -> None:
    """Sets each tilt so that the words taken meet the target; bisection guards the step."""
    spark = histogram.sparkSession
    open_ = {}
    for ix, source in enumerate(sources):
        if source.size == 0:
            continue
        if source.target >= cap * source.size * (1 - 1e-9):
            source.tilt = 700.0        # every rate is the cap
            continue
        mean = source.size / source.docs
        source.tilt = math.log(source.target / source.size) / mean
        open_[ix] = [-math.inf, math.inf]
    size = F.col("mix_size").cast("double")
    for _ in range(STEPS):
        if not open_:
            return
        tilts = local(spark, [(ix, sources[ix].tilt) for ix in open_], TILTS)
        at = rate(size, F.col("tilt"), cap)
        # sums of decimals do not depend on the order of their terms, so reruns take the same steps
        exact, words = F.round(at, 12).cast("decimal(14,12)"), F.col("mix_size").cast("decimal(12,0)")
        of_size = (F.col("docs") * F.col("mix_size")).cast("decimal(19,0)")
        sums = histogram.join(tilts, "ix").groupBy("ix").agg(
            F.sum(of_size * exact).cast("double").alias("taken"),
            F.sum(F.when(at < cap, of_size * words * exact)).cast("double").alias("slope")).collect()
        for row in sums:
            source, bounds = sources[row["ix"]], open_[row["ix"]]
            miss = row["taken"] - source.target
            if abs(miss) <= TOLERANCE * max(source.target, 1.0):
                del open_[row["ix"]]
                continue
            bounds[miss > 0] = source.tilt
            low, high = bounds
            step = source.tilt - miss / row["slope"] if row["slope"] else math.nan
            if not low < step < high:
                scale = max(abs(source.tilt), source.docs / source.size)
                step = (low + high) / 2 if math.isfinite(low + high) else (
                    low + scale if math.isfinite(low) else high - scale)
            if step in (low, high):    # no number lies between
                del open_[row["ix"]]
            source.tilt = step


def _seeds(sized: DataFrame, sources: list[Source], cap: float) -> None:
    """Takes for each source the angle whose whole copies come nearest the target."""
    spark = sized.sparkSession
    frame = local(spark, [(ix, s.tilt) for ix, s in enumerate(sources)], TILTS)
    sums = sized.join(frame, "ix").groupBy("ix").agg(*[
        F.expr(f"sum(mix_size * {copies('mix_size', 'tilt', str(k), 'mix_key', cap)}) AS s{k}")
        for k in range(SEEDS)]).collect()
    for row in sums:
        source = sources[row["ix"]]
        source.seed = min(range(SEEDS), key=lambda k: (abs(row[f"s{k}"] - source.target), k))


def _frame(spark, sources: list[Source]) -> DataFrame:
    return local(spark, [(s.name, ix, s.size, s.target, s.tilt, s.seed)
                         for ix, s in enumerate(sources)], PLAN)


def _indexed(df: DataFrame, sources: list[Source]) -> DataFrame:
    names = _frame(df.sparkSession, sources).select(F.col("source").alias("of"), "ix")
    return df.join(names, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mixed(sized: DataFrame, plan: DataFrame, cap: float = 2.0) -> DataFrame:
    """`sized` with mix_source_size, mix_target, mix_rate and mix_copies, by the balance() plan."""
    plan = plan.select(F.col("source").alias("mix_of"), F.col("source_size").alias("mix_source_size"),
                       F.col("target").alias("mix_target"), F.col("tilt").alias("mix_tilt"),
                       F.col("seed").alias("mix_seed"))
    size = F.col("mix_size")
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("mix_of")))
            .withColumn("mix_rate", rate(size.cast("double"), F.col("mix_tilt"), cap))
            .withColumn("mix_copies", F.expr(copies("mix_size", "mix_tilt", "mix_seed", "mix_key",
                                                    cap)))
            .drop("mix_of", "mix_tilt", "mix_seed"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0,
        weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """`docs` mixed: each row as often as the mix takes it, with its own columns only.

    docs needs doc_id, text and source. Null text: no words; such a document has rate 1 and stays
    once. Null source: a source of its own, last in order. Repeated rows share one hash, so they
    get the same copies. A table without words stays as it is. Other columns pass through,
    whatever their names.
    """
    ours = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    slim = written(measured(ours).select("source", "mix_size", "mix_key"), "mix-sizes")
    plan = balance(slim, share, cap, weights)
    taken = mixed(measured(ours), plan, cap)
    again = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return taken.filter("mix_copies > 0").select("row", again).select("row.*")
