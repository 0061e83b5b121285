"""Boosted trees from a model's text dump: a table of nodes, evaluated as generated expressions.

The dump is the plain-text form that gradient-boosting libraries print: ``booster[0]:``, then a line
a node, ``0:[rsi<30] yes=1,no=2,missing=1`` or ``1:leaf=0.25``. A model is then a small table that
can be stored, joined and checked like any other. Scoring is a projection: each tree becomes one
nested CASE over the feature columns, so nothing shuffles and no Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.sqltext import num
from tickloom.plans.presets import PROBABILITIES

NODE = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("tree", T.LongType()),
    T.StructField("node", T.LongType()), T.StructField("feature", T.StringType()),
    T.StructField("test", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("yes", T.LongType()), T.StructField("no", T.LongType()),
    T.StructField("missing", T.LongType()), T.StructField("value", T.DoubleType()),
])
# The dump's layout.
BOOSTER = "booster["
NUMBER = r"([-+]?[\d.]+(?:[eE][-+]?\d+)?)"
SPLIT = r"^\s*(\d+):\[(.+?)(<=?)" + NUMBER + r"\] yes=(\d+),no=(\d+)(?:,missing=(\d+))?"
LEAF = r"^\s*(\d+):leaf=" + NUMBER

TREES_A_STEP = 8         # nested expressions of one projection; keeps generated methods small
MOST_NODES = 200_000     # of one model


def read_dump(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Node table of the dump files under ``path``; a tree's text is one record. A split without a
    direction for missing values sends them to ``no``."""
    trees = spark.read.option("lineSep", BOOSTER).text(path)
    lines = trees.select(F.regexp_extract("value", r"^(\d+)\]", 1).try_cast("long").alias("tree"),
                         F.explode(F.split("value", "\n")).alias("line")).filter("tree IS NOT NULL")

    def part(pattern: str, group: int, kind: str):
        return F.regexp_extract("line", pattern, group).try_cast(kind)

    is_leaf = F.col("line").rlike(LEAF)
    return lines.filter(is_leaf | F.col("line").rlike(SPLIT)).select(
        F.lit(model).alias("model"), "tree",
        F.coalesce(part(LEAF, 1, "long"), part(SPLIT, 1, "long")).alias("node"),
        F.when(~is_leaf, part(SPLIT, 2, "string")).alias("feature"),
        F.when(~is_leaf, part(SPLIT, 3, "string")).alias("test"),
        part(SPLIT, 4, "double").alias("threshold"), part(SPLIT, 5, "long").alias("yes"),
        part(SPLIT, 6, "long").alias("no"),
        F.coalesce(part(SPLIT, 7, "long"), part(SPLIT, 6, "long")).alias("missing"),
        part(LEAF, 2, "double").alias("value"))


def _expression(nodes: dict[int, Row], at: int = 0, depth: int = 0) -> str:
    """A tree as SQL text; a value that is missing or no number takes the split's own direction."""
    if at not in nodes or depth > len(nodes):
        raise ValueError(f"node {at} is missing or its tree has a loop")
    n = nodes[at]
    if n.feature is None:
        return num(n.value)
    x = f"double(`{n.feature}`)"
    yes, no = (_expression(nodes, child, depth + 1) for child in (n.yes, n.no))
    known = f"{x} {n.test} {num(n.threshold)}"
    absent = f"{x} IS NULL OR isnan({x})"
    if n.missing == n.yes:
        return f"CASE WHEN {absent} OR {known} THEN {yes} ELSE {no} END"
    if n.missing == n.no:
        return f"CASE WHEN NOT ({absent}) AND {known} THEN {yes} ELSE {no} END"
    raise ValueError(f"node {at} sends missing values to neither side")


def tree_margin(features: DataFrame, nodes: DataFrame, name: str, base: float = 0.0) -> DataFrame:
    """``features`` with ``name``: ``base`` plus the leaf of each tree. ``nodes`` holds one model."""
    trees: dict[int, dict[int, Row]] = {}
    rows = nodes.limit(MOST_NODES + 1).collect()     # a model, bounded; not data
    if len(rows) > MOST_NODES:
        raise ValueError(f"a model of more than {MOST_NODES} nodes")
    for n in rows:
        if n.node in trees.setdefault(n.tree, {}):
            raise ValueError(f"tree {n.tree} has node {n.node} twice")
        trees[n.tree][n.node] = n
    texts = [_expression(trees[t]) for t in sorted(trees)]
    out, kept = features.withColumn(name, F.lit(float(base))), features.columns
    for at in range(0, len(texts), TREES_A_STEP):
        some = texts[at:at + TREES_A_STEP]
        out = out.selectExpr(*[f"`{c}`" for c in kept],
                             f"{name} + {' + '.join(f'({t})' for t in some)} AS {name}")
    return out


def tree_chance(features: DataFrame, nodes: DataFrame, names: Sequence[str],
                base: float = 0.0) -> DataFrame:
    """Both class probabilities of one model, logistic in its margin."""
    out = tree_margin(features, nodes, "_margin", base)
    p1 = 1.0 / (1.0 + F.exp(-F.col("_margin")))
    return out.withColumn(names[1], p1).withColumn(names[0], 1.0 - F.col(names[1])).select(
        *features.columns, *names)


def tree_stack(features: DataFrame, nodes: DataFrame, prefix: str,
               models: Sequence[str] = ("base_a", "base_b", "meta")) -> DataFrame:
    """The stack of three dumped models: two base models, and one over features and their four
    probabilities. Adds the base probabilities, ``{prefix}_p0/_p1`` and ``{prefix}_class``."""
    a, b, meta = (nodes.filter(F.col("model") == m) for m in models)
    based = tree_chance(tree_chance(features, a, PROBABILITIES[:2]), b, PROBABILITIES[2:])
    scored = tree_chance(based, meta, (f"{prefix}_p0", f"{prefix}_p1"))
    return scored.withColumn(f"{prefix}_class", (
        F.col(f"{prefix}_p1") > F.col(f"{prefix}_p0")).cast("int"))


def tree_scorer(nodes: dict[str, DataFrame]):
    """Scorer for the decision plans from the node tables of each side's stack."""
    def score(features: DataFrame, config, prefix: str) -> DataFrame:
        return tree_stack(features, nodes[config.side], prefix).select(
            *features.columns, f"{prefix}_p0", f"{prefix}_p1")
    return score
