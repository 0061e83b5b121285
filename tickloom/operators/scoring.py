"""Stacked scoring: two base classifiers and one over both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.presets import PROBABILITIES


def logit(weights: Mapping[str, float], bias: float = 0.0) -> Column:
    """Logistic score of a weighted sum; a missing input counts as 0."""
    z = F.lit(float(bias))
    for name, weight in weights.items():
        z = z + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * float(weight)
    return 1.0 / (1.0 + F.exp(-z))


def stacked_logit(
    features: DataFrame, base_a: Mapping[str, float], base_b: Mapping[str, float],
    meta: Mapping[str, float], prefix: str, bias: float = 0.0,
) -> DataFrame:
    """Fixed-weight stack: adds the base probabilities and ``{prefix}_p0/_p1``."""
    z0, z1, o0, o1 = PROBABILITIES
    based = features.withColumns({z1: logit(base_a), o1: logit(base_b)}).withColumns(
        {z0: 1.0 - F.col(z1), o0: 1.0 - F.col(o1)})
    return based.withColumn(f"{prefix}_p1", logit(meta, bias)).withColumn(
        f"{prefix}_p0", 1.0 - F.col(f"{prefix}_p1"))


def _assembler(columns: Sequence[str], out: str) -> list:
    """Inputs as doubles with 0 for missing, then one vector; a column may be named twice."""
    cast = ", ".join(f"coalesce(double({n}), 0D) AS _x_{out}_{n}" for n in dict.fromkeys(columns))
    drop = [f"_x_{out}_{n}" for n in columns]
    return [SQLTransformer(statement=f"SELECT *, {cast} FROM __THIS__"),
            VectorAssembler(inputCols=drop, outputCol=f"_v_{out}")]


def _widen(df: DataFrame, out: str, names: tuple[str, str]) -> DataFrame:
    p = vector_to_array(F.col(f"_p_{out}"))
    return df.withColumns({names[0]: p[0], names[1]: p[1]})


class StackedModel:
    """Two boosted-tree base models and a logistic meta model.

    The meta input is the meta list (which names the four base probabilities) followed by the
    four probabilities once more. Scoring is a narrow map: no shuffle.
    """

    def __init__(self, base_a: PipelineModel, base_b: PipelineModel, meta: PipelineModel):
        self.base_a, self.base_b, self.meta = base_a, base_b, meta

    @staticmethod
    def _with_base(df: DataFrame, base_a: PipelineModel, base_b: PipelineModel) -> DataFrame:
        scored = _widen(base_a.transform(df), "a", PROBABILITIES[:2])
        return _widen(base_b.transform(scored), "b", PROBABILITIES[2:])

    def base_scores(self, features: DataFrame) -> DataFrame:
        """Features plus the four base probabilities."""
        scored = self._with_base(features, self.base_a, self.base_b)
        return scored.select(*features.columns, *PROBABILITIES)

    def transform(self, features: DataFrame, prefix: str) -> DataFrame:
        """Base probabilities, meta probabilities ``{prefix}_p0/_p1`` and the hard class."""
        scored = self.meta.transform(self._with_base(features, self.base_a, self.base_b))
        p = vector_to_array(F.col("_p_m"))
        return scored.select(*features.columns, *PROBABILITIES, p[0].alias(f"{prefix}_p0"),
                             p[1].alias(f"{prefix}_p1"),
                             F.col("_c_m").cast("int").alias(f"{prefix}_class"))

    def save(self, path: str) -> None:
        for part in ("base_a", "base_b", "meta"):
            getattr(self, part).write().overwrite().save(f"{path}/{part}")

    @classmethod
    def load(cls, path: str) -> StackedModel:
        return cls(*[PipelineModel.load(f"{path}/{part}") for part in ("base_a", "base_b", "meta")])


def model_scorer(models: dict[str, StackedModel]):
    """Scorer for the decision plans from one fitted stack per side."""
    def score(features: DataFrame, config, prefix: str) -> DataFrame:
        return models[config.side].transform(features, prefix).select(
            *features.columns, f"{prefix}_p0", f"{prefix}_p1")
    return score


def fit_stack(
    training: DataFrame, label: str, base_a: Sequence[str], base_b: Sequence[str],
    meta: Sequence[str], trees: int = 10, depth: int = 4, seed: int = 7,
) -> StackedModel:
    """Fit the stack on rows with a label."""
    rows = training.filter(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double"))

    def boosted(columns: Sequence[str], out: str) -> PipelineModel:
        model = GBTClassifier(featuresCol=f"_v_{out}", labelCol="_y", predictionCol=f"_c_{out}",
                              maxIter=trees, maxDepth=depth, seed=seed)
        model = model.copy({model.probabilityCol: f"_p_{out}",
                                        model.rawPredictionCol: f"_r_{out}"})
        return Pipeline(stages=[*_assembler(columns, out), model]).fit(rows)

    a, b = boosted(base_a, "a"), boosted(base_b, "b")
    top = LogisticRegression(featuresCol="_v_m", labelCol="_y", predictionCol="_c_m",
                             probabilityCol="_p_m", rawPredictionCol="_r_m", regParam=0.01)
    inputs = [*meta, *PROBABILITIES]
    fitted = Pipeline(stages=[*_assembler(inputs, "m"), top]).fit(
        StackedModel._with_base(rows, a, b))
    return StackedModel(a, b, fitted)
