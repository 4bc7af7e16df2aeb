"""Goal models fitted by Spark: Poisson regression, isotonic calibration, boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import (
    GBTRegressor,
    GeneralizedLinearRegression,
    IsotonicRegression,
    IsotonicRegressionModel,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions.poisson import clip


def goal_regression(
    train: DataFrame, features: Sequence[str], label: str, alpha: float = 0.01, scale: bool = True, max_iter: int = 50
) -> PipelineModel:
    """L2-penalised Poisson regression with log link on (optionally standardised) features.

    Spark's penalty is relative to the sum of working weights, hence alpha over
    the label's mean; and its scaler divides by the sample deviation, hence
    (n - 1) / n for a penalty on features of unit population deviation.
    """
    rows = train.select(*features, label)
    mean, n = rows.agg(F.avg(label), F.count(label)).first()
    if not mean:
        raise ValueError(f"no positive {label} to fit")
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features")]
    vector, penalty = "raw_features", alpha / mean
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True))
        vector, penalty = "scaled_features", penalty * (n - 1) / n
    regression = GeneralizedLinearRegression(
        family="poisson", link="log", featuresCol=vector, labelCol=label, regParam=penalty, maxIter=max_iter,
        tol=1e-6, predictionCol=f"{label}_predicted",
    )
    vectors = Pipeline(stages=stages).fit(rows)
    # every step of the fit reads the assembled rows again
    ready = vectors.transform(rows).select(vector, label).persist()
    try:
        fitted = regression.fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel([*vectors.stages, fitted])


def boosted_goals(
    train_and_validation: DataFrame,
    features: Sequence[str],
    label: str,
    validation: str,
    rounds: int = 100,
    depth: int = 5,
    rate: float = 0.05,
    seed: int = 42,
    patience: int = 50,
    **settings,
) -> PipelineModel:
    """Gradient-boosted trees up to the best round on the rows flagged by ``validation``. The loss is squared error.

    Rounds go on until ``patience`` of them bring nothing better. Spark stops at the first small gain and cannot
    resume, so the fit is repeated with twice the rounds until that is seen; equal seeds give equal first trees.
    """
    trees = GBTRegressor(
        featuresCol="raw_features", labelCol=label, predictionCol=f"{label}_predicted", maxDepth=depth,
        stepSize=rate, subsamplingRate=settings.pop("subsample", 0.8),
        featureSubsetStrategy=settings.pop("columns", "0.8"), minInstancesPerNode=settings.pop("leaf", 20), seed=seed,
        **settings,
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw_features")
    rows = assembler.transform(train_and_validation).select("raw_features", label, validation).persist()
    train, held = rows.filter(~F.col(validation)), rows.filter(F.col(validation))
    tried = min(rounds, 2 * patience)
    model = trees.fit(train, {trees.maxIter: tried})
    best = tried
    if not held.isEmpty():
        while True:
            best = best_round(model.evaluateEachIteration(held, "squared"), patience)
            if tried - best >= patience or tried == rounds:
                break
            tried = min(rounds, 2 * tried)
            model = trees.fit(train, {trees.maxIter: tried})
    if best < tried:
        model = trees.fit(train, {trees.maxIter: best})
    rows.unpersist()
    return PipelineModel([assembler, model])


def best_round(errors: Sequence[float], patience: int) -> int:
    """The round of the least error, counted from 1, before ``patience`` rounds in a row bring nothing better."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def importances(model: PipelineModel, features: Sequence[str], top: int = 20) -> DataFrame:
    """Most important features of a boosted model."""
    from pyspark.sql import SparkSession

    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def predict_goals(df: DataFrame, home: PipelineModel, away: PipelineModel, low: float = 0.1, high: float = 5.0) -> DataFrame:
    """``pred_home, pred_away, pred_total_goals``, each side within its limits."""
    kept = df.columns
    for model, name in ((home, "pred_home"), (away, "pred_away")):
        column = model.stages[-1].getPredictionCol()
        scored = model.transform(df)
        df = scored.select(*df.columns, clip(F.col(column), low, high).alias(name))
    return df.select(*kept, "pred_home", "pred_away", (F.col("pred_home") + F.col("pred_away")).alias("pred_total_goals"))


def calibrator(
    validation: DataFrame, probability: str, outcome: str, minimum: int = 1
) -> IsotonicRegressionModel | None:
    """Isotonic map from model to observed probability; None for too few rows or a single outcome.

    Rows with the same probability are pooled first, which leaves the fit as it is.
    """
    pooled = (
        validation.dropna(subset=[probability, outcome])
        .groupBy(F.col(probability).alias("p"))
        .agg(F.avg(F.col(outcome).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    )
    rows, low, high = pooled.agg(F.sum("w"), F.min("y"), F.max("y")).first()
    if not rows or rows < minimum or low == high and low in (0.0, 1.0):
        return None
    return IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(pooled)


def calibrated(df: DataFrame, model: IsotonicRegressionModel | None, probability: str, out: str) -> DataFrame:
    """Calibrated probability, held at the ends outside the fitted range; unchanged without a model."""
    if model is None:
        return df.withColumn(out, F.col(probability))
    applied = model.copy({model.featuresCol: probability, model.predictionCol: out})
    return applied.transform(df)


