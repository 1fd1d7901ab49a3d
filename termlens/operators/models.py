"""Regression and classification on feature vectors."""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FitSettings:
    """``solver`` is named because the normal equations take 4,096 features at
    most; the hashed vectors are far wider."""

    max_iter: int
    reg_param: float
    elastic_net: float = 0.0
    solver: str = "l-bfgs"
    # gradients as wide as the vectors are merged in a tree of tasks
    aggregation_depth: int = 3


# The settings each job fits with.
BIGRAM_FIT = FitSettings(max_iter=20, reg_param=0.5)
FIELD_FIT = FitSettings(max_iter=10, reg_param=0.2)
CLASS_FIT = FitSettings(max_iter=25, reg_param=0.3)
POOLED_FIT = FitSettings(max_iter=10, reg_param=0.2, solver="normal")


def linear_regression(
    settings: FitSettings, label: str = "relevance", features: str = "features"
) -> LinearRegression:
    return LinearRegression(
        labelCol=label,
        featuresCol=features,
        maxIter=settings.max_iter,
        regParam=settings.reg_param,
        elasticNetParam=settings.elastic_net,
        solver=settings.solver,
        aggregationDepth=settings.aggregation_depth,
    )


def fit_linear(
    rows: DataFrame,
    settings: FitSettings,
    label: str = "relevance",
    features: str = "features",
) -> LinearRegressionModel:
    """Rows without a label do not take part."""
    labelled = rows.where(F.col(label).isNotNull()).select(label, features)
    return linear_regression(settings, label, features).fit(labelled)


def fit_moments(
    spark: SparkSession, moments: np.ndarray, settings: FitSettings, label: str = "relevance", features: str = "features"
) -> LinearRegressionModel:
    """``fit_linear`` by the normal equations from sums alone, as a model that can be stored and loaded; it has no summary.

    ``moments``: sums over the rows of the products of any two of 1, each feature, the label. Features and label are
    standardized, and the penalty is on the standardized weights, as in the engine's own normal equations. A feature without
    variance has weight 0, and a label without variance is the intercept.
    """
    if settings.solver != "normal" or settings.elastic_net or settings.reg_param <= 0:
        raise ValueError("only the normal equations with a quadratic penalty can be solved from sums")
    if not np.isfinite(moments).all():
        raise ValueError("labels and features must be finite")
    n = moments[0, 0]
    if not n:
        raise ValueError("no row has a label")
    means = moments[0, 1:] / n
    covariance = moments[1:, 1:] / n - np.outer(means, means)
    deviations = np.sqrt(np.maximum(np.diagonal(covariance), 0.0))
    spread, of_label = deviations[:-1], deviations[-1]
    weights = np.zeros(len(spread))
    varied = np.flatnonzero(spread) if of_label else np.empty(0, int)
    if len(varied):
        own = spread[varied]
        system = covariance[np.ix_(varied, varied)] / np.outer(own, own)
        system[np.diag_indices(len(varied))] += settings.reg_param / of_label
        weights[varied] = np.linalg.solve(system, covariance[varied, -1] / own) / own
    estimator = linear_regression(settings, label, features)
    java = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        estimator.uid, _py2java(spark.sparkContext, Vectors.dense(weights)), float(means[-1] - means[:-1] @ weights)
    )
    return estimator._copyValues(LinearRegressionModel(java))


def fit_classes(
    rows: DataFrame,
    settings: FitSettings = CLASS_FIT,
    label: str = "label",
    features: str = "features",
) -> LogisticRegressionModel:
    labelled = rows.where(F.col(label).isNotNull()).select(label, features)
    return LogisticRegression(
        labelCol=label,
        featuresCol=features,
        maxIter=settings.max_iter,
        regParam=settings.reg_param,
        elasticNetParam=settings.elastic_net,
        aggregationDepth=settings.aggregation_depth,
        family="multinomial",
    ).fit(labelled)


@dataclass(frozen=True)
class FitSummary:
    iterations: int
    objective_history: list[float]
    rmse: float
    r2: float
    intercept: float
    n_features: int


def summarize(model: LinearRegressionModel) -> FitSummary:
    """Measures over the training rows; read them while those rows are kept."""
    summary = model.summary
    return FitSummary(
        iterations=int(summary.totalIterations),
        objective_history=[float(value) for value in summary.objectiveHistory],
        rmse=float(summary.rootMeanSquaredError),
        r2=float(summary.r2),
        intercept=float(model.intercept),
        n_features=int(model.numFeatures),
    )


def fit_summary(spark: SparkSession, summary: FitSummary) -> DataFrame:
    """The summary of a fit as one row."""
    return spark.createDataFrame(
        [astuple(summary)],
        "iterations int, objective_history array<double>, rmse double, r2 double,"
        " intercept double, n_features int",
    )


def coefficients(spark: SparkSession, model: LinearRegressionModel) -> DataFrame:
    """index, coefficient: the non-zero ones, at most as many as the model is wide."""
    dense = model.coefficients.toArray()
    rows = [(int(i), float(dense[i])) for i in dense.nonzero()[0]]
    return spark.createDataFrame(rows, "index int, coefficient double")
