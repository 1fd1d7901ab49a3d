"""Measures of predictions and of token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residuals(
    predictions: DataFrame, label: str = "relevance", prediction: str = "prediction"
) -> DataFrame:
    return predictions.withColumn(
        "residual", F.col(label).cast("double") - F.col(prediction)
    )


def regression_metrics(
    predictions: DataFrame, label: str = "relevance", prediction: str = "prediction"
) -> DataFrame:
    """n, rmse, mae, r2 in one pass; rows without a label are left out.

    ``mae`` is also what a per-row "root of the squared error" averages to.
    """
    error = F.col(label) - F.col(prediction)
    rows = predictions.select(
        F.col(label).cast("double").alias(label), F.col(prediction).alias(prediction)
    ).where(F.col(label).isNotNull())
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).alias("sse"),
        F.sum(F.abs(error)).alias("sae"),
        F.var_pop(label).alias("variance"),
    )
    return sums.select(
        "n",
        F.sqrt(F.try_divide("sse", "n")).alias("rmse"),
        F.try_divide("sae", "n").alias("mae"),
        (F.lit(1.0) - F.try_divide("sse", F.col("variance") * F.col("n"))).alias("r2"),
    )


def split_sizes(rows: DataFrame, split: str = "split") -> DataFrame:
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def mean_sequence_length(rows: DataFrame, *sequences: str) -> DataFrame:
    """Average length of each array column, cut to whole numbers."""
    return rows.agg(
        *[F.floor(F.avg(F.size(name))).cast("int").alias(name) for name in sequences]
    )
