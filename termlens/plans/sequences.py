"""Dictionary jobs: vocabulary, integer sequences, pooled word vectors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions.text import clean_tokens, join_tokens, pad_sequence
from termlens.operators.embeddings import pool_sequences, pooled_features, pooled_moments, pooled_predictions
from termlens.operators.models import POOLED_FIT, FitSettings, fit_linear, fit_moments
from termlens.operators.vocabulary import build_vocabulary, encode_tokens

# Lengths the sequences are padded or cut to.
TITLE_LENGTH = 15
STERM_LENGTH = 10

SEQUENCES = {"title_tokens": "int_title_tokens", "sterm_tokens": "int_sterm_tokens"}
PADDED_LENGTHS = {"int_title_tokens": TITLE_LENGTH, "int_sterm_tokens": STERM_LENGTH}


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with title_tokens, sterm_tokens and both joined."""
    cleaned = pairs.withColumns(
        {
            "title_tokens": clean_tokens("product_title"),
            "sterm_tokens": clean_tokens("search_term"),
        }
    )
    return cleaned.withColumn("tokens", join_tokens("title_tokens", "sterm_tokens"))


def pair_vocabulary(pairs: DataFrame, scope: str = "train", **settings) -> DataFrame:
    """Dictionary of the pairs; of the training rows unless ``scope='all'``."""
    return cleaned_vocabulary(clean_pairs(pairs), scope, **settings)


def cleaned_vocabulary(cleaned: DataFrame, scope: str = "train", **settings) -> DataFrame:
    """``pair_vocabulary`` of pairs that ``clean_pairs`` has cleaned, and that may be stored."""
    rows = cleaned if scope == "all" else cleaned.where(F.col("split") == "train")
    return build_vocabulary(rows, "tokens", **settings)


def encode_pairs(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Pairs with int_title_tokens and int_sterm_tokens; the same for new pairs."""
    return encode_cleaned(clean_pairs(pairs), vocabulary)


def encode_cleaned(cleaned: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``encode_pairs`` of pairs that ``clean_pairs`` has cleaned."""
    return encode_tokens(cleaned, vocabulary, SEQUENCES).drop("tokens", *SEQUENCES)


def pad_pairs(encoded: DataFrame) -> DataFrame:
    return encoded.withColumns(
        {name: pad_sequence(name, length) for name, length in PADDED_LENGTHS.items()}
    )


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and labels stored apart, matched by key and not by row order."""
    return features.join(labels, "id")


def pooled_pairs(encoded: DataFrame, matrix: DataFrame, dimensions: int) -> DataFrame:
    """Encoded pairs with one vector of both fields' pooled word vectors.

    The vectors are far wider than the ids that they come from. Store the ids, if anything: a fit by
    the normal equations reads its rows once, and vectors are pooled faster than they are written and read.
    """
    pooled = pool_sequences(
        pad_pairs(encoded), matrix, {"int_title_tokens": "title", "int_sterm_tokens": "sterm"},
        dimensions,
    )
    return pooled_features(pooled, ["title", "sterm"])


def fit_pooled(rows: DataFrame, settings: FitSettings = POOLED_FIT) -> PipelineModel:
    """A model that can be stored, loaded and applied to new pairs like the others."""
    return PipelineModel([fit_linear(rows.where(F.col("split") == "train"), settings)])


def fit_sequences(
    encoded: DataFrame, matrix: DataFrame, dimensions: int, settings: FitSettings = POOLED_FIT
) -> PipelineModel:
    """``fit_pooled`` of ``pooled_pairs``, for rows too many to hand a wide vector each from task to fit: the
    features are made where the ids are, and only their sums leave the tasks."""
    train = pad_pairs(encoded.where(F.col("split") == "train"))
    moments = pooled_moments(train, matrix, list(PADDED_LENGTHS), dimensions, "relevance")
    return PipelineModel([fit_moments(encoded.sparkSession, moments, settings)])


def score_sequences(model: PipelineModel, encoded: DataFrame, matrix: DataFrame, dimensions: int) -> DataFrame:
    """Encoded pairs with ``prediction``, as ``model.transform`` of ``pooled_pairs``; the features stay where they are made."""
    regression = model.stages[-1]
    if len(model.stages) != 1 or not isinstance(regression, LinearRegressionModel):
        raise ValueError("the model must be one linear regression on pooled features")
    weights = regression.coefficients.toArray()
    return pooled_predictions(
        pad_pairs(encoded), matrix, list(PADDED_LENGTHS), dimensions, weights, float(regression.intercept)
    )
