"""Exact term statistics: frequency, document frequency, IDF, TF-IDF.

Every function takes one row per document with a token array, so counts within
a document are made inside the row and only per-term totals are shuffled, after
being combined in each map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.functions.text import term_counts
from termlens.operators.joins import ROWS_PER_SPLIT, join_unique
from termlens.sources.workspace import materialize


def tf_terms(documents: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """key, term, tf."""
    return documents.select(key, F.inline(term_counts(tokens)))


def document_frequency(documents: DataFrame, tokens: str = "tokens") -> DataFrame:
    """term, df."""
    return (
        documents.select(F.explode(F.array_distinct(tokens)).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def idf_weight(documents: Column, frequency: Column, min_doc_freq: int = 0) -> Column:
    """ln((m + 1) / (df + 1)); 0 below ``min_doc_freq``."""
    weight = F.log((documents + F.lit(1)) / (frequency + F.lit(1)))
    return F.when(frequency >= F.lit(min_doc_freq), weight).otherwise(F.lit(0.0))


def idf_terms(documents: DataFrame, tokens: str = "tokens", min_doc_freq: int = 0) -> DataFrame:
    """term, df, idf."""
    number = documents.agg(F.count(F.lit(1))).scalar()
    return document_frequency(documents, tokens).select(
        "term", "df", idf_weight(number, F.col("df"), min_doc_freq).alias("idf")
    )


def tfidf_terms(
    documents: DataFrame,
    key: str,
    tokens: str = "tokens",
    min_doc_freq: int = 0,
    fitted_on: DataFrame | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """key, term, tf, idf, tfidf; weights come from ``fitted_on`` when given.

    Terms ``fitted_on`` never saw have document frequency 0. A term found in a
    large share of all documents is split over many tasks: its document frequency
    is the number of rows it joins.
    """
    # the texts are read once: all that follows comes from the stored counts
    counted = materialize(documents.select(key, term_counts(tokens).alias("counts")), "term-counts")
    entries = counted.select(key, F.inline("counts"))
    frequencies = entries.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if fitted_on is None:
        number = counted.agg(F.count(F.lit(1))).scalar()
        weights = frequencies.withColumn("idf", idf_weight(number, F.col("n"), min_doc_freq))
    else:
        number = fitted_on.agg(F.count(F.lit(1))).scalar()
        unseen = idf_weight(number, F.lit(0), min_doc_freq)
        fitted = idf_terms(fitted_on, tokens, min_doc_freq).select("term", "idf")
        weights = (
            frequencies.join(fitted, "term", "left")
            .withColumn("idf", F.coalesce("idf", unseen))
        )
    weighted = join_unique(
        entries,
        weights.select("term", "idf"),
        "term",
        spread=key,
        counts=weights.select("term", "n"),
        rows_per_split=rows_per_split,
    )
    return weighted.select(key, "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))
