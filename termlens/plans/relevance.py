"""Fit, score and evaluate relevance on hashed TF-IDF features."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions.labels import cast_relevance, class_value, relevance_class
from termlens.functions.splits import split_name
from termlens.functions.text import bigrams, clean_tokens, join_tokens
from termlens.operators.features import (
    BIGRAM_BUCKETS,
    FIELD_BUCKETS,
    assemble,
    entries,
    fit_idf,
    hash_counts,
    store_vectors,
)
from termlens.operators.joins import join_unique
from termlens.operators.metrics import regression_metrics
from termlens.operators.models import (
    BIGRAM_FIT,
    CLASS_FIT,
    FIELD_FIT,
    FitSettings,
    FitSummary,
    fit_classes,
    fit_linear,
    summarize,
)
from termlens.operators.stages import Bigrams, CleanTokens, JoinTokens, PlainVector, TokenNumber
from termlens.operators.products import (
    KEY,
    attribute_text,
    join_pairs,
    name_value_text,
    product_texts,
)
from termlens.sources.workspace import materialize, new_folder, stored_bytes

FIELDS = ("title", "sterm", "descr", "attr")


def labelled(pairs: DataFrame) -> DataFrame:
    """Pairs with a float relevance (null if it is no number) and a split column."""
    return pairs.withColumns(
        {"relevance": cast_relevance("relevance"), "split": split_name("id")}
    )


def pair_tokens(
    pairs: DataFrame, attributes: DataFrame, how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """Pairs with title_tokens, sterm_tokens and attr_tokens.

    Attribute texts are cleaned once per product, before the join. ``counts``: see ``join_pairs``.
    """
    texts = attribute_text(attributes).select(KEY, clean_tokens("attributes").alias("attr_tokens"))
    return join_pairs(pairs, texts, how, counts=counts).withColumns(
        {
            "title_tokens": clean_tokens("product_title"),
            "sterm_tokens": clean_tokens("search_term"),
            "attr_tokens": F.coalesce("attr_tokens", F.array().cast("array<string>")),
        }
    )


def bigram_vectors(
    pairs: DataFrame,
    attributes: DataFrame,
    buckets: int = BIGRAM_BUCKETS,
    how: str = "inner",
    counts: DataFrame | None = None,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Pairs with ``tf``: hashed bigram counts of title, search term and attributes.

    The bigrams are those of ``text.bigrams``; next to the hashing stage the ML stage makes them in half the time.
    With ``titles`` (product_uid, product_title) the pairs have no title of their own: a title is cleaned once per product, and the
    bigrams inside titles and attributes are made there too. Pairs of a product without a row in ``titles`` are lost.
    """
    if titles is None:
        tokens = pair_tokens(pairs, attributes, how, counts)
        joined = join_tokens("title_tokens", "sterm_tokens", "attr_tokens")
        tokens = tokens.select(*pairs.columns, joined.alias("tokens"))
        own = None
    else:
        known = _product_bigrams(titles, attributes, how)
        # only what stands next to the search term makes further bigrams with it
        joined = join_tokens("title_end", clean_tokens("search_term"), "attr_start")
        tokens = join_pairs(pairs, known, counts=counts).select(*pairs.columns, "own_bigrams", joined.alias("tokens"))
        own = "own_bigrams"
    grams = NGram(n=2, inputCol="tokens", outputCol="bigrams").transform(tokens)
    if own is not None:
        grams = grams.withColumn("bigrams", F.concat(own, "bigrams"))
    counted = hash_counts(grams, ["bigrams"], buckets)
    return counted.select(*pairs.columns, F.col("bigrams_tf").alias("tf"))


def _product_bigrams(titles: DataFrame, attributes: DataFrame, how: str) -> DataFrame:
    """Products with the bigrams inside their title and attributes, and the tokens that a search term stands between."""
    texts = attribute_text(attributes).select(KEY, clean_tokens("attributes").alias("attr_tokens"))
    tokens = titles.select(KEY, clean_tokens("product_title").alias("title_tokens")).join(texts, KEY, how)
    attr = F.coalesce("attr_tokens", F.array().cast("array<string>"))
    return tokens.withColumn("attr_tokens", attr).select(
        KEY,
        F.concat(bigrams("title_tokens"), bigrams("attr_tokens")).alias("own_bigrams"),
        F.slice("title_tokens", F.greatest(F.size("title_tokens"), F.lit(1)), F.lit(1)).alias("title_end"),
        F.slice("attr_tokens", 1, 1).alias("attr_start"),
    )


@dataclass(frozen=True)
class ProductEntries:
    """The entries of the products' two fields, stored, for all sets of pairs that meet them."""

    rows: DataFrame
    stored_bytes: int


def product_entries(
    descriptions: DataFrame, attributes: DataFrame, buckets: int = FIELD_BUCKETS, how: str = "inner"
) -> ProductEntries:
    made = _product_entries(descriptions, attributes, buckets, how)
    path = new_folder(made.sparkSession, "product-entries")
    return ProductEntries(materialize(made, "product-entries", path), stored_bytes(made.sparkSession, path))


def field_counts(
    pairs: DataFrame,
    descriptions: DataFrame,
    attributes: DataFrame,
    buckets: int = FIELD_BUCKETS,
    how: str = "inner",
    products: ProductEntries | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Pairs with ``tf``: hashed counts of the four fields side by side, as a struct.

    A product's description and attributes are cleaned and hashed once per
    product; what meets the pairs are sparse vectors, not texts. The pairs' own
    fields are hashed after that join, for the pairs it keeps. With
    ``how='left'`` pairs without a product are kept, with nothing in those fields.
    ``products`` (of the same tables, ``buckets`` and ``how``) saves making them again for further pairs.
    ``counts``: see ``join_pairs``.
    """
    known = products or product_entries(descriptions, attributes, buckets, how)
    joined = join_unique(pairs, known.rows, KEY, "id", how, counts, lookup_bytes=known.stored_bytes)
    wide = assemble(["pair_part", "product_part"], len(FIELDS) * buckets)
    return _pair_entries(joined, buckets).select(*pairs.columns, wide.alias("tf"))


def _pair_entries(pairs: DataFrame, buckets: int) -> DataFrame:
    """Pairs with the entries of their own fields."""
    own = pairs.withColumns(
        {"title": clean_tokens("product_title"), "sterm": clean_tokens("search_term")}
    )
    return hash_counts(own, FIELDS[:2], buckets).select(
        *pairs.columns, entries(_counted(FIELDS[:2]), buckets).alias("pair_part")
    )


def _product_entries(
    descriptions: DataFrame, attributes: DataFrame, buckets: int, how: str
) -> DataFrame:
    """Products with the entries of their two fields."""
    both = "full" if how == "left" else how
    texts = product_texts(
        descriptions, attribute_text(attributes, name_value_text()), how=both
    ).select(
        KEY,
        clean_tokens("product_description").alias("descr"),
        clean_tokens("attributes").alias("attr"),
    )
    return hash_counts(texts, FIELDS[2:], buckets).select(
        KEY, entries(_counted(FIELDS[2:]), buckets, 2).alias("product_part")
    )


def _counted(fields: Iterable[str]) -> list[str]:
    return [f"{name}_tf" for name in fields]


def field_vectors(
    pairs: DataFrame,
    descriptions: DataFrame,
    attributes: DataFrame,
    buckets: int = FIELD_BUCKETS,
    how: str = "inner",
    path: str | None = None,
    products: ProductEntries | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``field_counts`` stored, with ``tf`` as an ML vector; without the texts."""
    counted = field_counts(pairs, descriptions, attributes, buckets, how, products, counts)
    return store_vectors(
        counted.drop("product_title", "search_term"), "tf", len(FIELDS) * buckets, path
    )


@dataclass(frozen=True)
class FittedRelevance:
    """``model`` maps ``tf`` to ``prediction`` and can be stored and loaded."""

    model: PipelineModel
    summary: FitSummary
    train_rows: int
    skipped_rows: int

    @property
    def regression(self) -> LinearRegressionModel:
        return self.model.stages[-1]


def fit_relevance(
    vectors: DataFrame, settings: FitSettings = FIELD_FIT, idf_scope: str = "train"
) -> FittedRelevance:
    """IDF and linear regression on the rows with ``split = 'train'``.

    Held-out rows have no part in the IDF weights unless ``idf_scope='all'``. Rows
    without a label are counted, not fitted. ``vectors`` is read several times:
    give a stored table (``workspace.materialize``), so that the joins and the
    hashing are done once and are not repeated when executors are lost.
    """
    train = vectors.where(F.col("split") == "train")
    idf = fit_idf(vectors if idf_scope == "all" else train)
    regression = fit_linear(idf.transform(train), settings)
    sizes = train.agg(
        F.count("relevance").alias("used"), F.count_if(F.isnull("relevance")).alias("skipped")
    ).first()
    return FittedRelevance(
        PipelineModel([idf, regression]), summarize(regression), sizes["used"], sizes["skipped"]
    )


def fit_bigrams(vectors: DataFrame, idf_scope: str = "train") -> FittedRelevance:
    return fit_relevance(vectors, BIGRAM_FIT, idf_scope)


def score_pairs(model: PipelineModel, vectors: DataFrame) -> DataFrame:
    """id, prediction; weights are those of the fitted model, never refitted."""
    return model.transform(vectors).select("id", "prediction")


def score_fields(
    model: PipelineModel,
    pairs: DataFrame,
    descriptions: DataFrame,
    attributes: DataFrame,
    buckets: int = FIELD_BUCKETS,
    how: str = "inner",
    products: ProductEntries | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """id, prediction of pairs from their texts, as ``score_pairs`` of ``field_vectors``.

    The model is linear, so a product's part of the score is worked out once per
    product, and what the join carries is one number instead of a wide vector. The pairs'
    own fields are hashed after it, for the pairs it keeps. ``counts``: see ``join_pairs``.
    """
    size = len(FIELDS) * buckets
    constant = F.lit(float(model.stages[-1].intercept))

    def part(rows: DataFrame, name: str, kept: list[str]) -> DataFrame:
        stored = store_vectors(rows.select(*kept, assemble([name], size).alias("tf")), "tf", size)
        return model.transform(stored).select(*kept, (F.col("prediction") - constant).alias(f"{name}_score"))

    entries_of = products.rows if products else _product_entries(descriptions, attributes, buckets, how)
    scored = part(entries_of, "product_part", [KEY])
    joined = join_pairs(pairs, scored, how, counts=counts)
    own = part(_pair_entries(joined, buckets), "pair_part", ["id", "product_part_score"])
    score = F.col("pair_part_score") + F.coalesce("product_part_score", F.lit(0.0)) + constant
    return own.select("id", score.alias("prediction"))


def evaluation_report(model: PipelineModel, vectors: DataFrame, split: str = "test") -> DataFrame:
    """id, label, prediction of one split."""
    rows = vectors.where((F.col("split") == split) & F.col("relevance").isNotNull())
    return model.transform(rows).select("id", F.col("relevance").alias("label"), "prediction")


def evaluate(model: PipelineModel, vectors: DataFrame, split: str = "test") -> DataFrame:
    return regression_metrics(evaluation_report(model, vectors, split), "label")


def fit_relevance_classes(
    vectors: DataFrame, settings: FitSettings = CLASS_FIT, idf_scope: str = "train"
) -> PipelineModel:
    """IDF and multinomial regression on the relevance classes; see fit_relevance."""
    train = vectors.where(F.col("split") == "train")
    idf = fit_idf(vectors if idf_scope == "all" else train)
    labels = idf.transform(train).withColumn("label", relevance_class("relevance"))
    return PipelineModel([idf, fit_classes(labels, settings)])


def score_classes(model: PipelineModel, vectors: DataFrame) -> DataFrame:
    """The class predicted for each pair and the relevance that class stands for."""
    return model.transform(vectors).withColumn("predicted_value", class_value("prediction"))


def evaluate_classes(predicted: DataFrame) -> DataFrame:
    """split, n, rmse, mae of the values that predicted classes stand for."""
    valued = predicted.where(F.col("relevance").isNotNull()).withColumn("value", class_value("prediction"))
    error = F.col("relevance").cast("double") - F.col("value")
    return valued.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae")
    )


# Raw-text columns that a text model takes, in the order of the fields.
TEXT_COLUMNS = ("product_title", "search_term", "product_description", "attributes")


def _cleaned(columns: Iterable[str]) -> list[CleanTokens]:
    return [CleanTokens(name, f"{name}_tokens") for name in columns]


def bigram_text_model(fitted: PipelineModel, buckets: int = BIGRAM_BUCKETS) -> PipelineModel:
    """A model that takes product_title, search_term and attributes as text, from one fitted on ``bigram_vectors``.

    It can be stored and loaded, and scores tables and streams alike.
    """
    names = [name for name in TEXT_COLUMNS if name != "product_description"]
    return PipelineModel(
        [
            *_cleaned(names),
            JoinTokens([f"{name}_tokens" for name in names], "tokens"),
            Bigrams("tokens", "bigrams"),
            HashingTF(inputCol="bigrams", outputCol="tf", numFeatures=buckets),
            *fitted.stages,
        ]
    )


def field_text_model(fitted: PipelineModel, buckets: int = FIELD_BUCKETS) -> PipelineModel:
    """A model that takes the four fields as text, from one fitted on ``field_vectors``."""
    hashed = [HashingTF(inputCol=f"{n}_tokens", outputCol=f"{n}_tf", numFeatures=buckets) for n in TEXT_COLUMNS]
    together = VectorAssembler(inputCols=[f"{n}_tf" for n in TEXT_COLUMNS], outputCol="wide")
    return PipelineModel([*_cleaned(TEXT_COLUMNS), *hashed, together, PlainVector("wide", "tf"), *fitted.stages])


def length_text_model(regression: LinearRegressionModel) -> PipelineModel:
    """A model that takes product_title and search_term as text, from one fitted on the number of their tokens."""
    names = TEXT_COLUMNS[:2]
    tokens = JoinTokens([f"{name}_tokens" for name in names], "tokens")
    return PipelineModel([*_cleaned(names), tokens, TokenNumber("tokens", "features"), regression])
