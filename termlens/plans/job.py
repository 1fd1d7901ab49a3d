"""The relevance job from files to files: read, fit, evaluate, store the model, score new pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens import schemas
from termlens.plans import relevance
from termlens.sources import readers, writers


@dataclass(frozen=True)
class JobInputs:
    """Delimited files with a header; columns are found by name and are all text."""

    train: str
    new: str
    attributes: str
    descriptions: str


@dataclass(frozen=True)
class JobOutputs:
    """Where the job writes: id, label, prediction of held-out pairs; id, prediction of new ones."""

    vectors: str
    new_vectors: str
    model: str
    evaluation: str
    scores: str


def outputs_under(folder: str) -> JobOutputs:
    return JobOutputs(*[f"{folder}/{name}" for name in ("vectors", "new-vectors", "model", "evaluation", "scores")])


def pair_key() -> Column:
    """The labelled file has no id: a hash of the row stands for it, so equal rows share a split."""
    return F.xxhash64("product_uid", "product_title", "search_term", "relevance")


def read_inputs(spark: SparkSession, inputs: JobInputs) -> dict[str, DataFrame]:
    """The four tables; texts may hold quotes and line breaks, and every file is read by many tasks."""
    kinds = {
        "train": schemas.LABELLED_PAIRS_TEXT,
        "new": schemas.NEW_PAIRS_TEXT,
        "attributes": schemas.ATTRIBUTES_TEXT,
        "descriptions": schemas.DESCRIPTIONS_TEXT,
    }
    return {
        name: readers.read_quoted(spark, getattr(inputs, name), schema)
        for name, schema in kinds.items()
    }


def run(spark: SparkSession, inputs: JobInputs, outputs: JobOutputs) -> relevance.FittedRelevance:
    tables = read_inputs(spark, inputs)
    pairs = relevance.labelled(tables["train"].withColumn("id", pair_key()))
    products = relevance.product_entries(tables["descriptions"], tables["attributes"])
    vectors = relevance.field_vectors(
        pairs, tables["descriptions"], tables["attributes"], path=outputs.vectors, products=products
    )
    fitted = relevance.fit_relevance(vectors)
    writers.save_model(fitted.model, outputs.model)
    writers.write_delimited(relevance.evaluation_report(fitted.model, vectors), outputs.evaluation)
    new = relevance.field_vectors(
        tables["new"], tables["descriptions"], tables["attributes"], path=outputs.new_vectors, products=products
    )
    scores = relevance.score_pairs(readers.load_model(outputs.model), new)
    writers.write_delimited(scores, outputs.scores)
    return fitted
