"""Writing results and the tables between stages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_delimited(
    df: DataFrame,
    path: str,
    header: bool = True,
    separator: str = ",",
    escape: str | None = None,
    single_file: bool = False,
) -> None:
    """``single_file`` sends all rows through one task: for small reports only."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").option("header", header).option("sep", separator)
    if escape is not None:
        writer = writer.option("escape", escape)
    writer.csv(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.write.mode("overwrite").parquet(path)


def write_json_dictionary(vocabulary: DataFrame, path: str, single_file: bool = False) -> None:
    """The dictionary as one JSON object of terms and ids: the files, in the order of their names, join to it.

    Rows are sorted over tasks by id. ``single_file`` sends all through one task.
    """
    ends = vocabulary.agg(F.min("term_id").alias("first"), F.max("term_id").alias("last"))
    entry = F.to_json(F.create_map("term", "term_id"))
    inner = F.substring(entry, F.lit(2), F.length(entry) - 2)
    # the ends are one row
    opened = F.when(F.col("term_id") == F.col("first"), "{").otherwise(", ")
    closed = F.when(F.col("term_id") == F.col("last"), "}").otherwise("")
    lines = vocabulary.crossJoin(F.broadcast(ends)).select("term_id", F.concat(opened, inner, closed).alias("value"))
    ordered = lines.coalesce(1).sortWithinPartitions("term_id") if single_file else lines.orderBy("term_id")
    if vocabulary.isEmpty():
        ordered = vocabulary.sparkSession.range(1).select(F.lit("{}").alias("value"))
    ordered.select("value").write.mode("overwrite").text(path)


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """One line ``word v1 .. vN`` per row of (term, vec)."""
    numbers = F.array_join(F.col("vec").cast("array<string>"), " ")
    vectors.select(F.concat_ws(" ", "term", numbers).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def preview(df: DataFrame, *order: Column | str, n: int = 20) -> DataFrame:
    """The first ``n`` rows in a stated order, still a DataFrame."""
    return df.orderBy(*order).limit(n)
