"""Hashed TF-IDF vectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import IDF, HashingTF, IDFModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.sources.workspace import new_folder

FIELD_BUCKETS = 16_384
BIGRAM_BUCKETS = 30_000


def hash_counts(
    rows: DataFrame, fields: Iterable[str], buckets: int = FIELD_BUCKETS, suffix: str = "_tf"
) -> DataFrame:
    """Add per token column a vector of hashed term counts, named field + suffix."""
    counted = rows
    for name in fields:
        stage = HashingTF(inputCol=name, outputCol=name + suffix, numFeatures=buckets)
        counted = stage.transform(counted)
    return counted


def entries(columns: Sequence[str], size: int, first: int = 0) -> Column:
    """The entries (indices, values) of vector columns of ``size`` entries each, put
    one behind the other from place ``first`` on."""
    indices, values = [], []
    for place, name in enumerate(columns, start=first):
        stored = F.unwrap_udt(name)
        dense = F.transform(stored["values"], lambda _, i: i)
        own = F.coalesce(stored["indices"], dense)
        indices.append(own if place == 0 else _shifted(own, F.lit(place * size)))
        values.append(stored["values"])
    return F.struct(F.concat(*indices).alias("indices"), F.concat(*values).alias("values"))


def _shifted(indices: Column, offset: Column) -> Column:
    return F.transform(indices, lambda i: i + offset)


def assemble(parts: Sequence[str], size: int) -> Column:
    """Entry columns with rising indices as one sparse struct (type, size, indices,
    values); a null part has no entries.

    The ML assembler would name each of the entries in the column's metadata.
    With tens of thousands of hashed entries that metadata travels with every
    task of every later job, and outweighs the data of a small one.
    """
    no_indices, no_values = (F.array().cast(f"array<{kind}>") for kind in ("int", "double"))
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.concat(*[F.coalesce(f"{part}.indices", no_indices) for part in parts]).alias("indices"),
        F.concat(*[F.coalesce(f"{part}.values", no_values) for part in parts]).alias("values"),
    )


def read_vectors(spark: SparkSession, path: str, column: str, size: int, schema: T.StructType | None = None) -> DataFrame:
    """A table stored by ``store_vectors``, with the sparse struct ``column`` as an ML vector."""
    width = {"ml_attr": {"num_attrs": size}}
    stored = schema or spark.read.parquet(path).schema
    fields = [T.StructField(column, VectorUDT(), True, width) if f.name == column else f for f in stored.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def store_vectors(rows: DataFrame, column: str, size: int, path: str | None = None) -> DataFrame:
    """Write ``rows`` and read them back with the sparse struct ``column`` as an ML
    vector; the stored table is what the fits read again and again."""
    spark = rows.sparkSession
    target = path or new_folder(spark, "vectors")
    rows.write.mode("overwrite").parquet(target)
    return read_vectors(spark, target, column, size, rows.schema)


def fit_idf(
    vectors: DataFrame, column: str = "tf", output: str = "features", min_doc_freq: int = 0
) -> IDFModel:
    """One fit, whatever the number of fields side by side in ``column``: IDF works
    entry by entry, so the weights are those of one fit per field."""
    return IDF(inputCol=column, outputCol=output, minDocFreq=min_doc_freq).fit(vectors)


def vector_entries(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, index, value: the stored entries of sparse vectors as rows."""
    stored = rows.select(key, F.unwrap_udt(vector).alias("v"))
    entries = F.arrays_zip(F.col("v.indices").alias("index"), F.col("v.values").alias("value"))
    return stored.select(key, F.inline(entries))
