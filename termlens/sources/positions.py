"""Rows of stored sets by their place in the files: for sets that agree in nothing but their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.sources.workspace import materialize

PLACE = "_place"


def file_place() -> Column:
    """Where a row stands in the files it is read from: the file, in the order of part numbers and names, the range of the
    file, and the row's place in what its task reads of it."""
    path = F.col("_metadata.file_path")
    part = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    return F.struct(
        F.regexp_extract(path, r"^(.*/)?[^/]*$", 1).alias("folder"),
        F.coalesce(part, F.lit(0)).alias("part"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def number_rows(rows: DataFrame, output: str = "row_number") -> DataFrame:
    """Rows with a column ``_place`` (``file_place``), numbered from 0 in that order instead; stored.

    A range of a file is read by one task in order, so a number is the rows of the ranges before, summed over one
    small row for each range, plus the place in its own.
    """
    stored = materialize(rows, "placed-rows")
    key = [F.col(f"{PLACE}.{name}") for name in ("folder", "part", "file", "block")]
    ranges = stored.groupBy(F.xxhash64(*key).alias("_range"), F.struct(*key).alias("range")).agg(
        F.min(f"{PLACE}.at").alias("_first"), F.count(F.lit(1)).alias("n")
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_range", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # one row for each range of the files
    numbered = stored.withColumn("_range", F.xxhash64(*key)).join(F.broadcast(starts), "_range")
    number = F.col("_start") + F.col(f"{PLACE}.at") - F.col("_first")
    return numbered.withColumn(output, number).drop(PLACE, "_range", "_first", "_start")


def read_json_in_order(spark: SparkSession, path: str, schema: T.StructType, output: str = "row_number") -> DataFrame:
    """JSON lines with the number of each row in the order of the files."""
    return number_rows(spark.read.schema(schema).json(path).withColumn(PLACE, file_place()), output)


def pair_by_position(left: DataFrame, right: DataFrame, number: str = "row_number") -> DataFrame:
    """The columns of two numbered sets side by side, row by row; sets of different lengths are an error."""
    shared = (set(left.columns) & set(right.columns)) - {number}
    if shared:
        raise ValueError(f"both sets have the columns {', '.join(sorted(shared))}")
    sizes = [side.agg(F.count(F.lit(1))).first()[0] for side in (left, right)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"sets of {sizes[0]} and {sizes[1]} rows cannot be paired by position")
    return left.join(right, number).drop(number)
