from __future__ import annotations

from pyspark.sql import functions as F

from termlens.functions import labels, splits


def test_cast_of_bad_numbers_is_null(spark):
    rows = spark.createDataFrame([("2.5",), ("x",), (None,), ("",)], "r string")
    assert [r[0] for r in rows.select(labels.cast_relevance("r")).collect()] == [2.5, None, None, None]


def test_classes_at_their_bounds(spark):
    scores = [0.0, 1.24, 1.25, 1.75, 2.25, 2.75, 3.0, 9.0, None]
    rows = spark.createDataFrame([(s,) for s in scores], "r double")
    got = [r[0] for r in rows.select(labels.relevance_class("r")).collect()]
    assert got == [1, 1, 2, 3, 4, 5, 5, 5, None]


def test_class_values(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 0, 7)], "n int")
    got = [r[0] for r in rows.select(labels.class_value("n")).collect()]
    assert got == [1.0, 1.5, 2.0, 2.5, 3.0, 3.0, 3.0]


def test_split_depends_on_the_key_only(spark):
    keys = spark.range(20_000).withColumn("split", splits.split_name("id", inner_percent=80))
    again = (
        spark.range(20_000).repartition(7).withColumn("other", splits.split_name("id", inner_percent=80))
    )
    assert keys.join(again, "id").where(F.col("split") != F.col("other")).count() == 0
    shares = {r["split"]: r["count"] / 20_000 for r in keys.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.64) < 0.02
    assert abs(shares["val"] - 0.16) < 0.02
    assert abs(shares["test"] - 0.20) < 0.02


def test_split_of_large_and_text_keys(spark):
    large = spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "id bigint")
    assert large.where(splits.percentile_of_key("id", 45).between(0, 99)).count() == 2
    named = spark.range(5_000).select(F.col("id").cast("string").alias("id"))
    share = named.where(splits.in_share("id", is_string=True)).count() / 5_000
    assert abs(share - 0.8) < 0.03
