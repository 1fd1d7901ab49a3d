from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termlens.operators import products


def _attributes(spark, rows):
    return spark.createDataFrame(rows, "product_uid bigint, name string, value string")


def _texts(df):
    return {r[0]: r[1] for r in df.collect()}


def test_values_in_name_order_nulls_skipped(spark):
    rows = _attributes(
        spark,
        [(1, "b", "two"), (1, "a", "one"), (1, "c", None), (2, "a", None), (3, None, "x")],
    )
    assert _texts(products.attribute_text(rows)) == {1: "one two", 2: "", 3: "x"}


def test_name_and_value(spark):
    rows = _attributes(spark, [(1, "n", None), (1, "m", "v"), (1, None, "w"), (2, "n", None)])
    got = _texts(products.attribute_text(rows, products.name_value_text()))
    assert got == {1: "m v", 2: ""}
    names = _texts(products.attribute_text(rows, products.name_text()))
    assert names == {1: "m n", 2: "n"}


def test_copies_are_kept_however_many(spark):
    copies = spark.range(5_000).select(
        F.lit(7).cast("bigint").alias("product_uid"), F.lit("a").alias("name"), F.lit("v").alias("value")
    )
    other = _attributes(spark, [(7, "b", "end"), (8, "a", "x")])
    got = _texts(products.attribute_text(copies.unionByName(other)))
    assert got == {7: " ".join(["v"] * 5_000 + ["end"]), 8: "x"}


def test_inner_join_loses_and_left_join_keeps(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "id bigint, product_uid bigint")
    texts = spark.createDataFrame([(10, "t")], "product_uid bigint, attributes string")
    assert {r["id"] for r in products.join_pairs(pairs, texts).collect()} == {1, 3}
    kept = products.join_pairs(pairs, texts, "left")
    assert {r["id"]: r["attributes"] for r in kept.collect()} == {1: "t", 2: None, 3: "t"}


def test_joins_that_would_show_the_copies_are_refused(spark):
    pairs = spark.createDataFrame([(1, 10)], "id bigint, product_uid bigint")
    texts = spark.createDataFrame([(10, "t")], "product_uid bigint, attributes string")
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            products.join_pairs(pairs, texts, how)


def test_pairs_without_a_product_reach_many_tasks(spark):
    pairs = spark.range(900).select("id", F.lit(None).cast("bigint").alias("product_uid"))
    texts = spark.createDataFrame([(10, "t")], "product_uid bigint, attributes string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = products.join_pairs(pairs, texts, "left", broadcast_bytes=-1)
        assert joined.count() == 900
        assert joined.groupBy(F.spark_partition_id()).count().count() == 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_product_with_a_third_of_all_pairs_is_split(spark, how):
    n = 9_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 997)
    pairs = spark.range(n).select("id", hot.alias("product_uid"))
    entries = spark.range(900).select(
        F.col("id").alias("product_uid"), F.lit("a").alias("name"), F.col("id").cast("string").alias("value")
    )
    texts = products.attribute_text(entries)
    for rows_per_split, broadcast_bytes in ((100, -1), (1_000_000, -1), (100, 1 << 20)):
        joined = products.join_pairs(
            pairs, texts, how, rows_per_split=rows_per_split, broadcast_bytes=broadcast_bytes
        )
        assert joined.columns == ["product_uid", "id", "attributes"]
        assert joined.exceptAll(pairs.join(texts, "product_uid", how)).count() == 0
        assert joined.count() == pairs.join(texts, "product_uid", how).count()


def test_the_hot_product_reaches_many_tasks(spark):
    from termlens.operators import joins

    pairs = spark.range(4_000).select("id", F.lit(5).alias("product_uid"))
    texts = spark.createDataFrame([(5, "t")], "product_uid int, attributes string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.join_unique(
            pairs, texts, "product_uid", "id", rows_per_split=100, broadcast_bytes=-1
        )
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 8 and max(r["count"] for r in tasks) < 1_500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _final_plan(frame):
    frame.count()
    return frame._jdf.queryExecution().toString()


def test_the_pairs_are_never_the_side_that_is_sent(spark):
    pairs = spark.range(200).select("id", (F.col("id") % 7).alias("product_uid"))
    texts = spark.range(7).select(F.col("id").alias("product_uid"), F.lit("t").alias("attributes"))
    small = products.join_pairs(pairs, texts)
    assert "BuildRight" in _final_plan(small) and "BuildLeft" not in _final_plan(small)
    large = products.join_pairs(pairs, texts, broadcast_bytes=-1)
    last = _final_plan(large.select("id", "attributes"))
    assert "SortMergeJoin [product_uid" in last and "BuildLeft" not in last
