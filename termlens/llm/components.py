"""Connected components and joins that hold under hot keys, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.sources.workspace import new_folder, remove

#: Parts over which the rows of any one key are spread in a join.
SPREAD = 16


def join_spread(rows: DataFrame, lookup: DataFrame, key: str, by: str, how: str = "inner", parts: int = SPREAD) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has ``key`` once, with every key's rows in ``parts`` tasks.

    ``by`` is a column whose hash spreads the rows; the lookup is copied ``parts`` times.
    """
    spread = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copied = lookup.withColumn("__part", F.explode(F.array(*[F.lit(n) for n in range(parts)])))
    return spread.join(copied, [key, "__part"], how).drop("__part")


def components(edges: DataFrame) -> DataFrame:
    """node, component of the graph of ``edges`` (a, b): the smallest node that can be reached.

    Alternating star contraction: a round links the larger neighbours of each node to
    its smallest neighbour, then its smaller ones, until every node hangs on its
    component's smallest; the number of rounds grows with the logarithm of the
    longest chain. The smallest neighbours are combined before the shuffle, and a hub's
    links are spread over tasks. Every round is stored in the shared folder, so a lost
    executor costs no earlier round. Nodes without a link are not returned.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark, "links")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def linked_to_least(pairs: DataFrame) -> DataFrame:
        """(node, other) -> (node, other, least of the node's others and itself)."""
        least = pairs.groupBy("node").agg(F.min("other").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        return join_spread(pairs, least, "node", "other")

    def is_done(pairs: DataFrame) -> bool:
        """Every node hangs on one other that hangs on none."""
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        both = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return both.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()

    links, path = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not is_done(links):
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        large = linked_to_least(both).where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
        large, between = stored(large.where("a <> b").distinct())
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        small = linked_to_least(down)
        small = small.select(F.col("other").alias("a"), F.col("least").alias("b")).union(
            small.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
        following, next_path = stored(small.where("a <> b").distinct())
        remove(spark, between)
        remove(spark, path)
        links, path = following, next_path
    tops = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
