"""Search-relevance inputs derived from the retail star-schema tables.

Parts play the products, parts unpivoted their attributes, documents their
descriptions, and order lines the (search term, product) pairs. The words of a search term are
a few neighbours from a conversation, so the pairs have a dictionary of thousands of terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of long texts."""
    return table(spark, sf_dir, name).select(*columns)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_uid, product_title."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_uid"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("product_title"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_uid, name, value."""
    entries = F.array(
        F.struct(F.lit("brand").alias("name"), F.col("p_brand").alias("value")),
        F.struct(F.lit("type").alias("name"), F.col("p_type").alias("value")),
        F.struct(F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value")),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_uid"), F.inline(entries))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_uid, product_description."""
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("product_uid"), F.col("text").alias("product_description")
    )


#: Words that a search term takes from a conversation.
TERM_WORDS = 5


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, words: all words of each conversation."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")
    )
    return turns.select("conv_id", F.split(F.array_join("turns.text", " "), r"[\x20\x09-\x0D]+").alias("words"))


def untitled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, product_uid, search_term, relevance (text, as in a CSV file).

    Order lines are not unique by (order, line), so they are aggregated first;
    the minima combine before the shuffle, whatever the number of copies. A term is cut
    from its conversation before the line meets its product: what that join shuffles is
    the term's few words, not all words of the conversation.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_partkey").alias("product_uid"),
            F.min("l_suppkey").alias("term_part"),
            F.min("l_discount").alias("discount"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"
    )
    number = table(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("conversations"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    first = (key * TERM_WORDS) % F.greatest(F.size("words") - TERM_WORDS, F.lit(1))
    words = F.slice("words", (first + 1).cast("int"), F.lit(TERM_WORDS))
    term = F.concat(F.array_join(words, " "), F.lit(" "), "o_orderpriority")
    return (
        lines.join(orders, "l_orderkey")
        # one row
        .crossJoin(F.broadcast(number))
        .withColumn("conv_id", F.col("term_part") % F.col("conversations"))
        .join(_spoken(spark, sf_dir), "conv_id")
        .select(
            key.alias("id"),
            "product_uid",
            term.alias("search_term"),
            F.round(F.lit(1) + F.lit(20) * F.col("discount"), 1).cast("string").alias("relevance"),
        )
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, product_uid, product_title, search_term, relevance; lines of unknown products are none."""
    return untitled_pairs(spark, sf_dir).join(products(spark, sf_dir), "product_uid").select(
        "id", "product_uid", "product_title", "search_term", "relevance"
    )


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_uid, n: the order lines of each product, of which each becomes one pair at most where orders are
    unique; read from one column, while to count the pairs would repeat their joins."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_uid"))
    return lines.agg(F.count(F.lit(1)).alias("n"))


def new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unlabelled set: all pairs, without their relevance."""
    return pairs(spark, sf_dir).drop("relevance")
