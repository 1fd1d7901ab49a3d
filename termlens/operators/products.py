"""Product texts and their joins to (search term, product) pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.operators.joins import BROADCAST_BYTES, ROWS_PER_SPLIT, join_unique

KEY = "product_uid"


def value_text() -> Column:
    return F.col("value")


def name_value_text() -> Column:
    """"name value"; null if either is null."""
    return F.concat(F.col("name"), F.lit(" "), F.col("value"))


def name_text() -> Column:
    return F.col("name")


def attribute_text(
    attributes: DataFrame, text: Column | None = None, output: str = "attributes"
) -> DataFrame:
    """One text per product from its attribute rows, in (name, value) order.

    Null texts are skipped; a product with null texts only gets ``''``. Copies of
    a row are counted before the per-product grouping, so neither a product with
    very many rows nor a much repeated row is sent raw to one task: what meets
    there are the distinct entries of the resulting text.
    """
    entries = attributes.groupBy(KEY, "name", "value").agg(
        F.count(F.lit(1)).cast("int").alias("copies")
    )
    line = value_text() if text is None else text
    entry = F.struct("name", "value", "copies", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.when(line.isNotNull(), entry)))
    lines = F.flatten(F.transform(ordered, lambda e: F.array_repeat(e["line"], e["copies"])))
    return entries.groupBy(KEY).agg(F.array_join(lines, " ").alias(output))


def product_texts(*tables: DataFrame, how: str = "inner") -> DataFrame:
    """Join product-level tables to each other before they meet the pairs.

    They have one row per product, so this is the small join; the pairs are then
    shuffled once, not once per table.
    """
    return reduce(lambda left, right: left.join(right, KEY, how), tables)


def join_pairs(
    pairs: DataFrame,
    products: DataFrame,
    how: str = "inner",
    spread: str = "id",
    rows_per_split: int = ROWS_PER_SPLIT,
    broadcast_bytes: int = BROADCAST_BYTES,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Pairs with the texts of their product; pairs without are lost by default.

    ``products`` has one row per product and is stored. A small table goes to the pairs; with a larger one, a
    product holding a large share of all pairs is split over many tasks. ``counts`` (product_uid, n) saves the pass
    that finds such products.
    """
    return join_unique(
        pairs, products, KEY, spread, how, counts, rows_per_split=rows_per_split, broadcast_bytes=broadcast_bytes
    )
