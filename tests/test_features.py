from __future__ import annotations

import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from termlens.functions.text import clean_tokens
from termlens.operators import features, products
from termlens.plans import relevance
from termlens.sources import retail

# Buckets of 16,384 by term.
BUCKETS = {"a": 8803, "ab": 3655, "abc": 7784, "abcd": 9676, "abcde": 11248, "#": 2103, "": 3420}


def test_known_buckets(spark):
    rows = spark.createDataFrame([(t, [t]) for t in BUCKETS], "term string, tokens array<string>")
    hashed = features.hash_counts(rows, ["tokens"])
    got = {r["term"]: r["index"] for r in features.vector_entries(hashed, "term", "tokens_tf").collect()}
    assert got == BUCKETS


def test_assembled_entries_equal_the_assembler(spark):
    rows = spark.createDataFrame(
        [(1, ["a", "b", "a"], ["c"]), (2, [], ["d", "d"]), (3, [], [])],
        "id int, p array<string>, q array<string>",
    )
    hashed = features.hash_counts(rows, ["p", "q"], 64)
    parts = hashed.select(
        "id",
        features.entries(["p_tf"], 64).alias("first"),
        features.entries(["q_tf"], 64, 1).alias("second"),
    )
    stored = features.store_vectors(
        parts.select("id", features.assemble(["first", "second"], 128).alias("tf")), "tf", 128
    )
    ours = {r["id"]: r["tf"].toArray().tolist() for r in stored.collect()}
    assembled = VectorAssembler(inputCols=["p_tf", "q_tf"], outputCol="v").transform(hashed)
    assert ours == {r["id"]: r["v"].toArray().tolist() for r in assembled.collect()}
    assert stored.schema["tf"].metadata == {"ml_attr": {"num_attrs": 128}}


def test_idf_of_wide_vector_is_that_of_each_field(spark):
    rows = spark.createDataFrame(
        [(1, ["x"], ["y"]), (2, ["x", "z"], []), (3, [], ["y", "y"])],
        "id int, p array<string>, q array<string>",
    )
    hashed = features.hash_counts(rows, ["p", "q"], 32)
    both = hashed.select("id", features.entries(["p_tf", "q_tf"], 32).alias("both"))
    wide = features.store_vectors(
        both.select("id", features.assemble(["both"], 64).alias("tf")), "tf", 64
    )
    joined = features.fit_idf(wide).idf.toArray().tolist()
    single = [features.fit_idf(hashed, f"{f}_tf").idf.toArray().tolist() for f in ("p", "q")]
    assert joined == single[0] + single[1]
    assert min(joined) >= 0 and max(joined) == pytest.approx(math.log(4))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_field_vectors_equal_assembled_tokens(spark, tiny, how):
    """Hashing products before the join changes nothing but the work."""
    pairs = relevance.labelled(retail.pairs(spark, tiny)).where(F.col("id") % 10 < 4)
    stored = relevance.field_vectors(
        pairs, retail.descriptions(spark, tiny), retail.attributes(spark, tiny), 256, how
    )
    none = F.array().cast("array<string>")
    texts = products.attribute_text(retail.attributes(spark, tiny), products.name_value_text())
    tokens = (
        pairs.join(retail.descriptions(spark, tiny), "product_uid", how)
        .join(texts, "product_uid", how)
        .select(
            "id",
            clean_tokens("product_title").alias("a"),
            clean_tokens("search_term").alias("b"),
            F.coalesce(clean_tokens("product_description"), none).alias("c"),
            F.coalesce(clean_tokens("attributes"), none).alias("d"),
        )
    )
    hashed = features.hash_counts(tokens, ["a", "b", "c", "d"], 256)
    assembler = VectorAssembler(inputCols=[f"{f}_tf" for f in "abcd"], outputCol="v")
    ours = {r["id"]: r["tf"].toArray().tolist() for r in stored.select("id", "tf").collect()}
    expected = assembler.transform(hashed).select("id", "v").collect()
    assert ours == {r["id"]: r["v"].toArray().tolist() for r in expected} and len(ours) > 500
