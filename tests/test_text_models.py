from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termlens.operators.products import attribute_text, name_value_text
from termlens.plans import relevance
from termlens.sources import readers, retail, writers


@pytest.fixture(scope="module")
def pairs(spark, tiny):
    return relevance.labelled(retail.pairs(spark, tiny)).where("id % 5 = 1").cache()


def _same(left, right):
    left, right = (dict(map(tuple, side.select("id", "prediction").collect())) for side in (left, right))
    assert left.keys() == right.keys() and len(left) > 50
    assert all(abs(left[k] - right[k]) < 1e-9 for k in left)


def test_bigram_model_scores_raw_text_in_tables_and_streams(spark, tiny, pairs, tmp_path):
    attributes = retail.attributes(spark, tiny)
    vectors = relevance.bigram_vectors(pairs, attributes, buckets=500).cache()
    fitted = relevance.fit_bigrams(vectors)
    path = str(tmp_path / "model")
    writers.save_model(relevance.bigram_text_model(fitted.model, 500), path)
    model = readers.load_model(path)
    raw = pairs.join(attribute_text(attributes), "product_uid").select("id", "product_title", "search_term", "attributes")
    expected = relevance.score_pairs(fitted.model, vectors)
    _same(relevance.score_pairs(model, raw), expected)

    raw.repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).json(str(tmp_path / "in"))
    scored = relevance.score_pairs(model, stream)
    query = scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    _same(spark.read.parquet(str(tmp_path / "out")), expected)


def test_field_model_scores_raw_text(spark, tiny, pairs, tmp_path):
    descriptions, attributes = retail.descriptions(spark, tiny), retail.attributes(spark, tiny)
    vectors = relevance.field_vectors(pairs, descriptions, attributes, buckets=64)
    fitted = relevance.fit_relevance(vectors)
    path = str(tmp_path / "model")
    writers.save_model(relevance.field_text_model(fitted.model, 64), path)
    texts = descriptions.join(attribute_text(attributes, name_value_text()), "product_uid")
    raw = pairs.join(texts, "product_uid")
    _same(relevance.score_pairs(readers.load_model(path), raw), relevance.score_pairs(fitted.model, vectors))


def test_null_text_is_scored_as_no_words(spark, pairs):
    model = relevance.length_text_model
    from pyspark.ml.functions import array_to_vector

    from termlens.operators import models

    rows = spark.createDataFrame([(float(n), 2.0 * n) for n in range(9)], "x double, relevance double")
    regression = models.fit_linear(rows.withColumn("features", array_to_vector(F.array("x"))), models.POOLED_FIT)
    raw = spark.createDataFrame([(1, None, None), (2, "", "red hammer")], "id int, product_title string, search_term string")
    scores = dict(map(tuple, relevance.score_pairs(model(regression), raw).collect()))
    assert abs(scores[1] - regression.intercept) < 1e-9
    # the empty title counts as one empty token
    assert abs(scores[2] - regression.intercept - 3 * regression.coefficients[0]) < 1e-9
