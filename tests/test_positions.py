from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.operators import embeddings
from termlens.sources import positions, readers

TEXT = T.StructType([T.StructField("text", T.StringType())])
SCORE = T.StructType([T.StructField("score", T.LongType())])


def test_keyless_sets_are_paired_in_the_order_of_their_files(spark, tmp_path):
    n = 500
    frame = spark.range(n).repartitionByRange(7, "id").sortWithinPartitions("id")
    texts, scores = str(tmp_path / "texts"), str(tmp_path / "scores")
    frame.select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).write.json(texts)
    # the other set is cut into files in another way
    spark.range(n).repartitionByRange(3, "id").sortWithinPartitions("id").select(F.col("id").alias("score")).write.json(scores)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        left = positions.read_json_in_order(spark, texts, TEXT)
        right = positions.read_json_in_order(spark, scores, SCORE)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.row_number for r in left.collect()) == list(range(n))
    paired = positions.pair_by_position(left, right)
    assert paired.columns == ["text", "score"]
    assert all(r.text == f"t{r.score}" for r in paired.collect()) and paired.count() == n


def test_sets_of_other_lengths_or_shared_columns_are_errors(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.range(5).select(F.col("id").alias("score")).write.json(path)
    rows = positions.read_json_in_order(spark, path, SCORE)
    with pytest.raises(ValueError, match="5 and 4"):
        positions.pair_by_position(rows, rows.withColumnRenamed("score", "other").limit(4))
    with pytest.raises(ValueError, match="score"):
        positions.pair_by_position(rows, rows)
    assert positions.pair_by_position(rows.limit(0), rows.limit(0).withColumnRenamed("score", "other")).count() == 0


def test_part_numbers_are_ordered_as_numbers(spark, tmp_path):
    for number in (99999, 100000, 2):
        (tmp_path / f"part-{number:05d}-x.json").write_text(f'{{"score": {number}}}\n')
    rows = positions.read_json_in_order(spark, str(tmp_path), SCORE)
    assert [r.score for r in rows.orderBy("row_number").collect()] == [2, 99999, 100000]


def test_last_vector_of_a_word_wins(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text("a 9 9\nb 1 1\na 5 5\n")
    (tmp_path / "part-1.txt").write_text("a 3 3\nc 8 8\nc 7 7\na 1 2\n")
    terms = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, term_id int")
    matrix = embeddings.embedding_matrix(terms, readers.read_word_vectors(spark, str(tmp_path), 2).repartition(5), 2)
    assert {r.term_id: r.vec for r in matrix.collect()} == {0: [0, 0], 1: [1, 2], 2: [1, 1], 3: [7, 7]}
