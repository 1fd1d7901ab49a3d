from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import NGram, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from termlens.functions import stopwords, text

EDGE_ROWS = [
    ("blanks", " The  quick fox ", " The  quick fox ", ["", "the", "", "quick", "fox"]),
    ("empty", "", "", [""]),
    ("blank only", "  ", "  ", []),
    ("null", None, None, []),
    ("decimal", "12.5", "##", ["##"]),
    ("fraction", "x 3/4", "x ##", ["x", "##"]),
    ("accent", "Élan 12.5\nin", "lan ##in", ["lan", "##in"]),
    ("code", "small ring Brand#2", "small ring Brand##", ["small", "ring", "brand##"]),
    ("priority", "red bolt 1-URGENT", "red bolt #URGENT", ["red", "bolt", "#urgent"]),
    ("apostrophe", "don't", "dont", ["dont"]),
    ("other digits", "a٣b", "ab", ["ab"]),
    ("trailing", "a b  ", "a b  ", ["a", "b"]),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(name, raw) for name, raw, _, _ in EDGE_ROWS], "name string, raw string")


def _by_name(rows):
    return {row["name"]: row["out"] for row in rows.collect()}


def test_cleaning_of_edge_rows(edge):
    out = _by_name(edge.select("name", text.clean_text("raw").alias("out")))
    assert out == {name: cleaned for name, _, cleaned, _ in EDGE_ROWS}


def test_tokens_of_edge_rows(edge):
    out = _by_name(edge.select("name", text.tokenize(text.clean_text("raw")).alias("out")))
    assert out == {name: tokens for name, _, _, tokens in EDGE_ROWS}


def test_stop_words_are_the_default_list(spark):
    assert list(stopwords.ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


def test_stop_words_any_case_and_copies_kept(spark):
    rows = spark.createDataFrame([(["The", "fox", "the", "fox", ""],)], "t array<string>")
    assert rows.select(text.remove_stop_words("t")).first()[0] == ["fox", "fox", ""]
    gone = spark.createDataFrame([("the and of",)], "t string")
    assert gone.select(text.clean_tokens("t")).first()[0] == []
    assert rows.select(text.remove_stop_words("t", ["FOX"])).first()[0] == ["The", "the", ""]


def test_drop_empty(spark):
    rows = spark.createDataFrame([(" a  fox ",)], "t string")
    assert rows.select(text.clean_tokens("t")).first()[0] == ["", "", "fox"]
    assert rows.select(text.clean_tokens("t", drop_empty=True)).first()[0] == ["fox"]


def test_bigrams_and_longer(spark):
    rows = spark.createDataFrame([(["x"],), ([],), (["x", "y", "z"],)], "t array<string>")
    assert [r[0] for r in rows.select(text.bigrams("t")).collect()] == [[], [], ["x y", "y z"]]
    assert [r[0] for r in rows.select(text.ngrams("t", 3)).collect()] == [[], [], ["x y z"]]


def test_padding(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6],), ([],)], "t array<int>")
    padded = [r[0] for r in rows.select(text.pad_sequence("t", 5)).collect()]
    assert padded == [[1, 2, 3, 0, 0], [1, 2, 3, 4, 5], [0, 0, 0, 0, 0]]


def test_agrees_with_the_ml_stages_on_all_documents(spark, tiny):
    documents = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    cleaned = documents.withColumn("clean", text.clean_text("text"))
    staged = Tokenizer(inputCol="clean", outputCol="split").transform(cleaned)
    staged = StopWordsRemover(inputCol="split", outputCol="kept").transform(staged)
    staged = NGram(n=2, inputCol="kept", outputCol="grams").transform(staged)
    compared = staged.select(
        (F.col("split") == text.tokenize("clean")).alias("tokens"),
        (F.col("kept") == text.clean_tokens("text")).alias("kept"),
        (F.col("grams") == text.bigrams(text.clean_tokens("text"))).alias("grams"),
    )
    counts = compared.groupBy("tokens", "kept", "grams").count().collect()
    assert [tuple(row)[:3] for row in counts] == [(True, True, True)]


def _expected_tokens(raw: str) -> list[str]:
    cleaned = re.sub(r"[^a-zA-Z# ]", "", re.sub(r"[0-9]+", "#", raw))
    if cleaned == "":
        tokens = [""]
    else:
        tokens = cleaned.lower().split(" ")
        while tokens and tokens[-1] == "":
            tokens.pop()
    return [t for t in tokens if t not in set(stopwords.ENGLISH)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abTHEof #012.,\n\té", max_size=30), min_size=40, max_size=80))
def test_chain_on_arbitrary_text(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["out"] for r in rows.select("i", text.clean_tokens("t").alias("out")).collect()}
    assert got == {i: _expected_tokens(t) for i, t in enumerate(texts)}


def test_cleaning_stays_out_of_python(spark, tiny):
    documents = spark.read.parquet(f"{tiny}/documents.parquet")
    plan = documents.select(text.clean_tokens("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "ReadSchema: struct<text:string>" in plan
