from __future__ import annotations

import collections
import random

import pytest

from termlens.operators import frequency, metrics, vocabulary

TEXTS = [
    (1, ["b", "a", "c", "c"]),
    (2, ["a", "b", "", "d"]),
    (3, []),
    (4, ["", "e", "e", "e", "a"]),
    (5, ["e"]),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(TEXTS, "id bigint, tokens array<string>")


def _brute(texts, min_documents, size):
    tf = collections.Counter(t for _, tokens in texts for t in tokens)
    df = collections.Counter(t for _, tokens in texts for t in set(tokens))
    kept = sorted((t for t in tf if df[t] >= min_documents), key=lambda t: (-tf[t], t))[:size]
    return [(t, tf[t], df[t], i) for i, t in enumerate(kept, start=1)]


def _table(df):
    return [tuple(r) for r in df.orderBy("term_id").collect()]


def test_against_brute_force(spark, rows):
    assert _table(vocabulary.build_vocabulary(rows)) == _brute(TEXTS, 2, 30_000)
    assert _table(vocabulary.build_vocabulary(rows, size=2)) == _brute(TEXTS, 2, 2)
    drawn = random.Random(5)
    texts = [(i, drawn.choices("abcdefghij", k=drawn.randrange(9))) for i in range(300)]
    many = spark.createDataFrame(texts, "id bigint, tokens array<string>").repartition(5)
    assert _table(vocabulary.build_vocabulary(many, size=6)) == _brute(texts, 2, 6)


def test_drop_empty(rows):
    terms = [r[0] for r in vocabulary.build_vocabulary(rows, drop_empty=True).collect()]
    assert "" not in terms and "a" in terms


ENCODERS = pytest.mark.parametrize("encode", [vocabulary.encode_tokens, vocabulary.encode_tokens_join])


@ENCODERS
def test_encoding_keeps_order_and_drops_unknown(spark, rows, encode):
    terms = vocabulary.build_vocabulary(rows)
    ids = {r["term"]: r["term_id"] for r in terms.collect() if r["term"]}
    both = rows.withColumn("again", rows["tokens"])
    encoded = encode(both, terms, {"tokens": "ids", "again": "more"})
    assert encoded.schema["ids"].dataType.simpleString() == "array<int>"
    for row in encoded.collect():
        expected = [ids[t] for t in row["tokens"] if t in ids]
        assert row["ids"] == expected and row["more"] == expected


@ENCODERS
def test_encoding_needs_no_key(spark, encode):
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (None, ["a"]), (None, None), (2, ["?", ""])], "id int, tokens array<string>")
    terms = spark.createDataFrame([("a", 1), ("b", 2), ("", 3)], "term string, term_id int")
    got = encode(rows, terms, {"tokens": "ids"})
    assert sorted((r["ids"] for r in got.collect())) == [[], [], [1], [1, 2], [2]]
    assert got.columns == ["id", "tokens", "ids"]


def test_a_dictionary_too_large_for_the_driver_is_refused(spark, rows):
    terms = spark.createDataFrame([("a", 1), ("b", 2)], "term string, term_id int")
    with pytest.raises(ValueError, match="encode_tokens_join"):
        vocabulary.encode_tokens(rows, terms, {"tokens": "ids"}, most=1)


def test_vocabulary_without_a_limit(rows):
    assert _table(vocabulary.build_vocabulary(rows, min_documents=1, size=None)) == _brute(TEXTS, 1, 10**9)


def test_both_encodings_agree_on_documents(spark, tiny):
    from checks.queries import _document_tokens

    documents = _document_tokens(spark, tiny)
    terms = vocabulary.build_vocabulary(documents)
    fields = {"tokens": "ids"}
    near = vocabulary.encode_tokens(documents, terms, fields).select("doc_id", "ids")
    far = vocabulary.encode_tokens_join(documents, terms, fields)
    assert near.exceptAll(far.select("doc_id", "ids")).count() == 0


def test_term_frequencies_add_up(spark, tiny):
    from checks.queries import _document_tokens

    documents = _document_tokens(spark, tiny)
    total = documents.selectExpr("sum(size(tokens))").first()[0]
    assert frequency.tf_terms(documents, "doc_id").selectExpr("sum(tf)").first()[0] == total


def test_idf_by_hand(spark):
    rows = spark.createDataFrame([(1, ["x"]), (2, ["x", "y", "z"]), (3, [])], "id int, tokens array<string>")
    got = {r["term"]: round(r["idf"], 4) for r in frequency.idf_terms(rows).collect()}
    assert got == {"x": 0.2877, "y": 0.6931, "z": 0.6931}
    rare = {r["term"]: r["idf"] for r in frequency.idf_terms(rows, min_doc_freq=2).collect()}
    assert rare["y"] == 0.0 and rare["x"] > 0
    new = spark.createDataFrame([(9, ["x", "q"])], "id int, tokens array<string>")
    applied = frequency.tfidf_terms(new, "id", fitted_on=rows).collect()
    assert {r["term"]: round(r["tfidf"], 4) for r in applied} == {"x": 0.2877, "q": 1.3863}


def test_tfidf_does_not_depend_on_the_splits(spark, tiny):
    from checks.queries import _document_tokens

    documents = _document_tokens(spark, tiny)
    whole = frequency.tfidf_terms(documents, "doc_id")
    split = frequency.tfidf_terms(documents, "doc_id", rows_per_split=3)
    assert whole.exceptAll(split).count() == 0
    assert whole.count() == split.count()


def test_mean_length(spark):
    rows = spark.createDataFrame([([1, 2],), ([1],), ([1, 2],)], "a array<int>")
    assert metrics.mean_sequence_length(rows, "a").first()["a"] == 1


@pytest.mark.parametrize("min_count", [1.0, 2.0, 0.3, 0.0])
def test_count_vectors_against_brute_force(spark, tmp_path, min_count):
    from pyspark.ml.functions import vector_to_array

    from termlens.operators.features import store_vectors

    terms = ["a", "", "b", "c"]
    dictionary = spark.createDataFrame([(t, n + 1) for n, t in enumerate(terms)], "term string, term_id int")
    arrays = [["a", "a", "x", "b"], [], ["x"], None, ["", "c", "c", "c"], ["a"] * 7 + ["b"] * 3]
    rows = spark.createDataFrame(list(enumerate(arrays)), "id int, tokens array<string>")

    def expected(tokens):
        tokens = tokens or []
        least = min_count if min_count >= 1 else min_count * len(tokens)
        return [float(tokens.count(t)) if tokens.count(t) >= least else 0.0 for t in terms]

    wanted = {n: expected(tokens) for n, tokens in enumerate(arrays)}
    in_place = vocabulary.count_vectors(rows, dictionary, min_count=min_count)
    joined = store_vectors(vocabulary.count_vectors_join(rows, dictionary, {"tokens": "counts"}, min_count), "counts", 4, str(tmp_path / "v"))
    for made in (in_place, joined):
        assert dict(made.select("id", vector_to_array("counts")).collect()) == wanted


def test_count_vectors_want_a_dictionary_without_gaps_of_a_checked_size(spark):
    rows = spark.createDataFrame([(1, ["a"])], "id int, tokens array<string>")
    gap = spark.createDataFrame([("a", 1), ("b", 3)], "term string, term_id int")
    with pytest.raises(ValueError, match="gaps"):
        vocabulary.count_vectors(rows, gap)
    with pytest.raises(ValueError, match="count_vectors_join"):
        vocabulary.count_vectors(rows, gap.where("term_id = 1"), most=0)
