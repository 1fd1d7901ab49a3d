from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from termlens.operators import metrics, models
from termlens.plans import relevance, sequences
from termlens.sources import readers, retail, workspace, writers


def _ridge(x: np.ndarray, y: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """Closed form of the standardised L2 fit (sample deviations, centred)."""
    xs, ys = x.std(axis=0, ddof=1), y.std(ddof=1)
    xc, yc = (x - x.mean(axis=0)) / xs, (y - y.mean()) / ys
    n = len(y)
    w = np.linalg.solve(xc.T @ xc / n + reg / ys * np.eye(x.shape[1]), xc.T @ yc / n)
    slope = w * ys / xs
    return slope, y.mean() - slope @ x.mean(axis=0)


def test_search_solver_meets_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [1, 5, 0.1, 2]
    y = x @ [1.0, -0.2, 3.0, 0.0] + rng.normal(size=200)
    rows = spark.createDataFrame(
        [(float(t), Vectors.dense(r)) for t, r in zip(y, x, strict=True)], ["relevance", "features"]
    )
    unlabelled = rows.limit(5).withColumn("relevance", F.lit(None).cast("double"))
    settings = models.FitSettings(max_iter=200, reg_param=0.3)
    model = models.fit_linear(rows.unionByName(unlabelled), settings)
    slope, intercept = _ridge(x, y, 0.3)
    np.testing.assert_allclose(model.coefficients.toArray(), slope, rtol=1e-3)
    assert model.intercept == pytest.approx(intercept, rel=1e-3)
    listed = {r["index"]: r["coefficient"] for r in models.coefficients(spark, model).collect()}
    assert listed[1] == model.coefficients[1]


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0), (None, 9.0)], "relevance double, prediction double")
    got = metrics.regression_metrics(rows).first()
    assert got["n"] == 3
    assert got["rmse"] == pytest.approx(np.sqrt(1.25 / 3))
    assert got["mae"] == pytest.approx(0.5)
    assert got["r2"] == pytest.approx(1 - 1.25 / 2)
    assert sorted(r["residual"] for r in metrics.residuals(rows).dropna().collect()) == [-0.5, 0.0, 1.0]
    assert metrics.regression_metrics(rows.limit(0)).first()["rmse"] is None


@pytest.fixture(scope="module")
def vectors(spark, tiny):
    pairs = relevance.labelled(retail.pairs(spark, tiny))
    frame = relevance.bigram_vectors(pairs, retail.attributes(spark, tiny), buckets=500)
    return workspace.materialize(frame.select("id", "relevance", "split", "tf"), "test-vectors")


def test_fit_store_load_score(spark, tiny, vectors, tmp_path):
    fitted = relevance.fit_bigrams(vectors)
    assert fitted.train_rows == vectors.where("split = 'train'").count()
    assert fitted.skipped_rows == 0
    assert fitted.summary.iterations <= 20 and fitted.summary.n_features == 500
    history = fitted.summary.objective_history
    assert history[-1] <= history[0]
    path = str(tmp_path / "model")
    writers.save_model(fitted.model, path)
    report = relevance.evaluation_report(fitted.model, vectors)
    again = relevance.evaluation_report(readers.load_model(path), vectors)
    assert report.exceptAll(again).count() == 0
    assert report.count() == vectors.where("split = 'test'").count()
    measured = relevance.evaluate(fitted.model, vectors).first()
    assert 0 < measured["rmse"] < 1 and measured["mae"] <= measured["rmse"]
    one = models.fit_summary(spark, fitted.summary).first()
    assert one["rmse"] == pytest.approx(relevance.evaluate(fitted.model, vectors, "train").first()["rmse"])


def test_rows_without_a_label_are_counted(vectors):
    spoiled = vectors.withColumn(
        "relevance", F.when(F.col("id") % 10 != 3, F.col("relevance"))
    )
    fitted = relevance.fit_bigrams(spoiled)
    total = spoiled.where("split = 'train'").count()
    assert fitted.skipped_rows > 0 and fitted.train_rows + fitted.skipped_rows == total


def test_held_out_rows_do_not_change_the_weights(vectors):
    train_only = vectors.where("split = 'train'")
    assert (
        relevance.fit_bigrams(vectors).model.stages[0].idf
        == relevance.fit_bigrams(train_only).model.stages[0].idf
    )
    assert (
        relevance.fit_bigrams(vectors, idf_scope="all").model.stages[0].idf
        != relevance.fit_bigrams(train_only).model.stages[0].idf
    )


def test_new_pairs_get_the_scores_of_the_same_labelled_pairs(spark, tiny, vectors):
    fitted = relevance.fit_bigrams(vectors)
    new = relevance.bigram_vectors(
        retail.new_pairs(spark, tiny), retail.attributes(spark, tiny), buckets=500
    )
    scores = relevance.score_pairs(fitted.model, new)
    known = relevance.score_pairs(fitted.model, vectors).withColumnRenamed("prediction", "p")
    joined = scores.join(known, "id")
    assert joined.count() == scores.count() > 0
    assert joined.where(F.abs(F.col("p") - F.col("prediction")) > 1e-9).count() == 0


def test_classes(vectors):
    model = relevance.fit_relevance_classes(vectors)
    scored = relevance.score_classes(model, vectors)
    assert {r[0] for r in scored.select("predicted_value").distinct().collect()} <= {1.0, 1.5, 2.0, 2.5, 3.0}


def test_sequence_jobs(spark, tiny):
    pairs = relevance.labelled(retail.pairs(spark, tiny))
    terms = sequences.pair_vocabulary(pairs)
    rows = [tuple(r) for r in terms.orderBy("term_id").collect()]
    assert [r[3] for r in rows] == list(range(1, len(rows) + 1))
    # words of other letters only are cleaned to empty tokens: terms unless left out, and never encoded
    assert "" not in {r[0] for r in sequences.pair_vocabulary(pairs, drop_empty=True).collect()}
    empty = [r[3] for r in rows if r[0] == ""]
    encoded = sequences.encode_pairs(pairs, terms)
    used = encoded.select(F.explode(F.concat("int_title_tokens", "int_sterm_tokens"))).distinct().collect()
    assert empty and not {r[0] for r in used} & set(empty)
    padded = sequences.pad_pairs(sequences.encode_pairs(pairs, terms))
    sizes = padded.selectExpr("size(int_title_tokens)", "size(int_sterm_tokens)").distinct().collect()
    assert [tuple(r) for r in sizes] == [(15, 10)]
