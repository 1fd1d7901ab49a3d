"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades, with ordered thresholds:
P(grade > j) = logistic(w . x - t_j). A text's expected grade is the sum of these, and the
tail probability P(grade > j) selects texts. With the table of labels, grade 0 is toxic, grade 1
is clean of that but of low quality, grade 2 is good.

Features say what occurs, not how often, so one insult counts alike in a short and in a long text:
the words (A-Z in lower case, other bytes kept), and the text's shape in eighths: shares of
words in capitals, words that end in marks, lone marks, repeated words and distinct words.

The fit takes a documented, bounded sample: the ``SAMPLE`` labels of documents of the table whose ids have the
smallest hashes. Each sampled document is cut to its set of feature buckets, at most
``BUCKETS``. Features that do not tell grades apart in the sample beyond chance get no weight, so
that the many rare words of a long text cannot add up. Scoring looks at every word of every text.

Defined results: a null or empty text has no words; it has no features. A label of
a null doc_id is not used, nor one of a null quality unless it says toxic; a null toxic counts as 0. Rows that
repeat a doc_id are each scored; in the sample, rows that agree in id, grade and features count once. An empty table gives an empty one. Without any usable label, or with one grade
only, nothing can be told apart: nothing is rejected, and every tail is 1. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.batches import binary_column, pieces
from termlens.llm.decontaminate import split_words

SAMPLE = 20_000
BUCKETS = 1 << 18
#: Least documents with a feature, and least standard deviations between grades.
LEAST_DOCUMENTS = 4
LEAST_DEVIATIONS = 5.0
#: Texts are kept if P(grade > KEEP_ABOVE) is at least KEEP.
KEEP_ABOVE = 1
KEEP = 0.5


def features(text: bytes) -> np.ndarray:
    """The text's feature buckets, ascending."""
    raw = text.split()
    found = {b"=" + word for word in set(split_words(text))}
    count = len(raw) or 1
    shapes = {
        b"capitals": sum(map(bytes.isupper, raw)),
        b"marked": sum([word[-1:] in b"#$%&*!|" for word in raw]),
        b"lone": sum([len(word) == 1 and not word.isalnum() for word in raw]),
        b"again": sum([a == b for a, b in zip(raw, raw[1:])]),
        b"distinct": len(set(raw)),
    }
    # a share in eighths counts as all smaller ones too, so near shares look alike
    found.update(b"%s:%d" % (name, n) for name, number in shapes.items() for n in range(1, 8 * number // count + 1))
    return np.array(sorted({zlib.crc32(f) % BUCKETS for f in found}), np.int32)


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the buckets that count, and the ordered thresholds between grades."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -500, 500)))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[np.isin(self.buckets, row, assume_unique=True)].sum() for row in rows])


def fit(
    rows: list[np.ndarray], grades: np.ndarray, levels: int = 2, penalty: float = 0.3, steps: int = 400
) -> OrdinalModel:
    """Penalised maximum likelihood of the cumulative logit model of grades 0 to ``levels``.

    Thresholds are the first and the logarithms of the gaps to the next, so they stay in order.
    """
    if len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(0, np.int32), np.zeros(0), np.full(levels, -1000.0))
    lengths = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    with_it = np.bincount(flat, minlength=BUCKETS)
    apart = np.zeros(BUCKETS)
    for level in range(1, levels + 1):
        above = grades >= level
        share = above.mean()
        if 0 < share < 1:
            seen = np.bincount(flat, above[owner].astype(float), BUCKETS)
            spread = np.sqrt(np.maximum(with_it * share * (1 - share) * (1 - with_it / len(rows)), 1e-9))
            apart = np.maximum(apart, np.abs(seen - with_it * share) / spread)
    buckets = np.flatnonzero((with_it >= LEAST_DOCUMENTS) & (apart >= LEAST_DEVIATIONS)).astype(np.int32)
    place = np.full(BUCKETS, -1, np.int64)
    place[buckets] = np.arange(len(buckets))
    used = place[flat] >= 0
    column, owner = place[flat][used], owner[used]

    weights, cuts = np.zeros(len(buckets)), np.zeros(levels)
    shares = [np.clip((grades >= level).mean(), 0.01, 0.99) for level in range(1, levels + 1)]
    start = -np.log(np.array(shares) / (1 - np.array(shares)))
    cuts[0] = start[0]
    cuts[1:] = np.log(np.maximum(np.diff(start), 0.1))
    state = np.concatenate([weights, cuts])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        weights, cuts = state[: len(buckets)], state[len(buckets) :]
        thresholds = cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))])
        scores = np.bincount(owner, weights[column], len(rows))
        tail = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds, -500, 500)))
        tail = np.column_stack([np.ones(len(rows)), tail, np.zeros(len(rows))])
        slope = tail * (1 - tail)
        at = np.arange(len(rows))
        chance = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-12)
        by_score = (slope[at, grades] - slope[at, grades + 1]) / chance
        by_cut = np.zeros(levels)
        np.add.at(by_cut, grades[grades >= 1] - 1, -(slope[at, grades] / chance)[grades >= 1])
        np.add.at(by_cut, grades[grades < levels], (slope[at, grades + 1] / chance)[grades < levels])
        gradient = np.concatenate(
            [
                np.bincount(column, by_score[owner], len(buckets)) - penalty * weights,
                [by_cut.sum()],
                np.exp(cuts[1:]) * np.cumsum(by_cut[::-1])[::-1][1:],
            ]
        )
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = 0.1 * min(1.0, 4 * (1 - step / (steps + 1)))
        state = state + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights, cuts = state[: len(buckets)], state[len(buckets) :]
    return OrdinalModel(buckets, weights, cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))]))


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 toxic, whatever the quality, 1 of low quality, 2 good; null where neither is known."""
    known = F.when(F.col(quality).isNull(), None).when(F.col(quality) == 0, 1).otherwise(2)
    return F.when(F.coalesce(toxic, F.lit(0)) > 0, 0).otherwise(known)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature buckets and grades of at most ``most`` labelled documents, on the driver."""
    rated = labels.select(F.col("doc_id").alias("rated_id"), grade().alias("grade")).where("rated_id is not null and grade is not null")
    # labels of other documents must not use up the sample
    ids = documents.select("doc_id")
    usable = rated.distinct().join(ids, F.col("rated_id") == F.col("doc_id"), "left_semi")
    chosen = usable.withColumn("order", F.xxhash64("rated_id")).orderBy("order", "rated_id", "grade").limit(most)
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    # at most ``most`` rows of two numbers go to the documents
    sampled = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("rated_id")).select("doc_id", "grade", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            rows = [features(t).astype("<i4").tobytes() for t in binary_column(piece, "text")]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("grade"), pa.array(rows, pa.binary())], names=["doc_id", "grade", "buckets"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    # copies of a document count once, and however often an id stands, no more than ``most`` rows go to the driver
    distinct = sampled.mapInArrow(cut, f"doc_id {kind}, grade int, buckets binary").distinct()
    bounded = distinct.orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "buckets").limit(most)
    found = bounded.toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("buckets", "ascending")])
    rows = [np.frombuffer(b, "<i4") for b in found.column("buckets").to_pylist()]
    return rows, np.array(found.column("grade").to_pylist(), np.int64)


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> OrdinalModel:
    return fit(*labelled_sample(documents, labels, most))


def scored(documents: DataFrame, model: OrdinalModel, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), expected_grade, tail (P(grade > j) for each j), keep.

    The model has at most ``BUCKETS`` weights; it travels with the tasks.
    """
    kept = ["doc_id"] if keep is None else keep
    source = documents.select(*kept, F.col("text").cast("binary").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    sent = documents.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.thresholds))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = OrdinalModel(*sent.value)
        weight = np.zeros(BUCKETS)
        weight[held.buckets] = held.weights
        for piece in pieces(batches, "__text"):
            scores = np.array([weight[features(t)].sum() for t in binary_column(piece, "__text")])
            tails = held.tails(scores)
            columns = [piece.column(i) for i in range(piece.num_columns - 1)]
            columns += [pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names[:-1], "expected_grade", "tail"])

    rated = source.mapInArrow(rate, f"{fields}, expected_grade double, tail array<double>")
    return rated.withColumn("keep", F.get("tail", F.lit(KEEP_ABOVE)) >= KEEP)


def keep_good(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row")
    model = train(documents, labels, most)
    return scored(documents.select(row, "text"), model, ["__row"]).where("keep").select("__row.*")
