from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from termlens.llm import quality as Q

DOCS = "doc_id bigint, text string, tail string, keep string"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def _corpus(chance, count):
    words = [f"word{chance.choice('abcdefgh')}{i}" for i in range(400)]
    rows, labels = [], []
    for doc in range(count):
        grade, size = chance.choice([0, 1, 2, 2, 2, 2]), chance.choice([3, 40, 40, 3000])
        text = chance.choices(words, k=size)
        if grade == 1:
            text = [w + "%%%" for w in text]
        if grade == 0:
            text.insert(chance.randrange(size), chance.choice(["Insult.", "slur,"]))
        rows.append((doc, " ".join(text), "t", "g"))
        labels.append((doc, int(grade != 1), int(grade == 0), "l"))
    return rows, labels


def test_features():
    assert len(Q.features(b"")) == len(Q.features(b" \n")) == 0
    assert set(Q.features(b"a b c d")) < set(Q.features(b"a b c D#"))
    row = Q.features("Ein Wort, ein Wort".encode())
    assert np.array_equal(row, np.unique(row)) and row.max() < Q.BUCKETS


def test_held_out_accuracy_and_all_rows(spark):
    rows, labels = _corpus(random.Random(1), 1200)
    rows += [(None, "no id", "t", "g"), (9000, None, None, None), (9001, "", "t", "g"), (5, "twice", "t", "g"), (9002, "x" * 200_000, "t", "g")]
    known = [r for r in labels if r[0] < 700] + [(None, 1, 0, "l"), (3, None, 1, "l"), (8, 1, None, "l")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    model = Q.train(docs, spark.createDataFrame(known, LABELS))
    assert np.all(np.diff(model.thresholds) > 0)
    got = Q.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.expected_grade <= 2 and r.tail[0] >= r.tail[1] for r in got)
    truth = {r[0]: r[1] == 1 and r[2] == 0 for r in labels}
    later = [(r.keep, truth[r.doc_id]) for r in got if r.doc_id is not None and 700 <= r.doc_id < 1200]
    assert np.mean([g for g, t in later if t]) > 0.98 and np.mean([not g for g, t in later if not t]) > 0.98
    kept = Q.keep_good(docs, spark.createDataFrame(known, LABELS))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    assert Q.scored(docs.limit(0), model).count() == 0


def test_gradient_leads_to_the_maximum():
    rows, grades = [np.array([1], np.int32)] * 60 + [np.array([2], np.int32)] * 60, np.array([2] * 50 + [1] * 10 + [0] * 40 + [1] * 20)
    model = Q.fit(rows, grades, penalty=0.5, steps=800)

    def loss(state):
        weights, cuts = state[: len(model.buckets)], np.array([state[-2], state[-2] + state[-1]])
        tail = np.column_stack([np.ones(120), 1 / (1 + np.exp(-(weights[np.searchsorted(model.buckets, [r[0] for r in rows])][:, None] - cuts))), np.zeros(120)])
        at = np.arange(120)
        return -np.log(tail[at, grades] - tail[at, grades + 1]).sum() + 0.25 * (weights**2).sum()

    best = np.r_[model.weights, model.thresholds[0], np.diff(model.thresholds)]
    for place in range(len(best)):
        for step in (-0.05, 0.05):
            moved = best.copy()
            moved[place] += step
            assert loss(moved) > loss(best) - 1e-3


def test_without_two_grades_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "Insult.", "t", "g"), (None, None, None, None)], DOCS)
    for labels in ([], [(1, 1, 0, "l")], [(7, 0, 0, "l")]):
        frame = spark.createDataFrame(labels, LABELS)
        assert sorted(map(tuple, Q.keep_good(docs, frame).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert Q.keep_good(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    # one of the grades may be missing
    model = Q.fit([np.array([1], np.int32)] * 40 + [np.array([2], np.int32)] * 40, np.array([0] * 40 + [1] * 40))
    assert len(model.thresholds) == 2


def test_labels_of_other_documents_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(n, f"word{n % 7} text {n}") for n in range(200)], "doc_id bigint, text string")
    own = spark.createDataFrame([(n, n % 2, 0) for n in range(200)], "doc_id bigint, quality int, toxic int")
    foreign = spark.range(10_000, 400_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    few = Q.labelled_sample(docs, own.unionByName(foreign), 150)
    assert len(few[0]) == 150 and [list(r) for r in few[0]] == [list(r) for r in Q.labelled_sample(docs, own, 150)[0]]


def test_repeated_ids_are_bounded_and_toxic_needs_no_quality(spark):
    docs = spark.createDataFrame([(1, f"text {n}") for n in range(500)] + [(2, "same words")] * 300 + [(3, "vile")], "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, 1, None), (2, 0, 0), (3, None, 1), (4, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows, grades = Q.labelled_sample(docs, marks, 50)
    assert len(rows) <= 50
    rows, grades = Q.labelled_sample(docs, marks, 10_000)
    assert sorted(set(grades.tolist())) == [0, 1, 2] and (grades == 1).sum() == 1 and (grades == 0).sum() == 1


def _plain_features(text):
    """The features by their definition, one by one."""
    import re
    import zlib

    data = (text or "").encode()
    raw = [w for w in re.split(rb"[ \t\n\v\f\r]+", data) if w]
    names = {b"=" + bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)}
    count = len(raw) or 1
    letters = [bytes(b for b in w if 65 <= b <= 90 or 97 <= b <= 122) for w in raw]
    shares = {
        b"capitals": sum(bool(le) and all(b <= 90 for b in le) for le in letters),
        b"marked": sum(w[-1:] in (b"#", b"$", b"%", b"&", b"*", b"!", b"|") for w in raw),
        b"lone": sum(len(w) == 1 and not (w.isalpha() or w.isdigit()) for w in raw),
        b"again": sum(raw[i] == raw[i - 1] for i in range(1, len(raw))),
        b"distinct": len(set(raw)),
    }
    for name, number in shares.items():
        for eighth in range(1, 9):
            if 8 * number >= eighth * count:
                names.add(name + b":" + str(eighth).encode())
    return {zlib.crc32(n) % Q.BUCKETS for n in names}


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.train(docs, labels)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = Q.scored(docs, model).collect()
    assert len(rows) == len(texts)
    for row in rows:
        score = sum(weight.get(f, 0.0) for f in _plain_features(texts[row.doc_id]))
        tail = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        assert np.allclose(row.tail, tail, atol=1e-9) and abs(row.expected_grade - sum(tail)) < 1e-9
        assert row.keep == (tail[1] >= 0.5)
