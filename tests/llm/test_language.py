from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.llm import language as G

DOCS = "doc_id bigint, lang string, text string, score string"


def _symbols(text):
    out = [0, 0, 0]
    for char in text + "\n":
        s = ord(char.lower()[0]) if char.isalpha() else 0
        if s > 0xFFFF:
            out += [0xD800 + (s - 0x10000 >> 10), 0xDC00 + (s - 0x10000 & 0x3FF)]
        elif s or out[-1]:
            out.append(s)
    return out


def test_grams_are_those_of_each_text_alone():
    # the last ones hold letters beyond 16 bits, one of them with a lower case
    texts = ["Ab, cD!", "", "...", "é", "no  end", "a\nb", "\U00020000a", "x\U00010400 \U0002A6D6\U00020000"]
    packed, owner = G.grams(texts)
    expected = []
    for number, text in enumerate(texts):
        symbols = _symbols(text)
        expected += [(number, sum(symbols[i - b] << (16 * b) for b in range(4))) for i in range(3, len(symbols))]
    assert list(zip(owner.tolist(), packed.tolist())) == expected


def test_probabilities_equal_the_definition():
    chance = random.Random(1)
    texts = ["".join(chance.choices("ab cd", k=80)) for _ in range(6)]
    counts = Counter(G.grams(texts)[0].tolist())
    keys = np.array(sorted(counts), np.uint64)
    hashes = G.hashed(keys)
    order = np.argsort(hashes)
    assert len(set(hashes.tolist())) == len(keys)
    held = np.array([[counts[int(k)]] for k in keys[order]], float)
    model = G.CharacterModels(["x"], hashes[order], G.kneser_ney(keys[order], held))
    levels = [None, None, None, None, dict(counts)]
    for n in (3, 2, 1):
        below = defaultdict(int)
        for gram in levels[n + 1]:
            below[gram & ((1 << 16 * n) - 1)] += 1
        levels[n] = dict(below)

    def probability(gram, n):
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        gram &= (1 << 16 * n) - 1
        table = levels[n]
        once, twice = list(table.values()).count(1), list(table.values()).count(2)
        discount = once / (once + 2 * twice) if once else 0.5
        same = [v for g, v in table.items() if g >> 16 == gram >> 16]
        if not same:
            return probability(gram, n - 1)
        return max(table.get(gram, 0) - discount, 0) / sum(same) + discount * len(same) / sum(same) * probability(gram, n - 1)

    text = "abcd dcba aa bb" + "".join(chance.choices("abcd ", k=40))
    grams = G.grams([text])[0]
    entropy, lengths = model.entropies([text], model.index())
    assert lengths[0] == len(grams)
    assert entropy[0, 0] == pytest.approx(-sum(math.log(probability(int(g), 4)) for g in grams) / len(grams), rel=1e-5)


def test_held_out_accuracy(spark):
    chance = random.Random(3)
    sounds = {"x": ["ka", "to", "ri", "mé"], "y": ["shr", "unt", "ost", "el"], "z": ["ka", "ost", "ñi", "lu"]}
    rows = []
    for doc in range(400):
        lang = chance.choice("xyz")
        words = ["".join(chance.choices(sounds[lang], k=3)) for _ in range(chance.choice([3, 20, 200]))]
        rows.append((doc, lang, " ".join(words).title(), "s"))
    rows += [(1000, "x", None, None), (1001, None, "kato rimé kato", "s"), (1002, "x", "", "s"), (1003, "y", "12 !?", "s"), (None, "x", "kato rimé kato", "s"), (1004, "x", "Kato rimé " * 30_000, "s")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    model = G.train(docs.where(~G.held_out()))
    got = G.identify(docs.select("doc_id", "lang", "text", G.held_out().alias("held_out")), model, ["doc_id", "lang", "held_out"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1000, 1002, 1003}
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    later = [r.lang_pred == r.lang for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(later) > 60 and np.mean(later) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (1001, 1004)} == {"x"}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, None, "abc", "s")], DOCS)
    model = G.train(docs)
    assert [(r.lang_pred, r.score) for r in G.identify(docs, model).collect()] == [("und", 0.0)]
    assert G.identify(docs.limit(0), model).count() == 0
    one = G.train(spark.createDataFrame([(1, "a", "abc", "s")], DOCS))
    assert G.identify(docs, one).first().lang_pred == "a"


def test_every_gram_keeps_its_own_counts(spark):
    chance = random.Random(8)
    rows = [(doc, "xy"[doc % 2], "".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=5_000)), "s") for doc in range(40)]
    model = G.train(spark.createDataFrame(rows, DOCS).repartition(3))
    docs = spark.createDataFrame(rows, DOCS)
    counted = {r.doc_id for r in docs.where(~G._held_back(docs, G.CALIBRATION)).collect()}
    assert 0 < len(counted) < len(rows)
    expected = np.unique(G.grams([r[2] for r in rows if r[0] in counted])[0])
    assert len(set(G.hashed(expected).tolist())) < len(expected)
    assert np.array_equal(np.sort(model.levels[-1].keys), expected)
    for order in (1, 2, 3):
        assert np.array_equal(model.levels[order - 1].keys, np.unique(G._suffix(expected, order)))
    assert np.array_equal(model._rows(model.levels[-1].keys, model.index()), np.arange(len(expected)))
    unknown = np.array([1 << 50], np.uint64)
    assert model._rows(unknown, model.index()).tolist() == [-1]


def test_tables_give_the_results_of_arrays(spark):
    chance = random.Random(4)
    sounds = {"x": ["ka", "to", "ri", "mé"], "y": ["shr", "unt", "ost", "el"], "z": ["ka", "ost", "ñi", "lu"]}
    rows = []
    for doc in range(120):
        lang = chance.choice("xyz")
        rows.append((doc, lang, " ".join("".join(chance.choices(sounds[lang], k=3)) for _ in range(chance.choice([1, 3, 40]))), "s"))
    rows += [(200, "x", None, "s"), (201, None, "kato жук", "s"), (202, "y", "", "s"), (None, "z", "12", "s"), (5, rows[5][1], rows[5][2], "s")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    learned = docs.where("doc_id < 60")
    arrays, tables = G.train(learned), G.train(learned, sent=0)
    assert isinstance(arrays, G.CharacterModels) and isinstance(tables, G.TableModels)
    for one, other in zip(vars(arrays.calibration).values(), vars(tables.calibration).values()):
        assert other == pytest.approx(one, rel=1e-6)

    def found(model):
        got = G.identify(docs, model, ["doc_id", "lang"], with_margin=True).collect()
        return sorted((-1 if r.doc_id is None else r.doc_id, r.lang or "", r.lang_pred, r.rejected, r.margin, r.score) for r in got)

    one, other = found(arrays), found(tables)
    assert len(one) == len(rows) and [r[:4] for r in one] == [r[:4] for r in other]
    for column in (4, 5):
        assert [r[column] for r in one] == pytest.approx([r[column] for r in other], rel=1e-6, abs=1e-9)
    assert G.identify(docs.limit(0), tables).count() == 0


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_a_language_that_was_not_learned_is_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").repartition(4).cache()
    other = G.held_out()
    learned = docs.where(~other & (F.col("lang") != left_out))
    got = G.identify(docs.where("lang is not null"), G.train(learned), ["doc_id", "lang", "text"]).withColumn("held_out", other).collect()
    # junk without words has no language
    got = [r for r in got if r.text is not None and sum(c.isalpha() for c in r.text) >= 40]
    foreign = [r.rejected for r in got if r.lang == left_out]
    known = [r.rejected for r in got if r.lang != left_out and r.held_out]
    print(left_out, len(foreign), np.mean(foreign), len(known), np.mean(known))
    assert len(foreign) > 50 and np.mean(foreign) >= 0.95
    assert len(known) > 50 and np.mean(known) <= 0.02


def test_other_scripts_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = G.train(docs.where(~G.held_out()))
    texts = ["これは日本語の文章です。とても短いですが十分です。" * 3, "Это предложение на русском языке, и оно довольно длинное." * 2, "xkcd qwrt zzp brtk lmnp wqx vvb " * 5]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string")
    assert [r.rejected for r in G.identify(rows, model).orderBy("doc_id").collect()] == [True] * 3
