from __future__ import annotations

import hashlib
import random
from itertools import groupby

import numpy as np
import pytest

from termlens.llm import suffixes as X

DOCS = "doc_id bigint, text string, name string"


def _brute(rows):
    first = {}
    for doc, text, _ in rows:
        data = (text or "").encode()
        for at in range(len(data) - 49):
            piece = data[at : at + 50]
            first[piece] = min(first.get(piece, 2**63 - 1), 2**63 - 1 if doc is None else doc)
    out = []
    for doc, text, _ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 49):
            if first[data[at : at + 50]] < (2**63 - 1 if doc is None else doc):
                gone[at : at + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), sum(1 for g, _ in groupby(gone) if g), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_rolling_hash_and_packing():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    for width in (1, 2, 24, 50, 299, 300):
        hashes = X.rolling(data, width)
        assert len(hashes) == len(data) - width + 1
        assert hashes[0] == X.rolling(data[:width], width)[0] and hashes[-1] == X.rolling(data[-width:], width)[0]
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 1000).astype(np.uint64))
    assert np.array_equal(X.unpack(X.pack(keys)), keys)


def test_equal_strings_have_the_same_sample():
    chance = random.Random(5)
    middle = "".join(chance.choices("ab", k=400)).encode()
    texts = [chance.randbytes(n) + middle + chance.randbytes(70) for n in (0, 13, 200)]
    marks = []
    for _, joined, owner, at, count, keys in X.sampled(texts):
        marks.append({joined[b + i : b + i + 50]: k for b, c, k in zip(at.tolist(), count.tolist(), keys.tolist()) for i in range(c)})
    found = marks[0]
    for _, joined, owner, at, count, keys in X.sampled(texts[::-1]):
        for b, c, k in zip(at.tolist(), count.tolist(), keys.tolist()):
            for i in range(c):
                assert found[joined[b + i : b + i + 50]] == k


@pytest.mark.parametrize("sizes", [{}, {"batches": 5, "chunk_bytes": 3_000, "bucket_bytes": 4_000}])
def test_equals_brute_force(spark, sizes):
    chance = random.Random(7)
    words = ["the", "é", "of", "ab", "x"]

    def text(n):
        return " ".join(chance.choices(words, k=n))

    passages = [text(40), text(25), "aaaa" * 40, "é" * 60, "z" * 50, "q" * 49]
    rows = []
    for doc in range(150):
        parts = [text(chance.randrange(30)) + str(chance.random())] + [chance.choice(passages) for _ in range(chance.randrange(3))]
        if chance.random() < 0.2:
            parts.append(chance.choice(passages)[chance.randrange(5) : 90])
        chance.shuffle(parts)
        rows.append((doc * 3, "".join(parts), "n"))
    rows += [(1000 + i, rows[i % 7][1], "n") for i in range(30)]
    rows += [(2000, None, None), (2001, "", "n"), (2002, "y" * 49, "n"), (2003, "y" * 49, "n"), (2004, "w" * 3000, "n"), (2005, "w" * 60, "n")]
    rows += [(None, passages[0] + "null id", "n"), (None, "only here " * 9, "n"), (None, "only here " * 9 + "!", "n"), (30, rows[40][1], "n"), (30, "twice " * 20, "n"), (30, "twice " * 20 + ".", "n")]
    chance.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(map(tuple, X.digest(X.duplicated_spans(docs, **sizes)).collect()), key=str) == _brute(rows)


def test_empty_table(spark):
    spark.range(1).write.saveAsTable("termlens_chunks_of_another")
    assert X.duplicated_spans(spark.createDataFrame([], DOCS)).count() == 0
    X.drop_chunks(spark)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("termlens_chunks_")] == ["termlens_chunks_of_another"]
    spark.sql("DROP TABLE termlens_chunks_of_another")


def test_same_hash_of_different_strings(monkeypatch):
    monkeypatch.setattr(X, "rolling", lambda data, width: np.zeros(len(data) - width + 1, np.uint64))
    strings = [b"a" * 50, b"b" * 50, b"b" * 50, b"c" * 51]
    masks = X.covered_places(np.array([50, 50, 50, 51], np.uint8), np.array([1, 2, 3, 4]), b"".join(strings))
    assert masks.tolist() == [0, 0, 1, 0]


@pytest.mark.parametrize("hot_bytes", [0, 3_000, 20_000])
def test_frequent_seeds_in_changing_surroundings(spark, monkeypatch, hot_bytes):
    chance = random.Random(11)
    phrase = "Dear customer, thank you for the order"
    rows = []
    for doc in range(300):
        name = chance.choice(["Ann from Leipzig, paid on ", "Bob from Hamburg, paid on "]) + "".join(chance.choices("0123456789", k=chance.choice([1, 8])))
        rows.append((doc if doc % 50 else None, "".join(chance.choices("abc", k=60)) + phrase + name + "".join(chance.choices("xyz", k=40)), ""))
    rows += [(r[0] and r[0] + 1000, r[1][10:], "") for r in rows[:40]]
    held = []

    def watched(sent):
        held.extend(len(r.strings) for r in sent.select("strings").collect())
        return answer(sent)

    answer = X.answer
    monkeypatch.setattr(X, "answer", watched)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = X.digest(X.duplicated_spans(docs, batches=3, chunk_bytes=6_000, bucket_bytes=1 << 20, hot_bytes=hot_bytes)).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)
    assert bool(held) == (hot_bytes > 0)


def test_strings_of_a_seed_stay_within_the_bound(spark, monkeypatch):
    chance = random.Random(12)
    rows = [(doc, "".join(chance.choices("abcdefgh", k=60)) + "Z" * 26 + "".join(chance.choices("abcdefgh", k=60)), "") for doc in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    answer, held = X.answer, {}

    def watched(sent):
        held.clear()
        for row in sent.collect():
            at = 0
            for size in row.sizes:
                string = bytes(row.strings[at : at + size])
                at += size
                key = int(next(X.sampled([string]))[-1][0])
                held[key] = held.get(key, 0) + size
        return answer(sent)

    monkeypatch.setattr(X, "answer", watched)
    for hot_bytes in (1 << 30, 1_000):
        got = X.digest(X.duplicated_spans(docs, chunk_bytes=20_000, bucket_bytes=1 << 20, hot_bytes=hot_bytes)).collect()
        assert sorted(map(tuple, got), key=str) == _brute(rows)
        assert (max(held.values()) > 1_000) == (hot_bytes > 1_000)


def test_a_very_long_text(spark):
    chance = random.Random(3)
    long = " ".join(f"word{chance.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, long, ""), (2, "head " + long[1_000_000:1_000_200] + " tail", ""), (3, long[:40] + "#" + long[-70:], "")]
    got = {r.doc_id: r.n_removed for r in X.digest(X.duplicated_spans(spark.createDataFrame(rows, DOCS))).collect()}
    assert got == {1: 0, 2: 200, 3: 70}
