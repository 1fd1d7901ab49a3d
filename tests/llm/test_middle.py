from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.llm import middle as M

DOCS = "doc_id bigint, text string, source string"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
PIECES = ["a", "é", "<", "S", ">", "P", " ", "\n", "\t", "漢", "😀", "\x85", "　", "b", "word"]


def _expected(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(part) for part in (tokens[:first], tokens[first:second], tokens[second:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc, n, "plain", None, None, text, text
    if h[3] % 100 < 80:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def _texts(chance, count):
    for _ in range(count):
        marks = ["<S>", "<M>", "<P>"] if chance.random() < 0.1 else []
        yield "".join(chance.choice(PIECES + marks) for _ in range(chance.randrange(14)))


@pytest.mark.parametrize("window", [1, 7, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(M, "WINDOW", window)
    chance = random.Random(window)
    rows = [(chance.randrange(10**9), t) for t in _texts(chance, 400)]
    rows += [(1, None), (2, ""), (None, "null id " * 5), (3, " "), (3, "same id " * 9), (3, "same id " * 9), (-4, "below zero. " * 3)]
    table = spark.createDataFrame([(*r, "x") for r in rows], DOCS).withColumns({"n": F.lit("clash"), "form": F.lit(1)}).repartition(3)
    got = M.restore(M.fill_in_middle(table))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    made = sorted(map(tuple, got.collect()), key=str)
    assert made == sorted((_expected(*r) for r in rows), key=str)
    assert {r[2] for r in made} == {"plain", "psm", "spm"}
    hashes = sorted((r.output_sha256, r.restored_sha256) for r in M.digest(M.fill_in_middle(table)).collect())
    assert hashes == sorted((hashlib.sha256(r[5].encode()).hexdigest(), hashlib.sha256(r[6].encode()).hexdigest()) for r in made)


def test_scatter_and_gather_are_inverse(monkeypatch):
    monkeypatch.setattr(M, "WINDOW", 5)
    data = np.arange(20, dtype=np.uint8)
    # three segments and an empty one change places
    starts, targets = np.array([0, 4, 4, 11]), np.array([16, 0, 0, 7])
    moved = M.scatter(data, starts, targets - starts, 20)
    assert moved.tolist() == [*range(4, 11), *range(11, 20), *range(0, 4)]
    back = M.gather(moved, starts, targets - starts, 20)
    assert back.tolist() == data.tolist()


def test_empty_table_and_very_long_text(spark):
    assert M.digest(M.fill_in_middle(spark.createDataFrame([], DOCS))).count() == 0
    doc = next(d for d in range(100) if _expected(d, "a b")[2] == "psm")
    text = "long ö word " * 600_000
    (row,) = M.restore(M.fill_in_middle(spark.createDataFrame([(doc, text, "x")], DOCS), keep=["source"])).collect()
    assert (row.doc_id, row.n, row.form, row.prefix_chars, row.middle_chars, row.output, row.restored) == _expected(doc, text)
    assert row.source == "x"
