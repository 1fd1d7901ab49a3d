from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.llm import minhash as M
from termlens.llm import shingles

DOCS = "doc_id bigint, text string, n bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")


def _set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def _expected(rows, percent=80):
    sets = [_set(t) for _, t in rows]
    holders = {}
    for s in sets:
        holders.setdefault(s, s)
    distinct = [s for s in holders if s]
    parent = {s: s for s in distinct}

    def top(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for one, two in combinations(distinct, 2):
        both = len(one & two)
        if 100 * both >= percent * len(one | two):
            parent[top(two)] = top(one)
    least = {}
    for (doc, _), s in zip(rows, sets):
        if s and doc is not None:
            least[top(s)] = min(doc, least.get(top(s), doc))
    result = []
    for (doc, _), s in zip(rows, sets):
        component = least.get(top(s)) if s else doc
        result.append((doc, len(s), component, doc == component))
    return sorted(result, key=str)


def _corpus(chance):
    words = [f"W{i}" for i in range(400)] + ["é", "Ä", "x y"]
    rows = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "one two three"), (9007, ""), (None, "no id here at all")]
    for base in range(40):
        text = chance.choices(words, k=chance.choice([6, 60, 200]))
        rows.append((100 * base, " ".join(text)))
        for copy in range(1, chance.randrange(1, 9)):
            edited = list(text)
            for _ in range(chance.randrange(0, 5)):
                edited[chance.randrange(len(edited))] = chance.choice(words)
            rows.append((100 * base + copy, chance.choice([" ", "\t"]).join(edited)))
    # a chain of small changes: its ends are not alike
    text = chance.choices(words, k=300)
    for step in range(15):
        text = text[6:] + chance.choices(words, k=6)
        rows.append((8000 + step, " ".join(text)))
    # a passage that many documents share, below the similarity
    passage = chance.choices(words, k=150)
    rows += [(7000 + k, " ".join(passage + chance.choices(words, k=60))) for k in range(60)]
    # many copies around one text, some alike only through it
    centre = chance.choices(words, k=200)
    for copy in range(80):
        edited = list(centre)
        for _ in range(3):
            edited[chance.randrange(200)] = chance.choice(words)
        rows.append((6000 + copy, " ".join(edited)))
    rows += [(6500, " ".join(centre)), (6500, " ".join(centre)), (None, " ".join(centre))]
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, pairs", [(4_096, 64), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "REGION_BLOCK", block)
    monkeypatch.setattr(M, "PAIRS_PER_TASK", pairs)
    rows = _corpus(random.Random(23))
    expected = _expected(rows)
    assert 100 < sum(r[3] for r in expected) < len(expected) - 100
    table = spark.createDataFrame([(*r, 1) for r in rows], DOCS).withColumns({"node": F.lit("x"), "text_md5": F.lit(2)}).repartition(7)
    assert sorted(map(tuple, M.near_duplicates(table).collect()), key=str) == expected


def test_windows_do_not_change_sets(monkeypatch):
    chance = random.Random(2)
    for size in range(0, 60, 3):
        text = "".join(chance.choice(["ab", "C", " ", "\n", "é"]) for _ in range(size)).encode()
        whole = M.shingle_set(text)
        monkeypatch.setattr(shingles, "WINDOW", chance.randrange(1, 12))
        assert np.array_equal(M.shingle_set(text), whole)
        assert len(whole) == len(_set(text.decode()))
        monkeypatch.undo()


def test_signatures_estimate_similarity():
    chance = np.random.default_rng(1)
    for shared in (50, 400, 900):
        pool = chance.integers(0, 2**63, 2_000 - shared).astype(np.uint64)
        one, two = pool[:1_000], pool[1_000 - shared :]
        agreed = (M.signature(one) == M.signature(two)).mean()
        assert abs(agreed - shared / (2_000 - shared)) < 0.13


def test_a_forest_joins_what_links_join():
    chance = np.random.default_rng(5)
    base = chance.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k : k + 200 + 3 * (k % 9)], base[:5]])) for k in range(0, 90, 3)]
    size = len(sets)
    columns = {"node": np.arange(size) * 10, "side": np.zeros(size, int), "n": np.array([len(s) for s in sets]), "component": np.arange(size)}
    minima = np.stack([M.signature(s) for s in sets])
    forest = list(M.NodeList(True, columns, minima, sets, 80).forest())
    links = [(a, b) for a, b in combinations(range(size), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert 0 < len(forest) < size <= len(links)
    label = list(range(size))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    assert len(forest) == size - len(set(label))
    assert all(label[a // 10] == label[b // 10] for a, b in forest)


def test_blocks_meet_every_pair_across_components(spark):
    rows = [(1, n, 0 if n < 25 else n) for n in range(40)] + [(2, n, n % 2) for n in range(4)] + [(3, 5, 5), (3, 6, 5)]
    members = spark.createDataFrame(rows, "bucket bigint, node bigint, component bigint")
    lists = {}
    for r in M._lists(members, M._several(members), 4).collect():
        lists.setdefault((r.bucket, r.i, r.j), []).append((r.side, r.node))
    met = set()
    for (bucket, i, j), held in lists.items():
        sides = [[n for s, n in held if s == side] for side in (0, 1)]
        met |= {(bucket, *sorted(p)) for p in (combinations(sides[0], 2) if i == j else ((a, b) for a in sides[0] for b in sides[1]))}
        assert len(held) <= 40
    wanted = {(b, m, n) for b, m, c in rows for b2, n, c2 in rows if b == b2 and m < n and c != c2}
    assert wanted <= met
    assert not any(b == 1 and m < 25 and n < 25 for b, m, n in met)


def test_empty_table_and_very_long_text(spark):
    empty = spark.createDataFrame([], DOCS)
    assert M.near_duplicates(empty).collect() == []
    words = [f"w{i}" for i in range(200_000)]
    rows = [(5, " ".join(words), 0), (6, " ".join(words[:-9] + ["z"]), 0), (7, "x " * 500_000, 0), (8, "X  " * 4, 0)]
    got = sorted(map(tuple, M.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [(5, 199_997, 5, True), (6, 199_989, 5, False), (7, 1, 7, True), (8, 1, 7, False)]


def test_a_forest_of_agreeing_pairs_spans_every_node(spark):
    """Two linked nodes both agree with a third, which is a link of the second one only: that pair must reach the exact search."""
    same = np.zeros((3, M.MINIMA), np.uint16)
    columns = {"node": np.array([10, 11, 12]), "side": np.zeros(3, int), "n": np.full(3, 100), "component": np.array([10, 10, 12])}
    forest = list(M.NodeList(True, columns, same, None, 80).forest())
    assert {n for pair in forest for n in pair} == {10, 11, 12}
    # sets: 0 and 1 are alike, 2 is like 1 and not like 0; all signatures agree
    hashes = [np.arange(0, 100, dtype=np.uint64), np.arange(6, 106, dtype=np.uint64), np.arange(15, 115, dtype=np.uint64)]
    columns = {"node": np.array([10, 11, 12]), "side": np.zeros(3, int), "n": np.full(3, 100), "component": np.array([10, 10, 12])}
    assert list(M.NodeList(True, columns, same, hashes, 80).forest()) == [(11, 12)]


def test_links_of_nodes_beside_an_agreeing_one_are_kept(spark):
    """The like of a component's second node is found, though its first node only agrees with it."""
    chance = random.Random(7)
    rows = []
    for base in range(120):
        text = [f"b{base}w{i}" for i in range(300)]
        # windows that move by a sixteenth: neighbours are alike, the others agree but are not
        for step in range(3):
            rows.append((10 * base + step, " ".join(text[step * 15 + chance.randrange(10) :][:225])))
    chance.shuffle(rows)
    table = spark.createDataFrame([(*r, 1) for r in rows], DOCS).repartition(5)
    assert sorted(map(tuple, M.near_duplicates(table).collect()), key=str) == _expected(rows)
