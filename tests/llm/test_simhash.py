from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termlens.llm import components as C
from termlens.llm import simhash as S

DOCS = "doc_id bigint, text string, fingerprint string"


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def _print(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_groups_serve_every_set_of_positions():
    groups = [set(g) for g in S.position_groups()]
    assert all(any(set(s) >= g for g in groups) for s in combinations(range(8), 5))


def test_hash_is_the_engines(spark):
    row = spark.createDataFrame([("é one two",)], "t string").select(F.hex(F.xxhash64("t"))).first()[0]
    assert int(row, 16) == xxhash.xxh64_intdigest("é one two".encode(), 42)


@pytest.mark.parametrize("scan", [10_000, 0])
def test_links_of_a_list(scan):
    chance = random.Random(3)
    for most_bits in (1, 2) if scan == 0 else (1, 2, 3):
        free = [b for b in range(64) if b // 8 not in (0, 1, 2, 3)]
        held = sorted({sum(1 << b for b in chance.sample(free[:10], chance.randrange(8))) for _ in range(60)})
        links = list(S.list_links(np.array(held, np.uint64), (0, 1, 2, 3), most_bits, scan))
        true = [(a, b) for a, b in combinations(held, 2) if (a ^ b).bit_count() <= most_bits]
        assert len(links) < len(held)
        assert _components(held, links) == _components(held, true)


def test_equals_brute_force(spark):
    chance = random.Random(11)
    words = [f"W{i}" for i in range(300)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (None, "lonely and without id"), (1005, "x " * 30_000)]
    for base in range(60):
        text = chance.choices(words, k=200)
        rows.append((10 * base, " ".join(text)))
        for copy in range(1, chance.randrange(1, 7)):
            text[chance.randrange(200)] = chance.choice(words)
            rows.append((10 * base + copy, "\t".join(text)))
    chance.shuffle(rows)
    prints = [_print(t) for _, t in rows]
    nodes = set(prints)
    groups = _components(nodes, [(a, b) for a, b in combinations(nodes, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[groups[p]] = min(doc, least.get(groups[p], doc))
    expected = sorted(((d, f"{p:016x}", least.get(groups[p])) for (d, _), p in zip(rows, prints)), key=str)
    assert len(set(groups.values())) < len(nodes)
    docs = spark.createDataFrame([(*r, "c") for r in rows], DOCS).repartition(6)
    assert sorted(map(tuple, S.near_duplicates(docs).collect()), key=str) == expected
    kept = S.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted({r[2] for r in expected}, key=str)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "A b c d", "y"), (None, None, None), (None, None, None)], DOCS)
    assert sorted((r[0], r[2]) for r in S.near_duplicates(docs).where("doc_id is not null").collect()) == [(1, 1), (1, 1), (2, 1)]
    assert sorted(map(tuple, S.one_of_each_group(docs).collect()), key=str) == [(1, "a b c d", "x"), (None, None, None)]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5)], "a bigint, b bigint").repartition(4)
    got = dict(map(tuple, C.components(edges).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
