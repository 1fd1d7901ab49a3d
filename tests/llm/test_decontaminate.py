from __future__ import annotations

import hashlib
import random
import re

from termlens.llm import decontaminate as D

DOCS = "doc_id bigint, text string, n_words string"
ITEMS = "item_id bigint, text string"


def _brute(documents, items, width):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(text):
        return pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + width]), set()).add(item)
    rows = {}
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for length in {len(p) for p in wanted}:
            for i in range(len(w) - length + 1):
                if (p := tuple(w[i : i + length])) in wanted:
                    hit.update(range(i, i + length))
                    found |= {x for x in wanted[p] if x is not None}
        ids = ",".join(sorted(map(str, found)))
        rows[doc] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return rows


def _result(spark, documents, items, **more):
    docs = spark.createDataFrame([(*row, "x") for row in documents], DOCS)
    got = D.contamination(docs, spark.createDataFrame(items, ITEMS), **more)
    return {r[0]: tuple(r)[1:] for r in got.collect()}


def test_equals_brute_force(spark):
    chance = random.Random(5)
    vocabulary = ["the", "THE", "of", "é", "Éa", "b2", "x", "y"]
    items = [(i, " ".join(chance.choices(vocabulary, k=chance.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(30)]
    items += [(3, items[3][1]), (99, items[4][1]), (None, "only here and there"), (40, None), (41, ""), (42, "?!  ")]
    documents = []
    for doc in range(120):
        text = " - ".join(chance.choices(vocabulary, k=chance.randrange(60)))
        if doc % 3 == 0:
            text += ", " + chance.choice(items)[1].__str__().upper().replace(" ", "_") + ". tail"
        documents.append((doc, text))
    documents += [(200, None), (201, ""), (202, " \n "), (203, "only here and there"), (None, "only HERE and there"), (204, "w" * 100_000)]
    expected = _brute(documents, items, 13)
    assert _result(spark, documents, items) == expected
    # in several passes, as for an item set of any size
    assert _result(spark, documents, items, item_bytes=400) == expected


def test_empty_tables(spark):
    assert _result(spark, [], [(1, "a b")]) == {}
    assert _result(spark, [(1, "a b")], [])[1][:3] == (2, 0, 0)


def test_remove_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "a"), (2, "three", "b"), (None, None, None)], "doc_id bigint, text string, contaminated string")
    kept = D.remove_contaminated(docs, spark.createDataFrame([(1, "one two")], ITEMS))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(2, "three", "b"), (None, None, None)]


def test_equal_keys_of_other_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "crc32", lambda data: len(data) % 3)
    chance = random.Random(2)
    items = [(str(n), " ".join(chance.choices("abcde", k=chance.randrange(1, 9))).encode()) for n in range(40)]
    matcher = D.WuManber.of(items, 4)
    for _ in range(60):
        words = [w.encode() for w in chance.choices("abcde", k=20)]
        got = {(b, e, matcher.ids[o]) for b, e, owners in matcher.search(words) for o in owners}
        wanted = set()
        for item, text in items:
            own = text.split()
            length = min(4, len(own))
            for begin in range(len(own) - length + 1):
                wanted |= {(at, at + length, item) for at in range(21 - length) if words[at : at + length] == own[begin : begin + length]}
        assert got == wanted


def test_tables_of_a_large_item_set_are_small_and_quick():
    import pickle
    import time

    chance = random.Random(1)
    vocabulary = [f"w{n}" for n in range(5_000)]
    items = [(str(n), " ".join(chance.choices(vocabulary, k=400)).encode()) for n in range(1_000)]
    size = sum(len(t) for _, t in items)
    begin = time.process_time()
    matcher = D.WuManber.of(items, 13)
    assert time.process_time() - begin < 10 * size / 2**20
    assert len(pickle.dumps((matcher.words, matcher.ids, matcher.tables))) < 15 * size
    assert [o.tolist() for _, _, o in matcher.search(items[7][1].split())] == [[7]] * 388
