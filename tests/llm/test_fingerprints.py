from __future__ import annotations

import hashlib
import random

import numpy as np

from termlens.llm import fingerprints as P

DOCS = "doc_id bigint, text string, part string"


def _shingles(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_hashes_stand_for_shingles():
    chance = random.Random(2)
    texts = [" ".join(chance.choices(["a", "b", "Bb", "é", "aa"], k=n)) for n in range(60)] + ["", " \n ", "A  b\tC d\ne f", "x " * 5000]
    for text in texts:
        assert len(np.unique(P.shingle_hashes(text.encode()))) == len(_shingles(text))
    both = [(a, b) for a in texts for b in texts]
    for a, b in both:
        shared = np.intersect1d(P.shingle_hashes(a.encode()), P.shingle_hashes(b.encode()))
        assert len(shared) == len(_shingles(a) & _shingles(b))


def test_estimates():
    words = [f"w{i}" for i in range(6000)]
    one, other = " ".join(words[:4000]).encode(), " ".join(words[2000:]).encode()
    a, b = P.sketch(one), P.sketch(other)
    true = len(_shingles(one.decode()) & _shingles(other.decode())) / len(_shingles(one.decode()) | _shingles(other.decode()))
    assert abs(P.resemblance(a, b) - true) < 0.13
    assert abs(P.distinct_shingles(a) - 3996) < 0.3 * 3996
    assert abs(P.containment(a, b) - 0.5) < 0.2
    assert np.array_equal(P.merged(a, b), np.unique(np.r_[P.shingle_hashes(one), P.shingle_hashes(other)])[: P.SIZE])
    assert np.array_equal(P.from_text(P.to_text(a)), a)
    # small texts are held in full, so estimates are exact
    assert P.resemblance(P.sketch(b"a b c d e f"), P.sketch(b"a b c d e g")) == 1 / 3
    assert P.resemblance(P.sketch(b""), P.sketch(b"")) == 1 and P.resemblance(P.sketch(b""), P.sketch(b"a")) == 0
    assert P.containment(P.sketch(b""), a) == 1


def _brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc, text, _), (_, following, _) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        f, g, h = (P.sketch(t.encode()) for t in (text, changed, following))
        yield (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), P.to_text(f), P.to_text(g), P.resemblance(f, g), P.resemblance(f, h))


def test_equals_brute_force(spark):
    chance = random.Random(4)
    rows = [(i * i, " ".join(chance.choices(["a", "é", "😀", "DD"], k=chance.randrange(40))), "p") for i in range(300)]
    rows += [(10**17 + i, t, None) for i, t in enumerate([None, "", " ", "one", "😀" * 60_001, None])] + [(None, "no id", "p")]
    chance.shuffle(rows)
    frame = spark.createDataFrame(rows, DOCS).repartition(7)
    got = P.fingerprints_with_edits(frame)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(_brute(rows), key=str)


def test_few_rows_and_repeats(spark):
    frame = spark.createDataFrame([(1, "a b c d", "p")], DOCS)
    assert [tuple(r)[1:3] for r in P.fingerprints_with_edits(frame).collect()] == [(7, hashlib.sha256(b"a b a b").hexdigest())]
    assert P.fingerprints_with_edits(frame.limit(0)).count() == 0
    many = frame.union(frame).union(spark.createDataFrame([(None, "x", "p"), (None, None, "p"), (None, "x", "p")], DOCS))
    assert P.fingerprints_with_edits(many).count() == 5
    sketches = P.document_sketches(many).collect()
    assert len(sketches) == 5 and len({r.fingerprint for r in sketches if r.doc_id == 1}) == 1


def test_an_id_with_a_third_of_all_rows_is_spread(spark):
    import xxhash

    chance = random.Random(6)
    rows = [(i % 900 if i % 3 else 77, f"text {i} " + " ".join(chance.choices("abc", k=9)), "p") for i in range(2_700)]
    rows += [(None, f"none {i}", "p") for i in range(600)]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)

    def tie(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - 2**64 if h >> 63 else h

    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    expected = sorted(
        (doc, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest())
        for (doc, t, _), (_, n, _) in zip(ordered, ordered[1:] + ordered[:1])
        if doc is not None
    )
    got = P.fingerprints_with_edits(frame).where("doc_id is not null").select("doc_id", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == expected
    parts = P._dealt_in_order(frame).groupBy("part").count().collect()
    assert max(p["count"] for p in parts) < 500


def test_windows_do_not_change_sketches(monkeypatch):
    from termlens.llm import shingles

    chance = random.Random(2)
    for size in range(0, 80, 4):
        text = "".join(chance.choice(["ab", "C", " ", "\n", "é"]) for _ in range(size)).encode()
        whole = P.sketch(text)
        assert np.array_equal(whole, np.unique(P.shingle_hashes(text))[: P.SIZE])
        monkeypatch.setattr(shingles, "WINDOW", chance.randrange(1, 12))
        assert np.array_equal(P.sketch(text), whole)
        monkeypatch.undo()
