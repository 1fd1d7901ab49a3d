from __future__ import annotations

import hashlib
import random

import pytest

from termlens.llm import suffixes as X
from termlens.llm.suffix_index import SuffixIndex

DOCS = "doc_id bigint, text string, name string"


def _expected(earlier, batch):
    """Digests of a batch: strings of 50 bytes of earlier batches, or of smaller ids of its own, go."""
    before = {d[at : at + 50] for _, t, _ in earlier for d in [(t or "").encode()] for at in range(len(d) - 49)}
    first = {}
    for doc, text, _ in batch:
        data = (text or "").encode()
        for at in range(len(data) - 49):
            piece = data[at : at + 50]
            first[piece] = min(first.get(piece, doc), doc)
    for doc, text, _ in batch:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 49):
            piece = data[at : at + 50]
            if piece in before or first[piece] < doc:
                gone[at : at + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        yield doc, len(data), sum(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot_bytes", [X.HOT_BYTES, 2_000])
def test_batches_against_a_stored_index(spark, tmp_path, hot_bytes):
    chance = random.Random(9)

    def text(n):
        return " ".join(chance.choices(["the", "é", "of", "ab", "x"], k=n))

    passages = [text(40), text(30), "aaaa" * 40, "Dear customer, thank you for the order, "]
    batches = []
    for number in range(4):
        rows = []
        for doc in range(40):
            parts = [text(chance.randrange(25)) + str(chance.random())] + [chance.choice(passages) for _ in range(chance.randrange(3))]
            chance.shuffle(parts)
            # ids of a later batch may be smaller than earlier ones
            rows.append((doc * 7 + (3 - number) * 1000 + number, "".join(parts), "n"))
        if batches:
            # seen in one of the earlier batches only
            rows += [(9000 + n, chance.choice(chance.choice(batches))[1], "n") for n in range(8)]
        passages.append(text(35))
        batches.append(rows)
    batches[2] = []
    path = str(tmp_path / "index")
    SuffixIndex.create(spark, path, 40_000, chunk_bytes=2_500, bucket_bytes=6_000, hot_bytes=hot_bytes)
    earlier = []
    for number, rows in enumerate(batches, 1):
        # opened again, as by another job
        index = SuffixIndex.open(spark, path)
        assert index.state.batches == number - 1
        got = X.digest(index.add(spark.createDataFrame(rows, DOCS).repartition(3))).drop("n_spans").collect()
        assert sorted(map(tuple, got)) == sorted(_expected(earlier, rows))
        earlier += rows
    # levels are those of a binary counter: batches 1 to 4 are in one
    assert sorted(SuffixIndex.open(spark, path).state.levels) == ["2"]


def test_a_batch_that_failed_is_added_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index = SuffixIndex.create(spark, path, 10_000)
    one = [(1, "a common passage of more than fifty bytes, seen before in the first batch", "n")]
    two = [(2, "new text, then " + one[0][1], "n")]
    index.add(spark.createDataFrame(one, DOCS)).count()
    with monkeypatch.context() as patched:
        patched.setattr(X, "matched", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            SuffixIndex.open(spark, path).add(spark.createDataFrame(two, DOCS))
    got = X.digest(SuffixIndex.open(spark, path).add(spark.createDataFrame(two, DOCS))).drop("n_spans").collect()
    assert [tuple(r) for r in got] == list(_expected(one, two))
