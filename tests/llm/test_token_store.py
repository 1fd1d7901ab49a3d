from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from termlens.llm import token_store as T
from termlens.sources.workspace import new_folder

TEXTS = [
    "Hello, World!! it's 3.14 don't", None, "", "  \n\t ", "a b\x85c\x1cd  e", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "of%%% the&&& naïve Éa.*** É.! é Å ΑΣ ΑΣ. ſ K İ", "x.'s '.s (a). ».. »...", "漢字 かな😀!", "z" * 50_000, "word " * 20_000, "12,34 a1. 5%x%",
]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_and_shard_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint64).astype("<u4")
    assert np.array_equal(T.from_planes(T.to_planes(ids, bits), len(ids)), ids)
    shard = T.Shard(T.encode_shard([(7, 400), (None, 0), (8, 600)], ids, 64, bits))
    assert np.array_equal(shard.ids(), ids)
    for begin, end in [(0, 1), (63, 65), (64, 128), (500, 1000), (999, 5000), (10, 10)]:
        assert np.array_equal(shard.ids(begin, end), ids[begin:end])
    assert [(d, at, len(x)) for d, at, x in shard.documents()] == [(7, 0, 400), (None, 400, 0), (8, 400, 600)]
    assert np.array_equal(np.concatenate([x for _, _, x in shard.documents()]), ids)


def test_low_ids_take_two_planes():
    ids = np.random.default_rng(1).integers(0, 49_408, 16_384).astype("<u4")
    assert len(T.encode_shard([(1, len(ids))], ids)) < 2.1 * len(ids)


@pytest.mark.parametrize("limits", [{}, {"shard_ids": 50, "block": 16}])
def test_ids_are_the_tokenizers_own(spark, limits):
    whole = Tokenizer.from_file(T.default_tokenizer())
    rows = [(10 * i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "null id", "c"), (20, "twice", "c")]
    path = new_folder(spark, "t")
    T.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(5), path, **limits)
    got = T.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    at, left = 0, [(r[0], [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    for row in got:
        assert row.start == at and row.n_tokens == len(row.ids)
        left.remove((row.doc_id, list(row.ids)))
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        at += row.n_tokens
    assert not left


def test_empty_table(spark):
    path = new_folder(spark, "t")
    T.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), path)
    assert T.read_tokens(spark, path).collect() == []


def test_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 5)
    coder, whole = T.WordEncoder(T.default_tokenizer()), Tokenizer.from_file(T.default_tokenizer())
    for text in ["one two three", "one four five six", "one two. three, seven", "a b c d e f g h"] * 2:
        ids = np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids
