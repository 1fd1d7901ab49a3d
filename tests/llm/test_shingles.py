from __future__ import annotations

import random
import resource

import numpy as np
import xxhash

from termlens.llm import fingerprints, minhash, shingles, simhash


def test_every_shingle_once_whatever_the_windows(monkeypatch):
    chance = random.Random(3)
    for size in range(0, 50, 2):
        text = "".join(chance.choice(["ab", "C", " ", "\n", "é"]) for _ in range(size)).encode()
        words = text.lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        expected = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        for window in (1, 5, 1 << 20):
            monkeypatch.setattr(shingles, "WINDOW", window)
            assert [h for part in shingles.shingle_hashes(text, 3) for h in part.tolist()] == expected


def test_a_long_text_takes_little_memory():
    text = b"".join(b"word%d " % (n % 1_000) for n in range(5_000_000))
    assert len(text) > 30 << 20
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert simhash.fingerprint(text) and len(fingerprints.sketch(text)) == 128 and len(minhash.shingle_set(text)) == 1_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10
