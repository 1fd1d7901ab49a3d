"""Shingles of words, read by windows of a text so that a long one takes no more memory than its hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash

#: Bytes of a text whose words are held at once.
WINDOW = 1 << 20
_WHITE = b" \t\n\v\f\r"


def text_windows(text: bytes) -> Iterator[bytes]:
    """Parts of ``text`` that end before white space, or with the text."""
    begin = 0
    while begin < len(text):
        end = min(begin + WINDOW, len(text))
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        yield text[begin:end]
        begin = end


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of ``width`` words (A-Z in lower case, joined by one space), window by window.

    A text of fewer words has one, the whole sequence; one without words has none.
    """
    digest = xxhash.xxh64_intdigest
    held: list[bytes] = []
    found = False
    for window in text_windows(text):
        words = held + window.lower().split()
        if len(words) < width:
            held = words
            continue
        found = True
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        begins = [0, *ends[:-1]]
        yield np.array([digest(joined[b : e - 1], 42) for b, e in zip(begins, ends[width - 1 :])], np.uint64)
        held = words[len(words) - width + 1 :]
    if held and not found:
        yield np.array([digest(b" ".join(held), 42)], np.uint64)
