"""Text cleaning and token functions: Column in, Column out, no Python workers.

Every function accepts a column or a column name and returns a native
expression, so Catalyst sees the whole chain and it runs inside the scan stage.
Null text becomes an empty token array.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from termlens.functions.stopwords import ENGLISH

ColumnOrName = Column | str

DIGIT_PLACEHOLDER = "#"

# The kept characters are listed one by one because the JVM matches such a class
# with a bit table; written as ranges ([^a-zA-Z# ]) it is about nine times slower.
_DELETED = f"[^{string.ascii_letters}# ]+"

# What the JVM's \s matches.
_BLANKS = " \t\n\x0b\f\r"


def _column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: ColumnOrName, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain expression used several times in ``body`` would be run once per use
    whenever it sits below a higher-order function, where Spark does not share
    common subexpressions.
    """
    return F.get(F.transform(F.array(_column(value)), body), F.lit(0))


def replace_digits(text: ColumnOrName) -> Column:
    """Every run of ASCII digits becomes one ``#``."""
    return F.regexp_replace(_column(text), "[0-9]+", DIGIT_PLACEHOLDER)


def remove_punctuation(text: ColumnOrName) -> Column:
    """Delete (not blank) everything but ASCII letters, ``#`` and the space."""
    return F.regexp_replace(_column(text), _DELETED, "")


def clean_text(text: ColumnOrName) -> Column:
    return remove_punctuation(replace_digits(text))


def _no_tokens() -> Column:
    return F.array().cast("array<string>")


def tokenize(text: ColumnOrName) -> Column:
    """Lower-cased tokens, split at each single blank, as Spark ML's Tokenizer.

    Leading and inner empty tokens stay and trailing ones go; ``''`` gives
    ``['']`` and blank-only text gives ``[]``.
    """

    def split(lowered: Column) -> Column:
        body = F.rtrim(lowered, F.lit(_BLANKS))
        return (
            F.when(lowered.isNull() | ((body == "") & (lowered != "")), _no_tokens())
            .otherwise(F.split(body, r"\s"))
        )

    return bind(F.lower(_column(text)), split)


@lru_cache
def _literals(words: tuple[str, ...]) -> tuple[Column, ...]:
    """Made once: a literal costs a call to the JVM, and a plan cleans many columns."""
    return tuple(F.lit(word) for word in words)


def remove_stop_words(
    tokens: ColumnOrName, stop_words: Sequence[str] = ENGLISH
) -> Column:
    """Drop stop words, whatever their case; order and copies are kept."""
    listed = _literals(tuple(word.lower() for word in stop_words))
    return F.filter(_column(tokens), lambda token: ~F.lower(token).isin(*listed))


def clean_tokens(
    text: ColumnOrName,
    stop_words: Sequence[str] = ENGLISH,
    drop_empty: bool = False,
) -> Column:
    """Digits, punctuation, tokens, stop words: the whole chain as one expression."""
    dropped = [*(word.lower() for word in stop_words), *([""] if drop_empty else [])]
    listed = _literals(tuple(dropped))
    return F.filter(_cleaned_tokens(text), lambda token: ~token.isin(*listed))


def _cleaned_tokens(text: ColumnOrName) -> Column:
    """``tokenize(clean_text(text))``: the only blank left by the cleaning is the space, which the JVM
    trims and splits at without a pattern."""

    def split(lowered: Column) -> Column:
        body = F.rtrim(lowered)
        return (
            F.when(lowered.isNull() | ((body == "") & (lowered != "")), _no_tokens())
            .otherwise(F.split(body, " "))
        )

    return bind(F.lower(clean_text(text)), split)


def join_tokens(*arrays: ColumnOrName) -> Column:
    """Token arrays one after the other."""
    return F.concat(*[_column(a) for a in arrays])


def ngrams(tokens: ColumnOrName, n: int = 2) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by a blank; ``[]`` if too short."""

    def windows(a: Column) -> Column:
        starts = F.greatest(F.size(a) - F.lit(n - 1), F.lit(0))
        shifted = [F.slice(a, F.lit(k + 1), starts) for k in range(n)]
        joined = shifted[0]
        for nxt in shifted[1:]:
            joined = F.zip_with(joined, nxt, lambda left, right: F.concat(left, F.lit(" "), right))
        return joined

    return bind(tokens, windows)


def bigrams(tokens: ColumnOrName) -> Column:
    return ngrams(tokens, 2)


def pad_sequence(ids: ColumnOrName, length: int) -> Column:
    """Exactly ``length`` ids: cut at the end, or filled up at the end with 0."""
    padding = F.array_repeat(F.lit(0), length)
    return F.slice(F.concat(_column(ids), padding), 1, length)


def term_counts(tokens: ColumnOrName) -> Column:
    """``array<struct<term, tf>>`` of one token array, sorted by term; null tokens are none.

    Counts inside the row by sorting and measuring runs, so per-document term
    frequencies need neither an explode nor a shuffle.
    """

    def runs(a: Column) -> Column:
        starts = F.filter(
            F.transform(
                a,
                lambda term, i: F.when(
                    (i == 0) | (term != F.get(a, i - F.lit(1))), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return bind(
            starts,
            lambda s: F.zip_with(
                s,
                F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(a))),
                # two starts and one end per run; the empty array has one end
                # and no start, which is filtered out below
                lambda begin, end: F.struct(
                    F.get(a, begin).alias("term"),
                    (end - begin).cast("bigint").alias("tf"),
                ),
            ),
        )

    # sort_array needs no comparator, which would be run for each comparison
    counted = bind(F.sort_array(F.array_compact(_column(tokens))), runs)
    return F.filter(counted, lambda run: run["tf"].isNotNull())
