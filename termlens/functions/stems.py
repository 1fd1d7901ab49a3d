"""Porter (1980) stems with the common later amendments, as native expressions.

A word's shape writes c for each consonant and v for each vowel; a y is a vowel after
a consonant. The measure of a word is how often a v is followed by a c. The expressions are
wide, so the jobs in ``operators.stems`` apply them to distinct terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from termlens.functions.text import ColumnOrName, bind

# Irregular words and their stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "inning": "inning", "innings": "inning", "outing": "outing",
    "outings": "outing", "canning": "canning", "cannings": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffixes and what replaces them, first match decides.
DERIVED = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
RELATED = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
ENDINGS = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: Column) -> Column:
    marks = F.regexp_replace(F.regexp_replace(word, "[^aeiouy]", "c"), "[aeiou]", "v")

    def turned(all_marks: Column) -> Column:
        # neighbours of y are read one after the other; a single y needs its neighbour only
        letters = F.aggregate(
            F.split(all_marks, ""),
            F.lit(""),
            lambda done, mark: F.concat(
                done, F.when(mark != "y", mark).when(F.right(done, F.lit(1)) == "c", "v").otherwise("c")
            ),
        )
        single = F.regexp_replace(F.regexp_replace(all_marks, "cy", "cv"), "(^|v)y", "$1c")
        return F.when(F.contains(all_marks, F.lit("yy")), letters).otherwise(single)

    return bind(marks, turned)


def _measure(shape: Column) -> Column:
    return (F.length(shape) - F.length(F.replace(shape, F.lit("vc"), F.lit("")))) / 2


def _cut(text: Column, count: int) -> Column:
    return F.left(text, F.length(text) - F.lit(count))


def _ends(word: Column, *suffixes: str) -> Column:
    found = F.endswith(word, F.lit(suffixes[0]))
    for suffix in suffixes[1:]:
        found = found | F.endswith(word, F.lit(suffix))
    return found


def _ends_short(word: Column, shape: Column) -> Column:
    """Consonant-vowel-consonant at the end (last not w, x, y), or a two-letter vc."""
    return (_ends(shape, "cvc") & ~_ends(word, "w", "x", "y")) | (shape == "vc")


def _step(word: Column, body: Callable[[Column, Column], Column], suffixes: tuple[str, ...]) -> Column:
    """``body`` of the word and its shape, each evaluated once; a word without any of ``suffixes``, which ``body`` would leave as it
    is, costs no shape."""
    return bind(word, lambda w: F.when(_ends(w, *suffixes), bind(_shape(w), lambda shape: body(w, shape))).otherwise(w))


def _plural(word: Column, _: Column) -> Column:
    return (
        F.when(_ends(word, "sses"), _cut(word, 2))
        .when(_ends(word, "ies"), F.when(F.length(word) == 4, _cut(word, 1)).otherwise(_cut(word, 2)))
        .when(_ends(word, "s") & ~_ends(word, "ss"), _cut(word, 1))
        .otherwise(word)
    )


def _repaired(stem: Column, shape: Column) -> Column:
    doubled = (F.length(stem) > 1) & (F.right(stem, F.lit(1)) == F.substring(stem, -2, 1)) & _ends(shape, "c")
    return (
        F.when(_ends(stem, "at", "bl", "iz"), F.concat(stem, F.lit("e")))
        .when(doubled, F.when(_ends(stem, "l", "s", "z"), stem).otherwise(_cut(stem, 1)))
        .when((_measure(shape) == 1) & _ends_short(stem, shape), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _past(word: Column, shape: Column) -> Column:
    result = (
        F.when(_ends(word, "ied"), F.when(F.length(word) == 4, _cut(word, 1)).otherwise(_cut(word, 2)))
        .when(_ends(word, "eed"), F.when(_measure(_cut(shape, 3)) > 0, _cut(word, 1)).otherwise(word))
    )
    for suffix in ("ed", "ing"):
        count = len(suffix)
        has_vowel = F.contains(_cut(shape, count), F.lit("v"))
        result = result.when(
            _ends(word, suffix), F.when(has_vowel, _repaired(_cut(word, count), _cut(shape, count))).otherwise(word)
        )
    return result.otherwise(word)


def _final_y(word: Column, shape: Column) -> Column:
    turns = _ends(word, "y") & (F.length(word) > 2) & (F.substring(shape, -2, 1) == "c")
    return F.when(turns, F.concat(_cut(word, 1), F.lit("i"))).otherwise(word)


def _swap(word: Column, shape: Column, table: tuple[tuple[str, str], ...], first: Column | None = None) -> Column:
    result = first
    for suffix, replacement in table:
        count = len(suffix)
        new = F.concat(_cut(word, count), F.lit(replacement))
        swapped = F.when(_measure(_cut(shape, count)) > 0, new).otherwise(word)
        result = (F.when if result is None else result.when)(_ends(word, suffix), swapped)
    return result.otherwise(word)


def _shorter_adverb(word: Column, shape: Column) -> Column:
    return F.when(_ends(word, "alli") & (_measure(_cut(shape, 4)) > 0), _cut(word, 2)).otherwise(word)


def _derived(word: Column, shape: Column) -> Column:
    logi = F.when(_measure(_cut(shape, 3)) > 0, _cut(word, 1)).otherwise(word)
    return _swap(word, shape, DERIVED, F.when(_ends(word, "logi"), logi))


def _cut_ending(word: Column, shape: Column) -> Column:
    result = None
    for suffix in ENDINGS:
        count = len(suffix)
        found = _ends(word, suffix)
        if suffix == "ion":
            found = found & _ends(_cut(word, 3), "s", "t")
        kept = F.when(_measure(_cut(shape, count)) > 1, _cut(word, count)).otherwise(word)
        result = (F.when if result is None else result.when)(found, kept)
    return result.otherwise(word)


def _without_e(word: Column, shape: Column) -> Column:
    stem, own = _cut(word, 1), _cut(shape, 1)
    drops = (_measure(own) > 1) | ((_measure(own) == 1) & ~_ends_short(stem, own))
    return F.when(_ends(word, "e") & drops, stem).otherwise(word)


def _without_l(word: Column, shape: Column) -> Column:
    return F.when(_ends(word, "ll") & (_measure(_cut(shape, 1)) > 1), _cut(word, 1)).otherwise(word)


# Each step, and the endings of the words that it may change.
_STEPS = (
    (_plural, ("s",)),
    (_past, ("ed", "ing")),
    (_final_y, ("y",)),
    (_shorter_adverb, ("alli",)),
    (_derived, ("logi", *(suffix for suffix, _ in DERIVED))),
    (lambda word, shape: _swap(word, shape, RELATED), tuple(suffix for suffix, _ in RELATED)),
    (_cut_ending, ENDINGS),
    (_without_e, ("e",)),
    (_without_l, ("ll",)),
)


def stem(term: ColumnOrName) -> Column:
    """The stem of each term; terms of one or two letters stay as they are, in lower case."""
    word = F.lower(F.col(term) if isinstance(term, str) else term)

    def stemmed(lower: Column) -> Column:
        result = lower
        for step, suffixes in _STEPS:
            result = _step(result, step, suffixes)
        known = F.when(F.length(lower) <= 2, lower)
        for irregular, own in IRREGULAR.items():
            known = known.when(lower == irregular, F.lit(own))
        return known.otherwise(result)

    return bind(word, stemmed)
