from __future__ import annotations

import pytest

from porter_by_row import stem

from checks import queries
from termlens.functions import stems as native
from termlens.operators import stems

# Words and stems, from the published description of the algorithm
# and from its amendments.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "enjoy": "enjoy",
    "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit",
    "radically": "radic", "differently": "differ", "vileli": "vile", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formality": "formal",
    "sensitivity": "sensit", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "adjustable": "adjust", "replacement": "replac",
    "adoption": "adopt", "communism": "commun", "effective": "effect", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll", "sky": "sky",
    "skies": "sky", "dying": "die", "died": "die", "spied": "spi", "news": "news", "is": "is",
    "by": "by", "say": "say", "biology": "biolog", "Running": "run", "#": "#", "": "",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_published_stems(word):
    assert stem(word) == STEMS[word]


def test_native_stems_equal_those_by_row(spark):
    import itertools
    import random

    chance = random.Random(8)
    starts = ["", "b", "y", "tr", "hop", "rel", "yyb", "sky", "oper", "fall", "agr", "controll", "biz", "tax", "éa", "#x", "ay"]
    middles = ["", "a", "e", "ss", "ll", "at", "bl", "iz", "y", "eed", "tt"]
    ends = [s for s, _ in native.DERIVED + native.RELATED] + list(native.ENDINGS) + ["s", "ies", "sses", "ied", "eed", "ed", "ing", "y", "logi", "e", "ll", ""]
    words = {"".join(p) for p in itertools.product(starts, middles, ends)} | set(STEMS) | set(native.IRREGULAR)
    words |= {"".join(chance.choices("aeiouystlbn", k=chance.randrange(1, 9))) for _ in range(3000)}
    # any number of y in a row
    words |= {"".join(chance.choices("yyyyyyyyab", k=chance.randrange(1, 30))) + chance.choice(["", "ing", "ed", "s"]) for _ in range(300)}
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "term string").repartition(8)
    got = {r["term"]: r["stem"] for r in frame.withColumn("stem", native.stem("term")).collect()}
    assert {w: s for w, s in got.items() if s != stem(w)} == {} and len(got) == len(words)


def test_jobs_stem_every_term(spark):
    tokens = spark.createDataFrame(
        [(1, ["cats", "hopping", "cats"]), (2, []), (3, ["", "happy"])], "id int, tokens array<string>"
    )
    table = {r["term"]: r["stem"] for r in stems.stem_terms(tokens).collect()}
    assert table == {"cats": "cat", "hopping": "hop", "": "", "happy": "happi"}
    rows = stems.stem_tokens(tokens, {"tokens": "stems"}).collect()
    assert {r["id"]: r["stems"] for r in rows} == {1: ["cat", "hop", "cat"], 2: [], 3: ["", "happi"]}


@pytest.mark.parametrize("most", [0, 1, 2, 100])
def test_frequent_terms_are_looked_up_and_others_stemmed_where_they_stand(spark, most):
    rows = [(1, ["cats", None, "hopping"], ["Ponies"]), (2, ["cats", "cats", "x" * 70], None), (3, None, ["hopping", "cats"]), (4, [], [])]
    tokens = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    assert {r["term"] for r in stems.frequent_stems(tokens, ["a", "b"], most).collect()} == [set(), {"cats"}, {"cats", "hopping"}][min(most, 2)]
    got = {r["id"]: (r["p"], r["q"]) for r in stems.stem_tokens(tokens, {"a": "p", "b": "q"}, most).collect()}
    assert got == {1: (["cat", "hop"], ["poni"]), 2: (["cat", "cat", "x" * 70], []), 3: ([], ["hop", "cat"]), 4: ([], [])}


def test_tokens_are_not_stored_for_their_stems(spark, tiny, monkeypatch):
    stored, real = [], stems.materialize
    monkeypatch.setattr(stems, "materialize", lambda frame, label: stored.append(frame.columns) or real(frame, label))
    plan = queries.QUERIES["stem_tokens"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert stored == [["term", "n"], ["term", "stem"]] and "Join" not in plan and "Aggregate" not in plan
