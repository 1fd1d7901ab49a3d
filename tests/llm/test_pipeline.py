"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_decontaminate import _brute as contaminated
from test_mixing import _brute as mixed
from test_simhash import _components, _print
from tokenizers import Tokenizer

from termlens.llm import quality, token_store
from termlens.sources.workspace import materialize

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    chance = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows, labels, items = [], [], [(i, " ".join(chance.choices(words, k=20))) for i in range(12)]
    for doc in range(400):
        text = chance.choices(words, k=chance.choice([5, 60, 60, 300]))
        kind = chance.choice(["good"] * 5 + ["junk", "toxic", "copy", "near", "benchmark"])
        if kind == "junk":
            text = [w + "###" for w in text]
        if kind == "toxic":
            text.insert(len(text) // 2, chance.choice(["Insult!", "slur"]))
        if kind in ("copy", "near") and rows:
            text = chance.choice(rows)[1].split()
            if kind == "near" and len(text) > 100:
                text[50] = "changed"
        if kind == "benchmark":
            text += chance.choice(items)[1].upper().split()
        rows.append((doc, " ".join(text), "en", chance.choice(["a", "a", "b", None]), len(text)))
        if kind not in ("copy", "near") and chance.random() < 0.8:
            labels.append((doc, int(kind != "junk"), int(kind == "toxic")))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (None, "no id at all", "en", "b", 1), (902, "y " * 20_000, "en", "b", 2), (5, rows[5][1], "en", "a", 1)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        stages.append(docs)
        docs = materialize(stage(spark, docs, folder), name)
        if name != "token_output":
            assert docs.columns == stages[0].columns
    start, good, single, clean, blend = [[tuple(r) for r in frame.collect()] for frame in stages]
    tokens = docs.collect()

    model = quality.train(stages[0], spark.read.parquet(f"{folder}/labels.parquet"))
    passes = model.tails(model.scores([quality.features((r[1] or "").encode()) for r in start]))[:, 1] >= 0.5
    assert Counter(good) == Counter(r for r, p in zip(start, passes) if p)
    missed = [r[1][:200] for r in good if any(m in (r[1] or "") for m in ("Insult!", "slur", "###"))]
    assert not missed and len(good) > 300

    prints = [_print(r[1]) for r in good]
    groups = _components(set(prints), [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for row, fingerprint in zip(good, prints):
        group, doc = groups[fingerprint], float("inf") if row[0] is None else row[0]
        least[group] = min(doc, least.get(group, doc))
    assert len(single) == len(least) < len(good)
    assert sorted(float("inf") if r[0] is None else r[0] for r in single) == sorted(least.values())

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = contaminated([(i, r[1]) for i, r in enumerate(single)], items, 13)
    assert Counter(clean) == Counter(r for i, r in enumerate(single) if not hit[i][4])
    assert len(clean) < len(single)

    # source, text and the rest in the order that the brute-force mixing takes
    as_given = [(r[0], r[3], r[1], r) for r in clean]
    assert Counter(blend) == Counter(r[3] for r in mixed(as_given))

    whole = Tokenizer.from_file(token_store.default_tokenizer())
    expected = Counter((r[0], tuple([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in blend)
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens) == expected
    assert sorted(r.start for r in tokens) == sorted(sum(x.n_tokens for x in tokens if x.start < r.start) for r in tokens)


def test_run_applies_the_stages_to_all_documents(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "benchmark_decontamination", "source_mixing", "token_output"]
    result = corpus_pipeline.run(spark, folder)
    assert result.count() > 100 and {"doc_id", "start", "n_tokens", "ids"} <= set(result.columns)
