from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termlens.llm import mixing as M

DOCS = "doc_id bigint, source string, text string, copy string"


def _copies(doc_id, rate, seed=M.SEED):
    name = "null" if doc_id is None else doc_id
    draw = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:13], 16) / 2**52
    total = count = 0
    while count < 100_000:
        total += math.exp(count * math.log(rate) - rate - math.lgamma(count + 1)) if rate else 1
        if total > draw:
            return count
        count += 1


def _brute(rows, weights=None, power=M.POWER):
    sizes = Counter()
    for _, source, text, _ in rows:
        sizes[source] += len(text or "") + 1
    shares = {s: n**power for s, n in sizes.items()} if weights is None else {s: w for s, w in weights.items() if s in sizes}
    rates = {s: sum(sizes.values()) * share / sum(shares.values()) / sizes[s] for s, share in shares.items()}
    return sorted((r for r in rows if r[1] in rates for _ in range(_copies(r[0], rates[r[1]]))), key=str)


@pytest.mark.parametrize("weights", [None, {"a": 1, "c": 3, "missing": 9, "zero": 0}])
def test_equals_brute_force(spark, weights):
    rows = [(i, "abbbbbc"[i % 7], "x" * (i % 50), "own") for i in range(400)]
    rows += [(500, None, "no source", "own"), (501, "c", None, None), (502, "empty", "", ""), (None, "c", "no id", "o"), (3, "b", "twice", "o"), (3, "b", "twice", "o"), (504, "zero", "z", "o")]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = M.mix(frame, weights)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows, weights)


def test_shares_are_met_and_rows_are_shuffled(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 18_000, "big").otherwise("small").alias("source"), F.lit("t").alias("text"))
    mixed = M.mix(frame, {"big": 1, "small": 1}).collect()
    sizes = Counter(r.source for r in mixed)
    assert abs(sizes["big"] - 10_000) < 400 and abs(sizes["small"] - 10_000) < 400
    # neighbours come from anywhere
    turns = sum(a.source != b.source for a, b in zip(mixed, mixed[1:]))
    assert abs(turns / len(mixed) - 0.5) < 0.05


def test_large_rates_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "s", "a")], "doc_id bigint, source string, text string")
    assert M.mix(frame, {"s": 1}, total=6000.0).count() == _copies(1, 3000.0)
    assert M.mix(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.mix(frame, {"s": -1})


def test_equal_rows_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "OFTEN", 100)
    hot = spark.range(6_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("a").alias("source"), F.lit("same").alias("text"))
    rest = spark.range(100, 3_100).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("other").alias("text"))
    rows = hot.unionByName(rest)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = M.mix(rows, {"a": 2, "b": 1}, total=9_000 * 25.0).select("doc_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    copies = [r for r in mixed if r.doc_id == 1]
    assert len(copies) % 6_000 == 0 and copies
    tasks = Counter(r.task for r in copies)
    assert len(tasks) == 8 and max(tasks.values()) < 0.2 * len(copies)


def test_a_large_rate_takes_linear_time(spark):
    import time

    rated = spark.createDataFrame([("s", 10_000.0), ("none", 0.0)], "__source string, __rate double")
    begin = time.perf_counter()
    steps = {r[0]: r[1] for r in M.poisson_steps(rated).collect()}
    assert time.perf_counter() - begin < 8 and steps["none"] == [1.0]
    assert abs(steps["s"][10_000] - 0.50266) < 1e-4 and abs(steps["s"][-1] - 1) < 1e-9


def test_a_very_long_text_is_only_moved(spark):
    frame = spark.createDataFrame([(n, "s", "long " * 400_000) for n in range(3)], "doc_id bigint, source string, text string")
    assert {len(r.text) for r in M.mix(frame, total=60_000_000.0).collect()} == {2_000_000}
