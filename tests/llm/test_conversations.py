from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from termlens.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\v\f\r"


def _damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def _cheapest(rows, faults):
    """Cost, audit and repaired lines by a search over whole edit sequences, cheapest and ASCII-least first."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(lines)
        node = (at, roles[-1:] if roles else "", bool(roles))
        # equal nodes: the first one popped is the cheapest and the least
        if (node, audit) in done or not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        done.add((node, audit))
        if any(n == node and a != audit for n, a in done):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role[0], (*lines, f"{role}:")))
        if at < len(rows):
            _, role, text = rows[at]
            fault = faults[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[:1], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, roles + new[0], (*lines, f"{new}:{text}")))
    raise AssertionError


def _expected(conv, rows):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, repaired = _cheapest(rows, faults)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())


def _some(chance, ids):
    rows = []
    for conv in ids:
        for n in range(chance.randrange(0, 8)):
            turn = chance.choice([n, n, n, n + 3, None])
            role = chance.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ann"])
            text = chance.choice(["Yes.", "No!", "open", "", " \n", None, "Why? ", "x" * 40 + "."])
            rows.append((conv, turn, role, text))
    return rows


def _all_expected(rows):
    ids = dict.fromkeys(r[0] for r in rows)
    groups = {conv: [] for conv in ids}
    for conv, *rest in _ordered(_damage(rows)):
        groups[conv].append(tuple(rest))
    return sorted((_expected(conv, held) for conv, held in groups.items()), key=str)


# the search does not know a role without initial
def _usable(rows):
    return [r if r[2] != "" else (*r[:2], "x", r[3]) for r in rows]


@pytest.mark.parametrize("most_rows, chunk", [(20_000, 4_096), (2, 2), (0, 1), (3, 50)])
def test_equals_search(spark, monkeypatch, most_rows, chunk):
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
    chance = random.Random(5)
    rows = _usable(_some(chance, [*range(150), None]))
    rows += [(900, n, "user" if n % 2 else "assistant", "Same." if n % 3 else f"T{n}") for n in range(12)]
    rows += [(901, None, "user", "Same.")] * 9 + [(902, 5, "system", "S.")]
    chance.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("other"), "audit": F.lit(1)}).repartition(5)
    got = C.digest(C.repair(C.damaged(table), most_rows)).collect()
    assert sorted(map(tuple, got), key=str) == _all_expected(rows)


def test_long_conversation_has_its_parts_in_order(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 7)
    rows = [(1, n, ("user", "assistant")[n % 2], f"Text {n}.") for n in range(100)] + [(2, 0, "user", "Hi.")]
    out = C.repair(C.as_they_are(spark.createDataFrame(rows, SCHEMA)), most_rows=10)
    parts = out.where("conv_id = 1").orderBy("part").collect()
    assert len(parts) >= 15 and not any(p.whole for p in parts)
    assert "\n".join(p.repaired for p in parts) == "\n".join(f"{r}:{t}" for _, _, r, t in rows[:100])
    assert "".join(p.audit for p in parts) == "K" * 100
    (short,) = out.where("conv_id = 2").collect()
    assert (short.whole, short.cost, short.audit, short.repaired) == (True, 2, "D", "")


def test_role_without_initial_is_not_kept(spark):
    rows = [(1, 0, "", "Hello."), (1, 1, "assistant", "Good day.")]
    (row,) = C.repair(C.as_they_are(spark.createDataFrame(rows, SCHEMA))).collect()
    assert (row.illegal, row.cost, row.audit, row.repaired) == (1, 1, "RK", "user:Hello.\nassistant:Good day.")


def test_ties_take_the_least_audit(spark):
    # deleting both costs as much as any other way out of two equal roles without an answer
    row = C.repair_rows([(0, "assistant", "A."), (1, "assistant", "B.")])
    assert (row["cost"], row["audit"], row["repaired"]) == (1, "RK", "user:A.\nassistant:B.")
    row = C.repair_rows([(0, "system", "A")])
    assert (row["cost"], row["audit"], row["repaired"]) == (2, "D", "")


def test_empty_table_and_only_dropped_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digest(C.repair(C.damaged(empty))).count() == 0
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    dropped = spark.createDataFrame([(7, turn, "user", "Hi.")] * 3, SCHEMA)
    zeros = (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for most_rows in (100, 1):
        assert [tuple(r) for r in C.digest(C.repair(C.damaged(dropped), most_rows)).collect()] == [zeros]


def test_very_long_text_and_a_row_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 100)
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Ok.")] + [(1, 2, "user", "More.")] * 1_000
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    results = [C.digest(C.repair(C.as_they_are(table), most)).collect() for most in (20_000, 10)]
    assert results[0] == results[1]
    assert results[0][0].audit == "KK" + "D" * 1_000 and results[0][0].duplicate == 999
