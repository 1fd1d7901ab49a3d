"""Repair of conversation structure at the least cost, with an audit of the edits.

A repaired conversation's role initials are ``(s?(ua)+)?``. In the order of its turns every row is
kept (0), given the role user or assistant (1) or deleted (2, a must for blank and duplicate rows), an
undeleted truncated row costs 5 more, and empty rows may be inserted anywhere (5 each). The edits
are a path through a graph without cycles whose nodes are (row, state), a state being what the
repaired rows so far end with. A path's weight is one integer: its high digits are the cost, its low
digits, a fixed number of octal ones, spell the audit (D, I, K, R as 1 to 4, zeros behind the end). An edit put before a
path adds its cost, moves the audit by one digit and adds its letter at the first place, so the
smallest integer of a node is the cheapest path and, of equal ones, the one of the ASCII-least audit; the best
path of the whole is found by nothing but minima from the last row to the first, and its audit is
read off its low digits.

A conversation of up to ``MOST_ROWS`` rows and ``MOST_BYTES`` is one group of a sorted shuffle and is handled in a stream. A
longer one is never in one task: its repeated rows are counted before they meet, its rows are dealt by
ranges and cut into chunks, each chunk gives its least paths between all pairs of states (in
tasks of their own), the chunks' paths are chained from the last to the first, one small row a
chunk, and its result has one row per chunk. Both ways give the same edits.

Defined results: a null role or text is one space. Rows of one turn are in the order of their roles, then of the md5 of
their texts; rows without a turn come first. Rows that agree in all columns are duplicates of the first
one. The rows of a null conv_id are a conversation. A row whose role is empty has no initial: it cannot
be kept, and its pairs are illegal. A conversation without rows has zeros and an empty audit. An empty table gives
an empty one. Columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.components import join_spread
from termlens.sources.workspace import materialize

COLUMNS = ["conv_id", "turn", "role", "text"]
#: Fixed values of the damage: rows by crc32 modulo this number.
DAMAGE_MODULUS = 20
WHITE = " \t\n\v\f\r"
#: Conversations beyond either are cut into chunks.
MOST_ROWS, MOST_BYTES = 20_000, 64 << 20
#: Rows and bytes of a chunk of a long conversation.
CHUNK_ROWS, CHUNK_BYTES = 4_096, 16 << 20
#: Tasks over which the rows of one text of a long conversation are spread.
SPREAD = 64

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that is inserted, or a row that gets such a role.
_TURN = (USER, USER, ASSISTANT, USER)
_ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
_LETTERS = str.maketrans("1234", "DIKR")
_LEGAL = {"su", "ua", "au"}
#: Octal digits hold the letters of an audit; high digits beyond these bits of cost stand for no path.
_BITS, _NO_PATH = 3, 1 << 48


# ---------------------------------------------------------------------- rows of a table


def damaged(conversations: DataFrame) -> DataFrame:
    """The four columns with the stated faults put in, and ``present``, false for a dropped row.

    By the crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its stops, 3
    repeats it, 4 makes its role user.
    """

    def spelled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")), F.lit(DAMAGE_MODULUS))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spelled("text"), "[.!?]", "")).otherwise(spelled("text"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(spelled("role")).alias("role"),
        text.alias("text"),
        (kind != 0).alias("present"),
        F.when(kind == 3, 2).otherwise(1).alias("__times"),
    )
    return rows.withColumn("__time", F.explode(F.sequence(F.lit(1), "__times"))).drop("__times", "__time")


def as_they_are(conversations: DataFrame) -> DataFrame:
    """The four columns with nulls of role and text as one space, every row present."""
    filled = [F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name) for name in ("role", "text")]
    return conversations.select("conv_id", "turn", *filled, F.lit(True).alias("present"))


# ----------------------------------------------------------------------- least paths


class Paths:
    """Weights of paths over ``rows`` rows: cost above, audit below."""

    def __init__(self, rows: int) -> None:
        # a cheapest path never costs more than deleting all and inserting two rows
        self.width = rows + (2 * rows + 10) // 5 + 12
        self.bits = _BITS * self.width
        self.low = (1 << self.bits) - 1
        self.none = _NO_PATH << self.bits

    def put(self, weight: int, cost: int, letter: int, times: int = 1) -> int:
        """The weight of a path with ``times`` times the edit put before it."""
        audit = weight & self.low
        letters = letter * ((8**times - 1) // 7) << (self.bits - _BITS * times)
        return (weight ^ audit) + (cost * times << self.bits) + letters + (audit >> _BITS * times)

    def before(self, weights: list[int], initial: str, forced: bool, truncated: bool, copies: int = 1) -> list[int]:
        """Least weights by state before a row, from those after it; ``copies`` - 1 duplicates of the row follow it."""
        if copies > 1:
            weights = [self.put(w, 2, DELETE, copies - 1) for w in weights]
        rest = [self.put(w, 2, DELETE) for w in weights]
        if not forced:
            more = 5 if truncated else 0
            for state in range(4):
                turned = _TURN[state]
                rest[state] = min(rest[state], self.put(weights[turned], 1 + more, REROLE))
                if initial == "s" and state == EMPTY:
                    rest[state] = min(rest[state], self.put(weights[SYSTEM], more, KEEP))
                elif initial == ("a" if turned == ASSISTANT else "u"):
                    rest[state] = min(rest[state], self.put(weights[turned], more, KEEP))
        return self.inserted(rest)

    def inserted(self, rest: list[int]) -> list[int]:
        """Least weights where up to two rows may be inserted first: more only lead back."""
        one = [self.put(rest[_TURN[s]], 5, INSERT) for s in range(4)]
        two = [self.put(one[_TURN[s]], 5, INSERT) for s in range(4)]
        return [min(ways) for ways in zip(rest, one, two)]

    def ends(self) -> list[int]:
        """Least weights behind the last row of a conversation."""
        return self.inserted([0, self.none, self.none, 0])

    def read(self, weight: int) -> tuple[int, str] | None:
        """Cost and audit; None where there is no path."""
        cost, audit = weight >> self.bits, weight & self.low
        if cost >= _NO_PATH:
            return None
        return cost, f"{audit:0{self.width}o}".rstrip("0").translate(_LETTERS)


def replay(audit: str, rows: list[tuple[str, Any]], state: int) -> Iterator[tuple[str, Any]]:
    """(role, content) of the repaired rows; an inserted row's content is None."""
    at = iter(rows)
    for letter in audit:
        role, content = (None, None) if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        else:
            state = _TURN[state]
            role = _ROLE_OF[state]
        yield role, content


def repair_rows(rows: list[tuple[int | None, str, str]]) -> dict[str, Any]:
    """Faults, cost, audit and repaired text of one conversation's (turn, role, text) in order."""
    seen: set[tuple[str, bytes]] = set()
    faults, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        same = (role, hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
        fault = "blank" if not bare else "duplicate" if same in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add(same)
        faults.append(fault)
        if fault:
            counts[fault] += 1
    paths = Paths(len(rows))
    weights = paths.ends()
    for (_, role, _), fault in zip(reversed(rows), reversed(faults)):
        weights = paths.before(weights, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    cost, audit = paths.read(weights[EMPTY])
    turns = {turn for turn, _, _ in rows if turn is not None}
    repaired = replay(audit, [(role, text) for _, role, text in rows], EMPTY)
    return {
        "gaps": min(max(turns) - min(turns) + 1 - len(turns), 2**63 - 1) if turns else 0,
        **counts,
        "illegal": sum(one[1][:1] + two[1][:1] not in _LEGAL for one, two in pairwise(rows)),
        "cost": cost,
        "audit": audit,
        "repaired": "\n".join(f"{role}:{text or ''}" for role, text in repaired),
    }


# --------------------------------------------------------------- ordinary conversations

_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ", ".join([*[f"{n} bigint" for n in _NUMBERS], "audit string", "repaired string"])


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.sortWithinPartitions(*first, F.asc_nulls_first("turn"), "role", F.md5(F.col("text").cast("binary")))


def _ordinary(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    ordered = _in_order(rows.repartition("conv_id"), "conv_id").select("conv_id", "turn", "role", "text", "present")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict[str, Any]] = []
        held: list[tuple[int | None, str, str]] = []
        open_id, is_open, size = None, False, 0

        def close() -> None:
            nonlocal held
            made.append({"conv_id": open_id, "part": 0, "whole": True, **repair_rows(held)})
            held = []

        def batch() -> pa.RecordBatch:
            nonlocal made, size
            done = pa.RecordBatch.from_pylist(made, schema)
            made, size = [], 0
            return done

        schema = None
        for given in batches:
            if schema is None:
                schema = pa.schema(
                    [("conv_id", given.schema.field("conv_id").type), ("part", pa.int64()), ("whole", pa.bool_())]
                    + [(n, pa.int64()) for n in _NUMBERS]
                    + [("audit", pa.string()), ("repaired", pa.string())]
                )
            for conv_id, turn, role, text, present in zip(*[c.to_pylist() for c in given.columns]):
                if not is_open or conv_id != open_id:
                    if is_open:
                        close()
                    open_id, is_open = conv_id, True
                if present:
                    held.append((turn, role, text))
                    size += len(text)
                if size > 4 << 20 and made:
                    yield batch()
        if is_open:
            close()
            yield batch()

    return ordered.mapInArrow(repaired, f"conv_id {kind.simpleString()}, part bigint, whole boolean, {_RESULT}")


# ------------------------------------------------------------------ long conversations


def _key(*columns: str) -> Column:
    """A short key of values that may be null."""
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws("\n", *named).cast("binary"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Present rows with a key of their conversation, their text's md5 and a key of the whole row."""
    bare = rows.where("present").withColumns({"conv": _key("conv_id"), "h": F.md5(F.col("text").cast("binary"))})
    return bare.withColumn("row", _key("conv", "turn", "role", "h"))


def _entries(keyed: DataFrame) -> DataFrame:
    """Distinct rows of long conversations with their number, faults and size, without texts; stored."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    flags = [
        F.length(F.col("text").cast("binary")).alias("bytes"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
    ]
    names = ["conv", "turn", "role", "h", "row"]
    counted = keyed.select(*names, *flags).groupBy(*names, "bytes", "blank", "open").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    entries = materialize(counted.withColumns({"same": _key("conv", "role", "h"), "place": place}), "conversation-entries")
    first = entries.groupBy("same").agg(F.min("place").alias("first"))
    return join_spread(entries, first, "same", "turn", parts=SPREAD).withColumn("is_first", F.col("place") == F.col("first"))


def _numbers(entries: DataFrame) -> DataFrame:
    """Gaps and faults of long conversations."""
    later = F.col("copies") - F.col("is_first").cast("int")
    return entries.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), later).otherwise(0)).alias("duplicate"),
        F.count_if(~F.col("blank") & F.col("open") & F.col("is_first")).alias("truncated"),
    )


_CHUNKED = (
    "conv string, part bigint, at bigint, role string, row string, bytes bigint, blank boolean, open boolean,"
    " is_first boolean, copies bigint"
)


def _chunked(entries: DataFrame) -> DataFrame:
    """Entries in order, dealt over tasks by ranges, with ``part``, their chunk, and ``at``, their place; stored.

    Copies beyond a chunk's rows go on in further entries, all of them duplicates.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        at = part = first
        open_conv, rows, size = None, 0, 0
        for batch in batches:
            done = []
            for entry in batch.to_pylist():
                left, is_first = entry["copies"], entry["is_first"]
                while left:
                    if entry["conv"] != open_conv or rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
                        open_conv, part, rows, size = entry["conv"], at, 0, 0
                    now = min(left, CHUNK_ROWS - rows)
                    done.append({**entry, "part": part, "at": at, "copies": now, "is_first": is_first})
                    at, rows, size = at + 1, rows + now, size + entry["bytes"]
                    left, is_first = left - now, False
            yield pa.RecordBatch.from_pylist(done, schema)

    schema = pa.schema(
        [("conv", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("row", pa.string()), ("bytes", pa.int64())]
        + [(n, pa.bool_()) for n in ("blank", "open", "is_first")]
        + [("copies", pa.int64())]
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "h"]
    ordered = entries.withColumn("bytes", F.col("bytes").cast("bigint")).repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ordered.select("conv", "role", "row", "bytes", "blank", "open", "is_first", "copies")
    return materialize(columns.mapInArrow(cut, _CHUNKED), "conversation-order")


def _chunk_paths(chunked: DataFrame) -> DataFrame:
    """Per chunk its border initials, the illegal pairs inside, and the least paths between states."""

    def found(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["at"])
        paths = Paths(sum(r["copies"] for r in rows))
        ways = []
        for end in range(4):
            weights = [0 if s == end else paths.none for s in range(4)]
            for r in reversed(rows):
                weights = paths.before(weights, r["role"][:1], r["blank"] or not r["is_first"], r["open"], r["copies"])
            read = [(begin, paths.read(weights[begin])) for begin in range(4)]
            ways += [{"begin": b, "end": end, "cost": p[0], "audit": p[1]} for b, p in read if p]
        inside = sum(a["role"][:1] + b["role"][:1] not in _LEGAL for a, b in pairwise(rows))
        # copies of one row are never a legal pair
        inside += sum(r["copies"] - 1 for r in rows)
        border = {"head": rows[0]["role"][:1], "tail": rows[-1]["role"][:1]}
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], "part": rows[0]["part"], **border, "inside": inside, "ways": ways}], schema)

    way = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    schema = pa.schema(
        [("conv", pa.string()), ("part", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("inside", pa.int64()), ("ways", pa.list_(way))]
    )
    return chunked.groupBy("conv", "part").applyInArrow(
        found,
        "conv string, part bigint, head string, tail string, inside bigint,"
        " ways array<struct<begin: int, end: int, cost: bigint, audit: string>>",
    )


#: A chain of audits: (audit, chain behind it, chunk, state before the chunk), or None behind the last.
Chain = tuple[str, "Chain | None", int | None, int | None]


def less(one: Chain | None, two: Chain | None) -> bool:
    """Is the audit that ``one`` spells less than that of ``two``? Read only up to the first difference."""
    left = right = ""
    while True:
        while not left and one is not None:
            left, one = one[0], one[1]
        while not right and two is not None:
            right, two = two[0], two[1]
        size = min(len(left), len(right))
        if not size:
            return bool(right)
        if left[:size] != right[:size]:
            return left[:size] < right[:size]
        left, right = left[size:], right[size:]
        if not left and not right and one is two:
            return False


def _decided(chunks: DataFrame) -> DataFrame:
    """The edits of each chunk on its conversation's least path; cost and illegal pairs of the whole."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, illegal, follower = None, 0, None
        best: dict[int, tuple[int, Chain | None]] = {}

        def closed() -> pa.RecordBatch:
            cost, chain = best[EMPTY]
            rows = []
            while chain is not None:
                audit, behind, part, state = chain
                if behind is not None and behind[2] is None:
                    # rows inserted at the end belong to the last chunk
                    audit, behind = audit + behind[0], None
                rows.append({"conv": open_conv, "part": part, "state": state, "cost": cost, "illegal": illegal, "audit": audit})
                chain = behind
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv"] != open_conv:
                    if open_conv is not None:
                        yield closed()
                    open_conv, illegal, follower = row["conv"], 0, None
                    paths = Paths(0)
                    ends = [paths.read(weight) for weight in paths.ends()]
                    best = {s: (cost, (audit, None, None, None) if audit else None) for s, (cost, audit) in enumerate(ends)}
                illegal += row["inside"] + (follower is not None and row["tail"] + follower not in _LEGAL)
                follower = row["head"]
                here: dict[int, tuple[int, Chain | None]] = {}
                for way in row["ways"]:
                    cost, rest = best[way["end"]]
                    new = (cost + way["cost"], (way["audit"], rest, row["part"], way["begin"]))
                    old = here.get(way["begin"])
                    if old is None or new[0] < old[0] or new[0] == old[0] and less(new[1], old[1]):
                        here[way["begin"]] = new
                best = here
        if open_conv is not None:
            yield closed()

    schema = pa.schema([("conv", pa.string()), *[(n, pa.int64()) for n in ("part", "state", "cost", "illegal")], ("audit", pa.string())])
    # one small row a chunk meets here, read as a stream
    ordered = chunks.repartition("conv").sortWithinPartitions("conv", F.desc("part"))
    made = ordered.mapInArrow(chained, "conv string, part bigint, state bigint, cost bigint, illegal bigint, audit string")
    return materialize(made, "conversation-edits")


def _chunk_texts(chunked: DataFrame, decided: DataFrame, keyed: DataFrame) -> DataFrame:
    """conv, part, repaired: the lines of each chunk that has some."""

    def lines(rows: pa.Table, edits: pa.Table) -> pa.Table:
        entries = sorted(rows.to_pylist(), key=lambda r: r["at"])
        each = [(r["role"], r["row"]) for r in entries for _ in range(r["copies"])]
        edit = edits.to_pylist()[0]
        kept = replay(edit["audit"], each, edit["state"])
        made = [{"conv": edit["conv"], "part": edit["part"], "slot": n, "says": role, "row": row} for n, (role, row) in enumerate(kept)]
        return pa.Table.from_pylist(made, schema)

    schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("slot", pa.int64()), ("says", pa.string()), ("row", pa.string())])
    chunks = chunked.select("conv", "part", "at", "role", "row", "copies").groupBy("conv", "part")
    kept = chunks.cogroup(decided.groupBy("conv", "part")).applyInArrow(lines, "conv string, part bigint, slot bigint, says string, row string")
    texts = keyed.groupBy("row").agg(F.first("text").alias("text"))
    line = F.concat("says", F.lit(":"), F.coalesce("text", F.lit("")))
    placed = kept.join(texts, "row", "left").groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("slot", line.alias("line")))).alias("l"))
    return placed.select("conv", "part", F.array_join("l.line", "\n").alias("repaired"))


def _long(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Result rows of the conversations in ``ids``, one per chunk."""
    keyed = _keyed(rows)
    entries = materialize(_entries(keyed), "conversation-entries")
    chunked = _chunked(entries)
    decided = _decided(_chunk_paths(chunked))
    parts = decided.join(_chunk_texts(chunked, decided, keyed), ["conv", "part"], "left").join(_numbers(entries), "conv")
    all_ids = ids.select("conv_id", _key("conv_id").alias("conv"))
    counts = [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in _NUMBERS]
    return all_ids.join(parts, "conv", "left").select(
        "conv_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.lit(False).alias("whole"),
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired", F.lit("")).alias("repaired"),
    )


# -------------------------------------------------------------------------- on tables


def repair(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """conv_id, part, whole, the six numbers of the conversation, audit, repaired (lines ``role:text``).

    ``rows`` are those of ``damaged`` or ``as_they_are``. An ordinary conversation is one row (``whole``); a long one has
    a row for each of its chunks, in the order of ``part``, with the audit and the lines of that chunk. ``repaired`` is empty where no line is left.
    """
    size = F.coalesce(F.length(F.col("text").cast("binary")) + F.length(F.col("role").cast("binary")), F.lit(0))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    # at most one id for every ``most_rows`` rows or ``most_bytes`` bytes of the table
    long_ids = materialize(sizes.where((F.col("n") > most_rows) | (F.col("size") > most_bytes)).select("conv_id"), "long-conversations")
    if long_ids.isEmpty():
        return _ordinary(rows)
    named = long_ids.withColumnRenamed("conv_id", "__long")
    same = F.col("conv_id").eqNullSafe(F.col("__long"))
    return _ordinary(rows.join(named, same, "left_anti")).unionByName(_long(rows.join(named, same, "left_semi"), long_ids))


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation: its numbers, the whole audit and the SHA-256 of its repaired text.

    The chunks of a long conversation pass through one hash in their order, as a stream: a SHA-256 cannot be put
    together from parts.
    """
    stored = materialize(repaired, "repaired-conversations")
    short = stored.where("whole").select("conv_id", *_NUMBERS, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, audit, state, filled, schema = None, [], hashlib.sha256(), False, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**head, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}], schema)

        for batch in batches:
            if schema is None:
                fields = [batch.schema.field(n) for n in ("conv_id", *_NUMBERS)]
                schema = pa.schema([*fields, ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if head is None or row["conv_id"] != head["conv_id"]:
                    if head is not None:
                        yield closed()
                    head = {n: row[n] for n in ("conv_id", *_NUMBERS)}
                    audit, state, filled = [], hashlib.sha256(), False
                audit.append(row["audit"])
                if row["repaired"]:
                    state.update(("\n" if filled else "").encode() + row["repaired"].encode("utf-8", "surrogatepass"))
                    filled = True
        if head is not None:
            yield closed()

    parts = stored.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    long = parts.select("conv_id", *_NUMBERS, "audit", "repaired").mapInArrow(hashed, short.schema)
    return short.unionByName(long)
