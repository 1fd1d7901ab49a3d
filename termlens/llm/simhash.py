"""SimHash near duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 bytes, so
they share at least 5 of their 8 positional bytes. Lists of a single byte in a single
position hold N/256 fingerprints each, far too many to tally at scale, so the index
is kept on groups of four positions: positions are chosen so that any 5 of the 8
contain all four positions of at least one group (``position_groups``). A pair that
reaches the minimum of 5 shared bytes hence meets in some list. In each list the shared
positional bytes of its fingerprints are tallied, pairs with fewer than 5 are passed
over, and the others are verified by their differing bits.

Only distinct fingerprints enter the index, so copies cost nothing. A list gives no
pairs: it gives the links of a spanning tree of each group that it finds, which
carry the same components. A list of up to ``SCAN`` fingerprints is tallied by
scanning; a longer one is searched for every fingerprint at 3 or fewer bits in the
bytes outside the group, which is linear in its length and finds the same links.

Defined results: a null or empty text, or one of white space, has fingerprint zero
and is linked like any other. Rows that repeat a doc_id are each returned, with the
same component if their texts agree. A null doc_id never names a component unless all
of its documents lack one. An empty table gives an empty one; a long text is read by windows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.batches import binary_column, pieces
from termlens.llm.components import components, join_spread
from termlens.llm.shingles import shingle_hashes
from termlens.sources.workspace import materialize

SHINGLE = 3
MOST_BITS = 3
#: Fingerprints of a list that are compared by scanning; longer lists are searched.
SCAN = 100_000


# ---------------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The text's SimHash: a bit is set if it is in over half the shingles' XXH64 (seed 42)."""
    ones, count = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        count += len(hashes)
        for begin in range(0, len(hashes), 4096):
            part = hashes[begin : begin + 4096]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def with_fingerprints(documents: DataFrame, column: str, width: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``) and the fingerprint as a bigint of the same 64 bits."""
    kept = ["doc_id"] if keep is None else keep
    source = documents.select(*kept, F.col("text").cast("binary").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__text"):
            prints = np.array([fingerprint(t, width) for t in binary_column(piece, "__text")], "<u8").view("<i8")
            columns = [piece.column(i) for i in range(piece.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints)], names=[*piece.schema.names[:-1], column])

    return source.mapInArrow(hashed, f"{fields}, {column} bigint")


# ----------------------------------------------------------------------------- index


@lru_cache
def position_groups(shared: int = 5, size: int = 4, positions: int = 8) -> tuple[tuple[int, ...], ...]:
    """Few groups of ``size`` positions such that any ``shared`` positions contain one of them.

    Chosen one by one, each time the group that serves the most sets not served yet.
    """
    open_sets = {frozenset(s) for s in combinations(range(positions), shared)}
    chosen = []
    while open_sets:
        best = max(combinations(range(positions), size), key=lambda g: (sum(s.issuperset(g) for s in open_sets), g))
        chosen.append(best)
        open_sets = {s for s in open_sets if not s.issuperset(best)}
    return tuple(chosen)


def _mask(group: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * position) for position in group)
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(one: np.uint64, others: np.ndarray, most_bits: int) -> np.ndarray:
    """Which of ``others`` share enough positional bytes with ``one`` and are near in bits."""
    differ = others ^ one
    shared = np.zeros(len(others), np.uint8)
    octets = differ.view(np.uint8).reshape(-1, 8)
    for position in range(8):
        shared += octets[:, position] == 0
    near = np.flatnonzero(shared >= 8 - most_bits)
    return near[np.bitwise_count(differ[near]) <= most_bits]


def _neighbours(held: np.ndarray, group: tuple[int, ...], most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places of the sorted ``held``, by looking up every fingerprint at few bits from each."""
    free = [bit for bit in range(64) if bit // 8 not in group]
    for weight in range(1, most_bits + 1):
        for bits in combinations(free, weight):
            wanted = held ^ np.uint64(sum(1 << bit for bit in bits))
            places = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            found = np.flatnonzero(held[places] == wanted)
            yield found, places[found]


def list_links(held: np.ndarray, group: tuple[int, ...], most_bits: int = MOST_BITS, scan: int = SCAN) -> Iterator[tuple[int, int]]:
    """Pairs that join the list's distinct, sorted fingerprints into the same groups as their links do.

    There are fewer pairs than fingerprints. From a scan they are links; from a search
    they join the heads of groups that a link connects.
    """
    if len(held) <= scan:
        waiting = held
        while len(waiting) > 1:
            frontier, waiting = [waiting[0]], waiting[1:]
            while frontier and len(waiting):
                one = frontier.pop()
                near = _linked(one, waiting, most_bits)
                if len(near):
                    found = waiting[near]
                    yield from ((int(one), int(other)) for other in found)
                    frontier.extend(found)
                    waiting = np.delete(waiting, near)
        return
    label = np.arange(len(held))

    def top(places: np.ndarray) -> np.ndarray:
        while True:
            upper = label[places]
            if np.array_equal(upper, places):
                return places
            places = upper

    for ours, theirs in _neighbours(held, group, most_bits):
        left, right = top(ours), top(theirs)
        while len(left):
            apart = left != right
            left, right = np.maximum(left[apart], right[apart]), np.minimum(left[apart], right[apart])
            if not len(left):
                break
            _, first = np.unique(left, return_index=True)
            label[left[first]] = right[first]
            yield from zip(held[left[first]].tolist(), held[right[first]].tolist())
            left, right = top(left), top(right)
        label = top(label)


def fingerprint_links(prints: DataFrame, column: str, most_bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (bigint) in ``column`` at ``most_bits`` or fewer bits."""
    if not 1 <= most_bits <= 3:
        raise ValueError("the index is made for 1 to 3 differing bits")
    groups = position_groups()
    entries = prints.select(
        F.col(column).alias("print"),
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("group"), F.col(column).bitwiseAND(F.lit(_mask(g))).alias("octets")) for n, g in enumerate(groups)])
        ).alias("key"),
    ).select("key.group", "key.octets", "print")
    lists = entries.repartition("group", "octets").sortWithinPartitions("group", "octets")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(lists: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            made = [pair for group, held in lists for pair in list_links(held, groups[group], most_bits)]
            pairs = np.array(made, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        open_key, open_parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            group, octets = (batch.column(n).to_numpy() for n in ("group", "octets"))
            held = batch.column("print").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(octets) != 0)) + 1
            begins, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(held)]
            done = []
            for begin, end in zip(begins, ends):
                key = (int(group[begin]), int(octets[begin]))
                if key != open_key:
                    if len(open_parts) > 1 or open_parts and len(open_parts[0]) > 1:
                        done.append((open_key[0], np.unique(np.concatenate(open_parts))))
                    open_key, open_parts = key, []
                open_parts.append(held[begin:end])
            yield links(done)
        if open_parts:
            yield links([(open_key[0], np.unique(np.concatenate(open_parts)))])

    return lists.mapInArrow(tally, "a bigint, b bigint").distinct()


def _grouped(documents: DataFrame, kept: list[str], width: int, most_bits: int) -> DataFrame:
    """``kept``, __print, __group (one of the group's fingerprints), component_id."""
    rows = materialize(with_fingerprints(documents, "__print", width, kept), "fingerprints")
    distinct = rows.groupBy("__print").agg(F.min("doc_id").alias("__first"))
    groups = components(fingerprint_links(distinct.select("__print"), "__print", most_bits))
    member = distinct.join(groups, F.col("__print") == F.col("node"), "left").select(
        "__print", "__first", F.coalesce("component", "__print").alias("__group")
    )
    member = materialize(member, "members")
    smallest = member.groupBy("__group").agg(F.min("__first").alias("component_id"))
    named = join_spread(member, smallest, "__group", "__print").select("__print", "__group", "component_id")
    return join_spread(rows, named, "__print", "doc_id")


def near_duplicates(documents: DataFrame, width: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint as hex, component_id: the smallest doc_id that links can reach."""
    return _grouped(documents, ["doc_id"], width, most_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("__print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(documents: DataFrame, width: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """The document with the smallest doc_id of each group, with all its columns.

    Groups are found on ids and hashes alone; the texts are shuffled once, to meet the list of rows to
    keep. Rows that agree in doc_id and text are one row, whatever their other columns hold.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    key = [name.alias("__name"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("__text_md5")]
    narrow = documents.select("doc_id", "text", *key)
    found = _grouped(narrow, ["doc_id", "__name", "__text_md5"], width, most_bits)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("__group").agg(F.min(F.struct("__name", "__text_md5")).alias("__kept")).select("__kept.*")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), *key)
    return rows.join(kept, ["__name", "__text_md5"]).dropDuplicates(["__name", "__text_md5"]).select("__row.*")
