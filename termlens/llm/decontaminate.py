"""Benchmark decontamination by Wu-Manber search over words.

A test item's windows of 13 words are the patterns. They are searched in every
document with a shift table over blocks of two words: a block that ends no
pattern tells how far the search may jump; one that does selects, with the window that it ends, the few
patterns to compare directly. Patterns of one length share a table; the short
items (fewer than 13 words) have tables of their own.

The tables are built once, on the driver, as arrays: the items' words, one byte a block hash for the shifts (equal hashes keep
the smaller shift), and for each distinct window a sorted key, its place in the words and its items; some 35 bytes for each word
of an item. They are sent to the tasks for up to ``ITEM_BYTES`` of items. A larger set is searched in several passes over the
stored documents, each with the tables of one part, and the hits of the passes are put together by document; the result is the same.

Defined results: a null or empty text has no words, nothing is hit and it is not
contaminated. A null or empty item has no window. Items of the same text are each
counted; repeated rows of one item count once; an item without an id marks words
but is not counted. Null document ids are kept; rows that repeat a document are each searched. An empty table gives an empty
one. Other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.batches import binary_column, pieces
from termlens.sources.workspace import materialize

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_WORD_IN = 20
#: Largest item set, in bytes of text, whose tables are sent to the tasks at once.
ITEM_BYTES = 48 << 20

_WORD_BYTES = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20
    for byte in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    """Words of digits, letters and bytes above 0x7F, with A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


#: Plain values of one table: window length, shifts, sorted keys, places, ends, first owner of each window, owners.
Table = tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class WuManber:
    """Finds every occurrence of the windows of ``items`` (id or None, text), from tables that can be sent."""

    def __init__(self, words: bytes, ids: list[str], tables: list[Table]) -> None:
        self.words, self.ids, self.tables = words, ids, tables

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], width: int) -> WuManber:
        numbers: dict[str, int] = {}
        parts, size = [], 0
        #: By window length: block hash and shift, key, place, end and owner of each window.
        held: dict[int, tuple[array, ...]] = {}
        for item, text in items:
            found = split_words(text)
            if not found:
                continue
            owner = -1 if item is None else numbers.setdefault(item, len(numbers))
            joined = b" ".join(found)
            starts = list(accumulate([len(w) + 1 for w in found], initial=0))
            length = min(width, len(found))
            blocks, shifts, keys, places, ends, owners = held.setdefault(
                length, (array("I"), array("B"), array("Q"), array("Q"), array("Q"), array("q"))
            )
            for last in range(len(found)):
                begin = starts[max(last - 1, 0)] if length > 1 else starts[last]
                end = starts[last + 1] - 1
                if last or length == 1:
                    block = crc32(joined[begin:end])
                    blocks.append(block)
                    shifts.append(max(0, length - 1 - last))
                if last >= length - 1:
                    first = starts[last - length + 1]
                    keys.append(block << 32 | crc32(joined[first:end]))
                    places.append(size + first)
                    ends.append(size + end)
                    owners.append(owner)
            parts.append(joined)
            size += len(joined)
        words = b"".join(parts)
        return cls(words, list(numbers), [_table(words, length, *columns) for length, columns in sorted(held.items())])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, owners) of each occurrence; an owner is a place in ``ids``, or -1."""
        count = len(words)
        for length, shifts, keys, places, ends, first, owners in self.tables:
            mask, two = len(shifts) - 1, length > 1
            furthest = max(length - 1, 1)
            at = length - 1
            while at < count:
                block = crc32(words[at - 1] + b" " + words[at] if two else words[at])
                shift = shifts[block & mask]
                if shift:
                    at += min(shift, furthest)
                    continue
                window = b" ".join(words[at - length + 1 : at + 1])
                key = block << 32 | crc32(window)
                place = int(np.searchsorted(keys, np.uint64(key)))
                while place < len(keys) and int(keys[place]) == key:
                    if self.words[places[place] : ends[place]] == window:
                        yield at - length + 1, at + 1, owners[first[place] : first[place + 1]]
                    place += 1
                at += 1


def _table(words: bytes, length: int, blocks: array, shifts: array, keys: array, places: array, ends: array, owners: array) -> Table:
    furthest = max(length - 1, 1)
    size = 1 << max(8, (8 * len(blocks)).bit_length())
    by_block = np.full(size, furthest, np.uint8)
    np.minimum.at(by_block, np.frombuffer(blocks, np.uint32) & np.uint32(size - 1), np.frombuffer(shifts, np.uint8))
    key, place, end, owner = (np.frombuffer(c, t) for c, t in zip((keys, places, ends, owners), (np.uint64, np.uint64, np.uint64, np.int64)))
    order = np.lexsort((place, key))
    key, place, end, owner = key[order], place[order], end[order], owner[order]
    # windows of one key are nearly always the same words; where they are not, each keeps its own entry
    same = np.zeros(len(key), bool)
    for at in np.flatnonzero(key[1:] == key[:-1]) + 1:
        same[at] = words[place[at] : end[at]] == words[place[at - 1] : end[at - 1]]
    kept = np.flatnonzero(~same)
    first = np.append(kept, len(key))
    return length, by_block.tobytes(), key[kept], place[kept], end[kept], first, owner.astype(np.int32)


def item_parts(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items, read to the driver row by row, in lists of about ``most`` bytes."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    for item, text in rows.toLocalIterator():
        text = bytes(text or b"")
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text) + 64
    if held:
        yield held


def _hits(rows: DataFrame, kept: list[str], matcher: WuManber) -> DataFrame:
    """``kept`` columns, __n_words, __hits (runs of hit words as begin, end) and __items (ids) of rows with ``__text``."""
    sent = rows.sparkSession.sparkContext.broadcast((matcher.words, matcher.ids, matcher.tables))
    source = rows.select(*kept, F.col("text").cast("binary").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    run = pa.struct([("b", pa.int64()), ("e", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WuManber(*sent.value)
        for batch in pieces(batches, "__text"):
            counts, runs, items = [], [], []
            for text in binary_column(batch, "__text"):
                words = split_words(text)
                mark, found = bytearray(len(words)), set()
                for begin, end, owners in held.search(words):
                    mark[begin:end] = b"\x01" * (end - begin)
                    found.update(owners.tolist())
                counts.append(len(words))
                runs.append([{"b": m.start(), "e": m.end()} for m in re.finditer(b"\x01+", mark)])
                items.append([held.ids[n] for n in found if n >= 0])
            out = [batch.column(i) for i in range(batch.num_columns - 1)]
            out += [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "__n_words", "__hits", "__items"])

    return source.mapInArrow(scan, f"{fields}, __n_words bigint, __hits array<struct<b: bigint, e: bigint>>, __items array<string>")


def _hit_words(runs: Column) -> Column:
    """Words in the union of runs that may overlap."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("words"))

    def add(done: Column, run: Column) -> Column:
        end = F.greatest(done["end"], run["e"])
        return F.struct(end.alias("end"), (done["words"] + end - F.greatest(done["end"], F.least(run["b"], end))).alias("words"))

    return F.aggregate(F.array_sort(runs), start, add, lambda done: done["words"])


def _all_hits(documents: DataFrame, kept: list[str], benchmark: DataFrame, width: int, item_bytes: int) -> DataFrame:
    """``_hits`` of an item set of any size."""
    parts = item_parts(benchmark, item_bytes)
    first = WuManber.of(next(parts, []), width)
    second = next(parts, None)
    if second is None:
        return _hits(documents, kept, first)
    columns = [F.col(f"`{c}`").alias(f"__k{n}") for n, c in enumerate(kept)]
    stored = documents.select(F.monotonically_increasing_id().alias("__id"), *columns, "text")
    # the ids hold once they are stored
    stored = materialize(stored, "searched-documents")
    passes = []
    for matcher in chain([first], (WuManber.of(part, width) for part in chain([second], parts))):
        found = _hits(stored, ["__id"], matcher).where("size(__hits) > 0")
        passes.append(materialize(found.select("__id", "__hits", "__items"), "hits"))
    together = reduce(DataFrame.union, passes).groupBy("__id").agg(
        F.flatten(F.collect_list("__hits")).alias("__hits"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items")
    )
    counted = _hits(stored, ["__id", *[f"__k{n}" for n in range(len(kept))]], WuManber(b"", [], [])).drop("__hits", "__items")
    joined = counted.join(together, "__id", "left")
    named = [F.col(f"__k{n}").alias(c) for n, c in enumerate(kept)]
    nothing = [F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("__hits", "__items")]
    return joined.select(*named, "__n_words", *nothing)


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    one_word_in: int = ONE_WORD_IN,
    item_bytes: int = ITEM_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """doc_id (or the columns ``keep``), n_words, n_hit, n_items, items_sha256, contaminated.

    ``documents`` has doc_id and text, ``benchmark`` item_id and text.
    """
    kept = ["doc_id"] if keep is None else keep
    found = _all_hits(documents, kept, benchmark, width, item_bytes)
    # a text without a hit, nearly all of them, needs no sum
    found = found.withColumn("__n_hit", F.when(F.size("__hits") == 0, 0).otherwise(_hit_words(F.col("__hits"))).cast("bigint"))
    hit, words = F.col("__n_hit"), F.col("__n_words")
    return found.select(
        *[F.col(f"`{c}`") for c in kept],
        words.alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * one_word_in >= words)).alias("contaminated"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    marked = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), "text")
    found = contamination(marked, benchmark, width, keep=["__row"])
    return found.where(~F.col("contaminated")).select("__row.*")
