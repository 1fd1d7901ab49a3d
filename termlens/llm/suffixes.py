"""Suffix-array dedup: removal of long byte strings that stand in earlier documents.

A byte goes if it lies in a string of ``LENGTH`` (50) bytes that also starts in a document with a
smaller doc_id. Work is on whole texts as UTF-8 bytes, and no string crosses documents.

**Index.** Only sampled suffixes are kept: of the suffixes whose first ``SEED`` (24) bytes lie in a
string, the one whose seed has the smallest hash (the leftmost of equals) stands for the string.
The choice depends on the string's bytes alone, so equal strings have the same sampled suffix at the
same place. A suffix array orders them by their first three bytes, then by a fingerprint of the
seed. Arrays are dealt over buckets by a hash, and a bucket's array is packed bytes in one row.

**Logarithmic family.** The corpus arrives in batches of ascending doc_id. A batch's arrays are sorted
and merge-scanned against the array of every level; a seed that was met before is reported to the
chunks of texts that hold it, old and new. Then the batch and all levels of its size merge, like the
digits of a binary counter, so a seed is rewritten once per level. Seeds of one text only, most
of all, go no further.

**Long matches.** The chunks send the strings around their reported seeds, each distinct one once with its
first document, to buckets by seed. There all strings of 50 bytes are compared with each
other: by hash, then byte by byte. What comes back is, for each sent string, at which places an earlier
document has the same 50 bytes. A seed whose strings could exceed ``HOT_BYTES``, by the counts of its places, goes to no bucket:
chunks send the md5 of each distinct place of 50 bytes in its strings, and a grouping, combined before the shuffle,
finds the first document of each.

Equal texts are one text with their first doc_id before all this, combined before the shuffle, so a group
of copies of any size sends its text once per task; the same holds for lines and passages, of which a
chunk sends one. Chunks are a stored, bucketed table, so seeds and matches travel to the
texts, not the texts to them.

Defined results: null is an empty text, n_bytes 0. A null doc_id counts as the largest bigint. Rows that
repeat a doc_id do not shorten each other. Texts below 50 bytes stay. An empty table gives an empty one. Other columns are
not looked at. ``suffix_index`` keeps such a family in a folder and adds further batches to it.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.batches import binary_column, pieces
from termlens.llm.components import join_spread
from termlens.sources.workspace import materialize, new_folder, remove

LENGTH = 50
SEED = 24
BATCHES = 4
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 6 << 20
#: Most bytes of one seed's strings in a bucket.
HOT_BYTES = 16 << 20
#: Bytes hashed at once inside a chunk.
PIECE = 1 << 20

_TABLE = "termlens_chunks_"
_tables: list[str] = []
_BASE = 0x9E3779B97F4A7C15
_LAST = np.iinfo(np.int64).max
_REACH = LENGTH - SEED
_NONE = np.zeros(0, np.uint64)


# --------------------------------------------------------------- hashing and sampling


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of the ``width`` bytes from every place, by doubling."""
    power = data.astype(np.uint64) + np.uint64(1)
    reach, out, done = 1, None, 0
    while True:
        if width & reach:
            if out is None:
                out, done = power, reach
            else:
                count = len(data) - done - reach + 1
                out = out[:count] * np.uint64(pow(_BASE, reach, 1 << 64)) + power[done : done + count]
                done += reach
        if done == width:
            return out
        count = len(power) - reach
        power = power[:count] * np.uint64(pow(_BASE, reach, 1 << 64)) + power[reach:]
        reach *= 2


def sampled(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of places whose strings have the same sampled suffix, piece by piece of the texts.

    Yields number of the first text, the piece's bytes, and for each run its text, begin, number
    of places, and key. The key is the suffix's first three bytes and 40 bits of its seed's hash.
    """
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= PIECE:
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[begin:end]])
        joined = b"".join(texts[begin:end])
        if size >= LENGTH and (lengths >= LENGTH).any():
            data = np.frombuffer(joined, np.uint8)
            owner = np.repeat(np.arange(end - begin, dtype=np.int32), lengths)
            seeds = _mixed(rolling(data, SEED))
            ranked = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
            width = 1
            while 2 * width <= _REACH + 1:
                ranked = np.minimum(ranked[:-width], ranked[width:])
                width *= 2
            rest = _REACH + 1 - width
            ranked = np.minimum(ranked[: len(ranked) - rest], ranked[rest:]) if rest else ranked
            places = np.flatnonzero(owner[: len(data) - LENGTH + 1] == owner[LENGTH - 1 :])
            chosen = (ranked[places] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
            at, suffix = places[first], chosen[first]
            head = (data[suffix].astype(np.uint64) << np.uint64(16)) | (data[suffix + 1].astype(np.uint64) << np.uint64(8)) | data[suffix + 2]
            keys = (head << np.uint64(40)) | (seeds[suffix] >> np.uint64(24))
            yield begin, joined, owner[at], at, np.diff(np.r_[first, len(places)]), keys
        begin = end


def _bucket(keys: np.ndarray, count: int) -> np.ndarray:
    return (_mixed(keys) >> np.uint64(20)) % np.uint64(count)


def _by_bucket(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has something, and what: places in ``place``, ascending."""
    order = np.argsort(place, kind="stable")
    numbers, begins = np.unique(place[order], return_index=True)
    for number, some in zip(numbers.tolist(), np.split(order, begins[1:])):
        yield number, some


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as byte planes of their differences: most planes are zeros, which compress away."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _pack_numbers(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


# --------------------------------------------------------------------- index family


def merge_scan(
    batch: list[tuple[int, np.ndarray]], levels: list[tuple[int, np.ndarray, np.ndarray]], merging: int
) -> tuple[list[tuple[int, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Scan a batch's arrays (chunk, keys) against levels (level, keys, one chunk for each key).

    Returns the keys to report to each chunk, and the array of the batch merged with all
    levels below ``merging``.
    """
    keys = np.concatenate([k for _, k in batch])
    chunks = np.repeat(np.array([c for c, _ in batch], np.int32), [len(k) for _, k in batch])
    order = np.argsort(keys, kind="stable")
    keys, chunks = keys[order], chunks[order]
    again = np.r_[False, keys[1:] == keys[:-1]]
    met = again | np.r_[again[1:], False]
    reported = []
    for _, held, owners in levels:
        place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        same = held[place] == keys
        met |= same
        reported.append((owners[place[same]], keys[same]))
    reported.append((chunks[met], keys[met]))
    who, what = np.concatenate([w for w, _ in reported]), np.concatenate([k for _, k in reported])
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    fresh = np.r_[True, (who[1:] != who[:-1]) | (what[1:] != what[:-1])] if len(who) else np.zeros(0, bool)
    who, what = who[fresh], what[fresh]
    cuts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]).tolist() if len(who) else []
    told = [(int(who[b]), what[b:e]) for b, e in zip(cuts, [*cuts[1:], len(who)])]
    parts = [(keys[~again], chunks[~again])] + [(k, c) for level, k, c in levels if level < merging]
    if len(parts) > 1:
        keys, chunks = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        keys, first = np.unique(keys, return_index=True)
        return told, (keys, chunks[first])
    return told, parts[0]


_FOUND = "kind int, level int, bucket int, chunk int, keys binary, owners binary"


def _found(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 2
    names = ["kind", "level", "bucket", "chunk", "keys", "owners"]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def chunk_arrays(texts: DataFrame, buckets: int, often: int | None = None) -> DataFrame:
    """level (-1), bucket, chunk, keys: each chunk's distinct sampled suffixes, dealt over buckets.

    Rows of level -2 hold those with more than ``often`` strings in the chunk, and how many.
    """

    def arrays(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        held = [np.unique(keys, return_counts=True) for *_, keys in sampled(table.column("text").to_pylist())]
        rows = []
        if held:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)
            for number, some in _by_bucket(_bucket(keys, buckets)):
                rows.append((1, -1, number, chunk, pack(keys[some]), b""))
                many = some[counts[some] > often] if often is not None else some[:0]
                if len(many):
                    rows.append((1, -2, number, chunk, pack(keys[many]), _pack_numbers(counts[many])))
        return _found(rows)

    return texts.select("chunk", "text").groupBy("chunk").applyInArrow(arrays, _FOUND)


def add_batch(
    arrays: DataFrame, levels: dict[int, str], number: int, path: str | None = None
) -> tuple[DataFrame, dict[int, str], str]:
    """Scan batch ``number`` (from 1) against the levels and merge: reports, new levels, the stored step."""
    spark = arrays.sparkSession
    merging = (number & -number).bit_length() - 1
    rows = arrays
    for held in levels.values():
        rows = rows.unionByName(spark.read.schema(_FOUND).parquet(held).where("kind = 1"))

    def scan(table: pa.Table) -> pa.Table:
        bucket, batch, held, counted = table.column("bucket")[0].as_py(), [], [], []
        cells = zip(*(table.column(n).to_pylist() for n in ("level", "chunk", "keys", "owners")))
        for level, chunk, keys, owners in cells:
            if level == -2:
                counted.append((2, level, bucket, chunk, keys, owners))
            elif level < 0:
                batch.append((chunk, unpack(keys)))
            else:
                held.append((level, unpack(keys), _numbers(owners)))
        if not batch:
            keys, owners = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            parts = [(k, o) for level, k, o in held if level < merging]
            if not parts:
                return _found([])
            keys, first = np.unique(np.concatenate([k for k, _ in parts]), return_index=True)
            told, merged = [], (keys, np.concatenate([o for _, o in parts])[first])
        else:
            told, merged = merge_scan(batch, held, merging)
        out = [(0, merging, bucket, chunk, pack(keys), b"") for chunk, keys in told]
        return _found([*out, *counted, (1, merging, bucket, -1, pack(merged[0]), _pack_numbers(merged[1]))])

    path = path or new_folder(spark, "suffixes")
    rows.groupBy("bucket").applyInArrow(scan, _FOUND).write.mode("overwrite").partitionBy("kind").parquet(path)
    following = {level: p for level, p in levels.items() if level >= merging}
    following[merging] = path
    return spark.read.schema(_FOUND).parquet(path).where("kind = 0").select("chunk", "keys"), following, path


def hot_seeds(spark: SparkSession, paths: list[str], least: int) -> np.ndarray:
    """Seeds with at least ``least`` strings, by the counts in the stored steps.

    At most one for every ``least`` strings of 50 bytes and more of the corpus: 8 bytes on the driver for some 5 MB of text.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("owners").to_pylist()):
                columns = [pa.array(unpack(keys).view(np.int64)), pa.array(_numbers(counts).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "strings"])

    counted = [spark.read.schema(_FOUND).parquet(p).where("kind = 2").select("keys", "owners") for p in paths]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    seeds = rows.mapInArrow(single, "key bigint, strings bigint").groupBy("key").agg(F.sum("strings").alias("strings"))
    return np.sort(seeds.where(F.col("strings") >= least).select("key").toArrow().column("key").to_numpy().view(np.uint64))


# ---------------------------------------------------------------------- long matches


class Candidates:
    """The distinct strings around a chunk's reported seeds, and where they stand in its texts."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, reported: np.ndarray):
        keys, owners, begins, counts, prints, parts = [], [], [], [], [], []
        every = list(sampled(texts))
        if every:
            # seeds of two documents of the chunk count as reported too
            key, doc = np.concatenate([k for *_, k in every]), np.concatenate([docs[first + o] for first, _, o, *_ in every])
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            reported = np.union1d(reported, key[1:][(key[1:] == key[:-1]) & (doc[1:] != doc[:-1])])
        for first, joined, owner, at, count, key in every:
            place = np.minimum(np.searchsorted(reported, key), len(reported) - 1) if len(reported) else None
            chosen = np.flatnonzero(reported[place] == key) if place is not None else np.zeros(0, np.int64)
            starts = np.r_[0, np.cumsum([len(t) for t in texts[first : first + int(owner[-1]) + 1]])]
            keys.append(key[chosen])
            owners.append(owner[chosen] + first)
            counts.append(count[chosen])
            begins.append(at[chosen] - starts[owner[chosen]])
            parts.append([joined[b : b + c + LENGTH - 1] for b, c in zip(at[chosen].tolist(), count[chosen].tolist())])
        join = lambda arrays, kind: np.concatenate(arrays) if arrays else np.zeros(0, kind)
        self.owners, self.begins, self.counts = join(owners, np.int64), join(begins, np.int64), join(counts, np.int64)
        strings = [s for part in parts for s in part]
        number: dict[bytes, int] = {}
        self.number = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
        self.strings = list(number)
        doc = docs[self.owners] if len(strings) else np.zeros(0, np.int64)
        self.first = np.full(len(number), _LAST)
        np.minimum.at(self.first, self.number, doc)
        self.later = doc > self.first[self.number] if len(strings) else np.zeros(0, bool)
        self.keys = np.zeros(len(number), np.uint64)
        self.keys[self.number] = join(keys, np.uint64)


_SENT = "bucket int, chunk int, numbers binary, sizes binary, docs binary, strings binary"


def _reported(table: pa.Table) -> np.ndarray:
    held = [unpack(k) for k in table.column("keys").to_pylist() if k is not None]
    return np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)


def _chunk_columns(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    table = table.sort_by([("first", "ascending"), ("name", "ascending")])
    return table.column("text").to_pylist(), table.column("first").to_numpy()


def send_strings(texts: DataFrame, reports: DataFrame, buckets: int, hot: np.ndarray = _NONE) -> DataFrame:
    def send(chunk: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if chunk.num_rows:
            found = Candidates(*_chunk_columns(chunk), _reported(told))
            place = np.where(np.isin(found.keys, hot), np.uint64(buckets), _bucket(found.keys, buckets))
            for number, some in _by_bucket(place):
                if number == buckets:
                    continue
                strings = [found.strings[i] for i in some.tolist()]
                rows.append(
                    (
                        number,
                        chunk.column("chunk")[0].as_py(),
                        _pack_numbers(some),
                        np.array([len(s) for s in strings], np.uint8).tobytes(),
                        np.ascontiguousarray(found.first[some].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(),
                        b"".join(strings),
                    )
                )
        kinds = [pa.int32()] * 2 + [pa.binary()] * 4
        names = ["bucket", "chunk", "numbers", "sizes", "docs", "strings"]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return texts.groupBy("chunk").cogroup(reports.groupBy("chunk")).applyInArrow(send, _SENT)


def covered_places(sizes: np.ndarray, docs: np.ndarray, joined: bytes) -> np.ndarray:
    """For each string, a bit mask of the places whose 50 bytes stand in a string of a smaller document."""
    data = np.frombuffer(joined, np.uint8)
    counts = sizes.astype(np.int64) - LENGTH + 1
    starts = np.r_[0, np.cumsum(sizes.astype(np.int64))[:-1]]
    string = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(len(string)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    place = starts[string] + offset
    hashes = rolling(data, LENGTH)[place]
    doc = docs[string]
    order = np.lexsort((doc, hashes))
    sorted_hashes = hashes[order]
    new = np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]]
    group = np.cumsum(new) - 1
    leader = order[np.flatnonzero(new)][group]
    later = doc[order] > doc[leader]
    ours, theirs = order[later], leader[later]
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    equal = np.ones(len(ours), bool)
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        equal &= words[place[ours] + at] == words[place[theirs] + at]
    for one in np.flatnonzero(~equal).tolist():
        # different bytes of one hash: look through the whole group
        here = place[ours[one]]
        mine = joined[here : here + LENGTH]
        members = order[np.searchsorted(sorted_hashes, hashes[ours[one]], "left") : np.searchsorted(sorted_hashes, hashes[ours[one]], "right")]
        equal[one] = any(joined[place[m] : place[m] + LENGTH] == mine and doc[m] < doc[ours[one]] for m in members)
    masks = np.zeros(len(sizes), np.int64)
    np.add.at(masks, string[ours[equal]], np.int64(1) << offset[ours[equal]])
    return masks


_ANSWER = "chunk int, numbers binary, masks binary"


def answer(sent: DataFrame) -> DataFrame:
    def compare(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(n).to_pylist() for n in ("chunk", "numbers", "sizes", "docs", "strings"))))
        sizes = [np.frombuffer(r[2], np.uint8) for r in rows]
        docs = [np.ascontiguousarray(np.frombuffer(r[3], np.uint8).reshape(8, -1).T).view("<i8").reshape(-1) for r in rows]
        masks = covered_places(np.concatenate(sizes), np.concatenate(docs), b"".join(r[4] for r in rows))
        out, at = [], 0
        for chunk, numbers, own, _, _ in rows:
            held = masks[at : at + len(own)]
            at += len(own)
            some = np.flatnonzero(held)
            if len(some):
                out.append((chunk, _pack_numbers(_numbers(numbers)[some]), _pack_numbers(held[some])))
        return pa.table(
            {
                "chunk": pa.array([r[0] for r in out], pa.int32()),
                "numbers": pa.array([r[1] for r in out], pa.binary()),
                "masks": pa.array([r[2] for r in out], pa.binary()),
            }
        )

    return sent.groupBy("bucket").applyInArrow(compare, _ANSWER)


def places_of(found: Candidates, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """String, offset and number of each place in the strings of hot seeds; by number the md5 (two words) and the first document."""
    chosen = np.flatnonzero(np.isin(found.keys, hot))
    counts = np.array([len(found.strings[i]) - LENGTH + 1 for i in chosen.tolist()], np.int64)
    digests = bytearray()
    for one, count in zip(chosen.tolist(), counts.tolist()):
        held = found.strings[one]
        for at in range(count):
            digests += hashlib.md5(held[at : at + LENGTH]).digest()
    string = np.repeat(chosen, counts)
    offset = np.arange(len(string)) - np.repeat(np.r_[0, np.cumsum(counts)][:-1], counts)
    words = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
    number, words, first = _least(words, found.first[string])
    return string, offset, number, words, first


def _least(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each pair of words among the distinct ones, the distinct ones, and the smallest document of each."""
    order = np.lexsort((words[:, 1], words[:, 0]))
    sorted_words = words[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_words[1:] != sorted_words[:-1]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.full(int(new.sum()), _LAST)
    np.minimum.at(first, number, docs)
    return number, sorted_words[new], first


def answer_hot(texts: DataFrame, reports: DataFrame, hot: np.ndarray) -> DataFrame:
    """chunk, windows: places of hot seeds' strings (md5, first document) whose first document is in another chunk."""

    def send(chunk: pa.Table, told: pa.Table) -> pa.Table:
        words, first = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        number = 0
        if chunk.num_rows:
            number = chunk.column("chunk")[0].as_py()
            *_, words, first = places_of(Candidates(*_chunk_columns(chunk), _reported(told)), hot)
        chunks = pa.array(np.full(len(first), number, np.int32))
        columns = [chunks, *(pa.array(np.ascontiguousarray(words[:, n])) for n in (0, 1)), pa.array(first)]
        return pa.table(columns, names=["chunk", "one", "two", "first"])

    def packed(table: pa.Table) -> pa.Table:
        data = np.stack([table.column(n).to_numpy() for n in ("one", "two", "least")], axis=1).astype("<i8").tobytes()
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "windows": pa.array([data], pa.binary())})

    sent = texts.groupBy("chunk").cogroup(reports.groupBy("chunk")).applyInArrow(send, "chunk int, one bigint, two bigint, first bigint")
    sent = materialize(sent, "windows")
    least = sent.groupBy("one", "two").agg(F.min("first").alias("least"))
    earlier = sent.join(least, ["one", "two"]).where("least < first").select("chunk", "one", "two", "least")
    return earlier.groupBy("chunk").applyInArrow(packed, "chunk int, windows binary")


def hot_masks(found: Candidates, hot: np.ndarray, told: list[bytes]) -> np.ndarray:
    """The masks of ``covered_places`` for the strings of hot seeds, 0 for all others."""
    string, offset, number, words, first = places_of(found, hot)
    answers = np.frombuffer(b"".join(told), "<i8").reshape(-1, 3)
    place, _, least = _least(np.concatenate([words, answers[:, :2]]), np.concatenate([first, answers[:, 2]]))
    later = np.flatnonzero(least[place[: len(words)]][number] < found.first[string])
    masks = np.zeros(len(found.strings), np.int64)
    np.add.at(masks, string[later], np.int64(1) << offset[later])
    return masks


def removed_spans(size: int, begins: np.ndarray) -> np.ndarray:
    """Maximal runs of removed bytes [begin, end) from the places whose 50 bytes go."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + LENGTH, -1)
    inside = np.r_[0, np.cumsum(steps[:-1]) > 0, 0].astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    return edges.reshape(-1, 2)


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.reshape(-1).tolist(), len(text)]
    return b"".join(text[b:e] for b, e in zip(edges[::2], edges[1::2]))


def cut_texts(texts: DataFrame, told: DataFrame, hot: np.ndarray = _NONE) -> DataFrame:
    """name, first, spans, kept_sha256 of each distinct text, from reports and answers by chunk."""

    def cut(chunk: pa.Table, told: pa.Table) -> pa.Table:
        out = {"name": [], "first": [], "spans": [], "kept_sha256": []}
        if chunk.num_rows:
            chunk = chunk.sort_by([("first", "ascending"), ("name", "ascending")])
            texts, docs = _chunk_columns(chunk)
            found = Candidates(texts, docs, _reported(told))
            masks = np.zeros(len(found.strings), np.int64)
            for numbers, held in zip(told.column("numbers").to_pylist(), told.column("masks").to_pylist()):
                if numbers is not None:
                    masks[_numbers(numbers)] = _numbers(held)
            if len(hot):
                masks |= hot_masks(found, hot, [w for w in told.column("windows").to_pylist() if w is not None])
            # a string that an earlier text of the chunk has too goes as a whole
            whole = (np.int64(1) << found.counts) - 1
            mine = np.where(found.later, whole, masks[found.number] if len(masks) else 0)
            places = [[] for _ in texts]
            string = np.flatnonzero(mine)
            for offset in range(_REACH + 1):
                hit = string[(mine[string] >> offset) & 1 == 1]
                for owner, begin in zip(found.owners[hit].tolist(), (found.begins[hit] + offset).tolist()):
                    places[owner].append(begin)
            for text, begins in zip(texts, places):
                spans = removed_spans(len(text), np.array(begins, np.int64)) if begins else np.zeros((0, 2), np.int64)
                out["spans"].append([{"begin": b, "end": e} for b, e in spans.tolist()])
                out["kept_sha256"].append(hashlib.sha256(kept_bytes(text, spans)).hexdigest())
            out["name"], out["first"] = chunk.column("name").to_pylist(), docs.tolist()
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        kinds = {"name": pa.string(), "first": pa.int64(), "spans": pa.list_(span), "kept_sha256": pa.string()}
        return pa.table({n: pa.array(out[n], k) for n, k in kinds.items()})

    schema = "name string, first bigint, spans array<struct<begin:bigint,end:bigint>>, kept_sha256 string"
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cut, schema)


# ------------------------------------------------------------------------- the operator


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text travels once per task, with its md5; its copies send the md5 and, where smaller, their doc_id."""
    smallest: dict[bytes, int] = {}
    for piece in pieces(batches, "text"):
        names, firsts, texts = [], [], []
        for doc, text in zip(piece.column("doc_id").to_pylist(), binary_column(piece, "text")):
            name, doc = hashlib.md5(text).digest(), _LAST if doc is None else doc
            known = smallest.get(name)
            if known is None or doc < known:
                smallest[name] = doc
                names.append(name.hex())
                firsts.append(doc)
                texts.append(text if known is None else None)
        columns = [pa.array(names, pa.string()), pa.array(firsts, pa.int64()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["name", "first", "text"])


def stored_chunks(documents: DataFrame, batches: int, chunk_bytes: int) -> tuple[str, int]:
    """Distinct texts (batch, chunk, first, name, text) as a table bucketed by chunk; their bytes before that."""
    spark = documents.sparkSession
    size, *bounds = documents.agg(
        F.sum(F.octet_length("text")), F.percentile_approx("doc_id", [n / batches for n in range(1, batches)], 10_000)
    ).first()
    size, bounds = size or 0, sorted(set(bounds[0] or []))
    chunks = max(1, -(-size // chunk_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _first_in_task, "name string, first bigint, text binary"
    )
    chunk = F.pmod(F.xxhash64("name"), F.lit(chunks)).cast("int")
    # one exchange: the grouping and the buckets both follow the chunk
    dealt = sent.withColumn("chunk", chunk).repartition(parts, "chunk")
    distinct = dealt.groupBy("chunk", "name").agg(F.min("first").alias("first"), F.max("text").alias("text"))
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (F.col("first") > bound).cast("int")
    name = f"{_TABLE}{uuid.uuid4().hex}"
    _tables.append(name)
    rows = distinct.select(batch.alias("batch"), "chunk", "first", "name", "text")
    rows.write.bucketBy(parts, "chunk").option("path", new_folder(spark, "chunks")).saveAsTable(name)
    return name, size


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted: the context cleaner does it when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_chunks(spark: SparkSession) -> None:
    """Take the bucketed tables of this process's earlier calls out of the catalog, once their results are written."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")


def matched(
    texts: DataFrame, reports: DataFrame, buckets: int, hot: np.ndarray, cut: DataFrame | None = None
) -> DataFrame:
    """name, first, spans, kept_sha256 of the texts (of ``cut``, if given) by the strings at reported seeds.

    The answers are stored, so a lost executor does not cost the exchange of the strings again.
    """
    answers = materialize(answer(send_strings(texts, reports, buckets, hot)), "answers")
    release_shuffles(texts.sparkSession)
    empty = F.lit(None).cast("binary")
    told = reports.select("chunk", "keys", empty.alias("numbers"), empty.alias("masks")).unionByName(
        answers.select("chunk", empty.alias("keys"), "numbers", "masks")
    )
    if len(hot):
        windows = materialize(answer_hot(texts, reports, hot), "windows")
        told = told.unionByName(windows, allowMissingColumns=True)
    return cut_texts(texts if cut is None else cut, told, hot)


def by_document(source: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans, kept_sha256 of all rows of ``source`` (doc_id, text) from those of their distinct texts."""
    name = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = source.select("doc_id", name.alias("name"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    joined = join_spread(rows, results, "name", "doc_id")
    copy = (F.coalesce("doc_id", F.lit(_LAST)) > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n_bytes").alias("end")))
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def duplicated_spans(
    documents: DataFrame,
    batches: int = BATCHES,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes [begin, end)), kept_sha256 of documents (doc_id, text)."""
    spark: SparkSession = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    name, size = stored_chunks(source, batches, chunk_bytes)
    texts = spark.table(name)
    release_shuffles(spark)
    buckets = max(1, -(-size // bucket_bytes))
    # a string has at most LENGTH + _REACH bytes; what a chunk does not count adds up to half the bound at most
    most = hot_bytes // (2 * (LENGTH + _REACH))
    often = most // (batches * max(1, -(-size // chunk_bytes)))
    levels: dict[int, str] = {}
    reports = None
    steps: list[str] = []
    every: list[str] = []
    for number in range(1, batches + 1):
        arrays = chunk_arrays(texts.where(F.col("batch") == number - 1), buckets, often)
        found, levels, path = add_batch(arrays, levels, number)
        for old in [s for s in steps if s not in levels.values()]:
            remove(spark, f"{old}/kind=1")
            steps.remove(old)
        steps.append(path)
        reports = found if reports is None else reports.unionByName(found)
        every.append(path)
        release_shuffles(spark)
    texts = texts.drop("batch")
    reports = materialize(reports, "reports")
    hot = hot_seeds(spark, every, most)
    # this call's index has done its work
    for path in every:
        remove(spark, path)
    release_shuffles(spark)
    return by_document(source, matched(texts, reports, buckets, hot))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from ``duplicated_spans``."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, span: total + span["end"] - span["begin"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
