"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles of five
words. Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles. A text of fewer than k distinct shingles
is held in full, so its estimates are exact.

Words are runs of bytes other than ASCII white space, with A-Z in lower case. A text of
fewer than five words has one shingle, the whole sequence; one without words, null and
empty texts among them, has an empty sketch. Two empty sketches are alike (1), an empty
and another one are not (0). Equal texts have equal sketches. Rows that repeat a doc_id are each fingerprinted; an
empty table gives an empty one; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termlens.llm.batches import pieces
from termlens.llm.shingles import text_windows
from termlens.sources.workspace import materialize

SHINGLE = 5
SIZE = 128

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < length:
        held = 1 << max(16, length.bit_length())
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(held, b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every shingle, repeats included."""
    data = np.frombuffer(text.lower(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=sums[1:])
    # the word's hash wherever it stands: its sum, moved back to place 0
    words = _mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    taken = min(width, len(words))
    hashes = words[taken - 1 :].copy()
    factor = 1
    for back in range(1, taken):
        factor = factor * _STEP % 2**64
        hashes += words[taken - 1 - back : len(words) - back] * np.uint64(factor)
    return _mixed(hashes)


def sketch(text: bytes, width: int = SHINGLE, size: int = SIZE) -> np.ndarray:
    """The text's sketch; a long text is read by windows, whose sketches merge."""
    kept, carried, found = np.zeros(0, np.uint64), b"", False
    for window in text_windows(text):
        part = carried + b" " + window if carried else window
        if len(part.split(None, width - 1)) < width:
            carried = part
            continue
        found = True
        kept = merged(kept, np.unique(shingle_hashes(part, width))[:size], size)
        # the words that shingles of the next window begin with
        carried = b" ".join(part.rsplit(None, width - 1)[1:])
    return kept if found else np.unique(shingle_hashes(carried, width))[:size]


def merged(one: np.ndarray, other: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of the shingles of both."""
    return np.union1d(one, other)[:size]


def resemblance(one: np.ndarray, other: np.ndarray, size: int = SIZE) -> float:
    """Shared shingles over all shingles of both: the share of the merged sketch that both hold."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    both = merged(one, other, size)
    return float(np.isin(both, one[np.isin(one, other, assume_unique=True)], assume_unique=True).sum() / len(both))


def distinct_shingles(one: np.ndarray, size: int = SIZE) -> float:
    """Exact below ``size``; above, from how dense the kept hashes lie."""
    return float(len(one)) if len(one) < size else (size - 1) / ((float(one[-1]) + 1) / 2.0**64)


def containment(one: np.ndarray, other: np.ndarray, size: int = SIZE) -> float:
    """The share of the first one's shingles that the other has as well, from 0 to 1."""
    if not len(one):
        return 1.0
    shared = resemblance(one, other, size) * distinct_shingles(merged(one, other, size), size)
    return min(1.0, shared / distinct_shingles(one, size))


def to_text(one: np.ndarray) -> str:
    """The sketch as hex digits, 16 a hash, ascending."""
    return one.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def document_sketches(documents: DataFrame, width: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """doc_id, fingerprint, distinct_shingles (estimated)."""
    source = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            held = [sketch(text or b"", width, size) for text in piece.column("text").to_pylist()]
            columns = [piece.column("doc_id"), pa.array(map(to_text, held), pa.string())]
            columns.append(pa.array([distinct_shingles(s, size) for s in held], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "distinct_shingles"])

    return source.mapInArrow(made, f"doc_id {kind}, fingerprint string, distinct_shingles double")


# ----------------------------------------------------- next to the text that follows


#: Room for the parts of one id between the numbers of two ranges.
_PARTS_OF_AN_ID = 1 << 20


def _dealt_in_order(documents: DataFrame) -> DataFrame:
    """part, doc_id, tie, text, last: parts are ranges of doc_id, and each part ends with a copy
    (last = true) of the row that follows its own last one; after all rows comes the first.

    Part bounds are quantiles of doc_id, as many as there are shuffle partitions. A null
    doc_id comes first; such rows, and rows that repeat a doc_id, are in the order of a hash
    of their text. An id with more rows than a part should have is cut by quantiles of that hash; only rows that agree
    in id and text stay together.
    """
    spark = documents.sparkSession
    count = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    shares = [i / count for i in range(1, count)]
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    bounds = ids.agg(F.percentile_approx("doc_id", shares, 20 * count)).first()[0] or []
    total = ids.count()
    often = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * count > 2 * total)
    # fewer ids than there are parts
    hot = [r.doc_id for r in often.collect()]
    ends = [float(e) for i in hot if i is not None for e in (i, i + 1)]
    splits = [-float("inf"), *sorted({0.0, *map(float, bounds), *ends}), float("inf")]
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(0)).cast("double"))
    rows = Bucketizer(splits=splits, inputCol="id", outputCol="range").transform(rows)
    inside = F.lit(0)
    if hot:
        is_hot = F.col("doc_id").isin([i for i in hot if i is not None])
        is_hot = F.coalesce(is_hot, F.lit(False)) | (F.col("doc_id").isNull() if None in hot else F.lit(False))
        cuts = rows.where(is_hot).groupBy("doc_id").agg(F.percentile_approx("tie", shares, 20 * count).alias("cuts"))
        cuts = F.broadcast(materialize(cuts.withColumnRenamed("doc_id", "hot_id"), "hot-ids"))
        rows = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("hot_id")) & is_hot, "left")
        passed = F.size(F.filter(F.array_distinct("cuts"), lambda cut: cut <= F.col("tie")))
        inside = F.when(F.col("cuts").isNull(), 0).otherwise(passed)
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("range")).cast("bigint") * _PARTS_OF_AN_ID + inside
    rows = rows.select(place.alias("part"), "doc_id", "tie", "text")
    # the first row of each part, one row per part: first the smallest ids, then their texts
    firsts = materialize(rows.groupBy("part").agg(F.min("doc_id").alias("first_id")), "firsts")
    following = Window.orderBy("part")
    ring = firsts.agg(F.min("part").alias("ring"))
    before = firsts.crossJoin(F.broadcast(ring)).select(
        F.col("part").alias("head_part"),
        "first_id",
        F.lag("part").over(following).alias("before"),
        F.max("part").over(Window.orderBy("ring")).alias("end"),
    )
    before = materialize(before.select("head_part", "first_id", F.coalesce("before", "end").alias("before")), "firsts")
    same = (F.col("part") == F.col("head_part")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    heads = rows.join(F.broadcast(before), same)
    heads = heads.groupBy("before").agg(F.min_by("text", "tie").alias("text"))
    heads = heads.select(F.col("before").alias("part"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("tie"), "text")
    dealt = rows.withColumn("last", F.lit(False)).unionByName(heads.withColumn("last", F.lit(True)))
    return dealt.repartition("part").sortWithinPartitions("part", "last", F.asc_nulls_first("doc_id"), "tie")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints_with_edits(documents: DataFrame, width: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """Each document's fingerprint next to its edited text's and the following document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    distinct_shingles, contained_in_edited.
    """
    columns = {
        "doc_id": pa.int64(),
        "n_chars": pa.int64(),
        "edited_sha256": pa.string(),
        "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(),
        "near_edited": pa.float64(),
        "near_next": pa.float64(),
        "distinct_shingles": pa.float64(),
        "contained_in_edited": pa.float64(),
    }

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the one that follows
        for piece in pieces(batches, "text"):
            made = []
            for doc_id, text, last in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "last"))):
                own = sketch(text.encode(), width, size)
                if held is not None:
                    held_id, held_text, held_sketch = held
                    changed = edited(held_text, text).encode()
                    other = sketch(changed, width, size)
                    made.append(
                        (
                            held_id,
                            len(held_text),
                            hashlib.sha256(changed).hexdigest(),
                            to_text(held_sketch),
                            to_text(other),
                            resemblance(held_sketch, other, size),
                            resemblance(held_sketch, own, size),
                            distinct_shingles(held_sketch, size),
                            containment(held_sketch, other, size),
                        )
                    )
                held = None if last else (doc_id, text, own)
            cells = zip(*made) if made else [()] * len(columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(cells, columns.values())], names=list(columns)
            )

    schema = ", ".join(f"{n} {'bigint' if k == pa.int64() else 'double' if k == pa.float64() else 'string'}" for n, k in columns.items())
    return _dealt_in_order(documents).select("doc_id", "text", "last").mapInArrow(compared, schema)
