"""Token ids in files of bit-plane shuffled blocks.

A shard holds the ids of a run of whole documents. Its ids, one after another as
unsigned 32-bit integers, are cut into blocks of ``BLOCK`` ids; each block is
transposed into 4 byte planes (or 32 bit planes), and every plane is compressed
with zstandard. A plane of zeros costs a few bytes, so ids below 65,536 take
little more than their two low planes. An index gives the place and number of ids of each
block, so that any range of ids is read without decoding the rest.

    magic, version | planes of block 0 | planes of block 1 | ... | index | its length, magic
    index: zstandard of JSON {bits, n_ids, blocks: [[offset, n, plane lengths]], docs: [[doc_id, n_tokens]]}

The shards are stored as rows of a Parquet table (part, seq, base, n_ids, data),
since only Spark's writers reach every kind of shared storage: part and seq give
the order, base is the number of ids before the shard within its part, data is
the shard's bytes. A task writes one part, shard by shard, and holds one at a time.

Defined results: a null or empty text has only the end id. A null doc_id is kept
and comes first. Rows that repeat a doc_id stand next to each other, in the order
of a hash of the text. An empty table gives an empty store. Other columns are not
looked at.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termlens.llm.batches import PIECE_BYTES, binary_column, pieces, worker_state

MAGIC = b"IDPLANE1"
BLOCK = 16_384
#: Ids of a shard; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
END_ID = 1
#: Words whose ids a worker remembers.
CACHE_WORDS = 700_000
_TRAILING = b".,!%&*$#|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ the file format


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The block's 4 byte planes, or its 32 bit planes, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [np.ascontiguousarray(row).tobytes() for row in octets]
    return [np.packbits((row >> bit) & 1).tobytes() for row in octets for bit in range(8)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    octets = np.zeros((4, count), np.uint8)
    if len(planes) == 4:
        for row, plane in zip(octets, planes):
            row[:] = np.frombuffer(plane, np.uint8)
    else:
        for number, plane in enumerate(planes):
            unpacked = np.unpackbits(np.frombuffer(plane, np.uint8), count=count)
            octets[number // 8] |= unpacked << (number % 8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


def encode_shard(docs: list[tuple[int | None, int]], ids: np.ndarray, block: int = BLOCK, bits: bool = False) -> bytes:
    """The bytes of a shard of ``docs`` (doc_id, n_tokens) with all their ids."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out, blocks, at = [MAGIC], [], len(MAGIC)
    for begin in range(0, len(ids), block):
        part = ids[begin : begin + block]
        planes = [squeeze(plane) for plane in to_planes(part, bits)]
        blocks.append([at, len(part), [len(p) for p in planes]])
        at += sum(map(len, planes))
        out += planes
    index = squeeze(json.dumps({"bits": bits, "n_ids": len(ids), "blocks": blocks, "docs": docs}).encode())
    return b"".join([*out, index, struct.pack("<Q", len(index)), MAGIC])


class Shard:
    """Reads documents and ranges of ids from a shard's bytes."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard of token ids")
        (length,) = struct.unpack("<Q", data[-len(MAGIC) - 8 : -len(MAGIC)])
        index = json.loads(zstandard.decompress(data[-len(MAGIC) - 8 - length : -len(MAGIC) - 8]))
        self.n_ids, self.docs, self._blocks, self._data = index["n_ids"], index["docs"], index["blocks"], data
        self._starts = np.cumsum([0] + [n for _, n, _ in self._blocks])

    def _block(self, number: int) -> np.ndarray:
        at, count, lengths = self._blocks[number]
        planes = []
        for length in lengths:
            planes.append(zstandard.decompress(self._data[at : at + length]))
            at += length
        return from_planes(planes, count)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from ``begin`` to before ``end``; only the blocks that hold them are decoded."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if begin >= end:
            return np.zeros(0, "<u4")
        first = int(np.searchsorted(self._starts, begin, "right")) - 1
        last = int(np.searchsorted(self._starts, end, "left"))
        held = np.concatenate([self._block(number) for number in range(first, last)])
        return held[begin - self._starts[first] : end - self._starts[first]]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place in the shard, ids), decoded block by block."""
        at, held, held_from, number = 0, np.zeros(0, "<u4"), 0, 0
        for doc_id, count in self.docs:
            while held_from + len(held) < at + count:
                held = np.concatenate([held[at - held_from :], self._block(number)])
                held_from, number = at, number + 1
            yield doc_id, at, held[at - held_from : at - held_from + count]
            at += count


# ------------------------------------------------------------------------- encoding


class WordEncoder:
    """Encodes texts word by word, remembering the ids of words.

    The vocabulary drops white space and never joins over it, so a text's ids are
    those of its white-space separated words in turn. A word that ends in marks after
    an ASCII letter or digit falls into two such parts as well.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        if len(self._known) + len(words) > CACHE_WORDS:
            self._known.clear()
        whole, cut = set(), []
        for word in words:
            core = word.rstrip(_TRAILING)
            if core != word and core[-1:].isalnum():
                cut.append(word)
                whole.add(core)
                whole.add(word[len(core) :])
            else:
                whole.add(word)
        whole.difference_update(self._known)
        # plain lower-case letters are one piece of the vocabulary's own splitting, so its model takes them as they are
        plain = [w for w in whole if w.islower() and w.isalpha()]
        other = list(whole.difference(plain))
        tokenize = self._tokenizer.model.tokenize
        made = {w: array("I", [t.id for t in tokenize(w.decode())]).tobytes() for w in plain}
        coded = self._tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)
        made.update((w, array("I", c.ids).tobytes()) for w, c in zip(other, coded))
        self._known.update(made)
        for word in cut:
            core = word.rstrip(_TRAILING)
            self._known[word] = self._known[core] + self._known[word[len(core) :]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        # a special token is spelled in lower case, so only texts without one are lowered here
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        fresh: set[bytes] = set()
        for words in split:
            fresh.update(filterfalse(self._known.__contains__, words))
        if fresh:
            if len(self._known) + len(fresh) > CACHE_WORDS:
                fresh = set().union(*split)
            self._learn(fresh)
        known = self._known.__getitem__
        return [b"".join(map(known, words)) for words in split]


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    ordered: bool = True,
    shard_ids: int = SHARD_IDS,
    block: int = BLOCK,
    bits: bool = False,
    text_bytes: int = PIECE_BYTES,
) -> None:
    """Encode ``documents`` (doc_id, text) and store their ids under ``path``.

    ``ordered``: in ascending doc_id order; otherwise in the order in which the rows are read. ``text_bytes``: text
    that a worker splits into words at once.
    """
    tokenizer = tokenizer or default_tokenizer()
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if ordered:
        tie = F.xxhash64("text")
        texts = texts.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    tail = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state("encoder_" + tokenizer, lambda: WordEncoder(tokenizer))
        part = TaskContext.get().partitionId()
        docs: list[tuple[int | None, int]] = []
        held: list[bytes] = []
        count = base = seq = 0

        def shard() -> pa.RecordBatch:
            data = encode_shard(docs, np.frombuffer(b"".join(held), "<u4"), block, bits)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "base": pa.array([base], pa.int64()),
                    "n_ids": pa.array([count], pa.int64()),
                    "data": pa.array([data], pa.binary()),
                }
            )

        for piece in pieces(batches, "text", text_bytes):
            names = piece.column("doc_id").to_pylist()
            for doc_id, ids in zip(names, coder.encode(binary_column(piece, "text"))):
                length = len(ids) // 4 + 1
                if docs and count + length > shard_ids:
                    yield shard()
                    base, seq, count, docs, held = base + count, seq + 1, 0, [], []
                docs.append((doc_id, length))
                held += [ids, tail]
                count += length
        if docs:
            yield shard()

    texts.mapInArrow(encode, "part int, seq int, base bigint, n_ids bigint, data binary").write.mode(
        "overwrite"
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, on request, ids of the stored documents.

    ``start``: ids of all documents before it. The only table sent to all tasks has
    one row per part, as many as the writing job had tasks.
    """
    stored = spark.read.schema("part int, seq int, base bigint, n_ids bigint, data binary").parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    placed = stored.join(F.broadcast(parts), "part").select((F.col("before") + F.col("base")).alias("base"), "data")
    columns = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, shard = batch.column("base")[row].as_py(), Shard(batch.column("data")[row].as_py())
                names, starts, counts, sums, ids = [], [], [], [], []
                for doc_id, at, some in shard.documents():
                    names.append(doc_id)
                    starts.append(base + at)
                    counts.append(len(some))
                    sums.append(zlib.crc32(some.tobytes()))
                    if with_ids:
                        ids.append(some.astype(np.int32))
                made = {
                    "doc_id": pa.array(names, pa.int64()),
                    "start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
                if with_ids:
                    made["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(made)

    return placed.mapInArrow(decode, columns + (", ids array<int>" if with_ids else ""))
