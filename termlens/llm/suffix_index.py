"""A logarithmic family of suffix arrays that stays in a folder and takes batch after batch.

Where ``suffixes.duplicated_spans`` cuts one table into batches and forgets the family at the end, an index lasts: a new
batch gets its arrays, they are merge-scanned against the stored levels, levels of equal size merge, and the batch
is shortened by the strings of 50 bytes that stand in earlier batches, or in documents of a smaller doc_id of its
own. Earlier batches are not touched again, whatever their doc_ids.

In the folder: ``chunks/N``, the distinct texts of batch N; ``steps/N``, what its scan reported and the level that it made; ``state/N``,
the index after batch N. A batch counts once its state is written: one that failed is simply added again.

A seed that was met before is reported to the chunk that held it first; further chunks that hold it were reported when they were added, so
those reports are kept, and are searched by bucket for the seeds of the new batch. Only chunks with a reported seed are read again.

Defined results are those of ``suffixes``; an empty batch changes nothing but the number.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import suffixes as X
from termlens.sources.workspace import materialize, remove

#: All documents of earlier batches come before any new one.
_BEFORE = np.iinfo(np.int64).min


@dataclass
class State:
    """The index after ``batches`` batches; ``levels`` maps a level to the step that made it."""

    buckets: int
    chunk_bytes: int
    hot_bytes: int
    batches: int = 0
    chunks: int = 0
    levels: dict[str, int] = field(default_factory=dict)


class SuffixIndex:
    def __init__(self, spark: SparkSession, path: str, state: State) -> None:
        self.spark, self.path, self.state = spark, path, state

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        expected_bytes: int,
        chunk_bytes: int = X.CHUNK_BYTES,
        bucket_bytes: int = X.BUCKET_BYTES,
        hot_bytes: int = X.HOT_BYTES,
    ) -> SuffixIndex:
        """A new index in an empty folder, for about so many bytes of text in the end."""
        index = cls(spark, path, State(max(1, -(-expected_bytes // bucket_bytes)), chunk_bytes, hot_bytes))
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuffixIndex:
        # one row a batch
        states = [State(**json.loads(r.value)) for r in spark.read.text(f"{path}/state/*").collect()]
        return cls(spark, path, max(states, key=lambda s: s.batches))

    def _save(self) -> None:
        row = self.spark.createDataFrame([(json.dumps(asdict(self.state)),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.path}/state/{self.state.batches}")

    def _steps(self, number: int) -> str:
        return f"{self.path}/steps/{number}"

    def add(self, documents: DataFrame) -> DataFrame:
        """doc_id, n_bytes, spans, kept_sha256 of a new batch (doc_id, text), which is part of the index from then on."""
        spark, state = self.spark, self.state
        number = state.batches + 1
        source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        count = max(1, -(-size // state.chunk_bytes))
        sent = source.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
            X._first_in_task, "name string, first bigint, text binary"
        )
        chunk = F.pmod(F.xxhash64("name"), F.lit(count)).cast("int") + F.lit(state.chunks)
        distinct = sent.withColumn("chunk", chunk).groupBy("chunk", "name").agg(F.min("first").alias("first"), F.max("text").alias("text"))
        new = materialize(distinct.select("chunk", "first", "name", "text"), "chunks", f"{self.path}/chunks/{number}")

        most = state.hot_bytes // (2 * (X.LENGTH + X._REACH))
        often = most // (state.chunks + count)
        levels = {int(level): self._steps(step) for level, step in state.levels.items()}
        arrays = X.chunk_arrays(new.select("chunk", "text"), state.buckets, often)
        _, following, _ = X.add_batch(arrays, levels, number, self._steps(number))
        reports = materialize(self._reports(number), "reports")
        hot = X.hot_seeds(spark, [self._steps(n) for n in range(1, number + 1)], most)

        texts = new
        if number > 1:
            told = reports.select("chunk").distinct()
            old = spark.read.schema(new.schema).parquet(*[f"{self.path}/chunks/{n}" for n in range(1, number)])
            old = old.join(told, "chunk", "left_semi").withColumn("first", F.lit(_BEFORE)).select(new.columns)
            texts = materialize(old, "old-chunks").unionByName(new)
        result = X.by_document(source, X.matched(texts, reports, state.buckets, hot, cut=new))
        result = materialize(result, "spans")
        for path in set(levels.values()) - set(following.values()):
            remove(spark, f"{path}/kind=1")
        state.batches, state.chunks = number, state.chunks + count
        state.levels = {str(level): int(path.rsplit("/", 1)[1]) for level, path in following.items()}
        self._save()
        return result

    def _reports(self, number: int) -> DataFrame:
        """chunk, keys: what the scan of batch ``number`` reported, and the earlier reports of the same seeds."""
        read = [self.spark.read.schema(X._FOUND).parquet(self._steps(n)).where("kind = 0") for n in range(1, number + 1)]
        now = read[-1]
        if number == 1:
            return now.select("chunk", "keys")

        def again(new: pa.Table, old: pa.Table) -> pa.Table:
            wanted = [X.unpack(k) for k in new.column("keys").to_pylist()]
            wanted = np.unique(np.concatenate(wanted)) if wanted else X._NONE
            rows = []
            for chunk, keys in zip(old.column("chunk").to_pylist(), old.column("keys").to_pylist()):
                same = np.intersect1d(X.unpack(keys), wanted, assume_unique=True) if len(wanted) else X._NONE
                if len(same):
                    rows.append((chunk, X.pack(same)))
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
            return pa.table(columns, names=["chunk", "keys"])

        before = read[0]
        for more in read[1:-1]:
            before = before.unionByName(more)
        found = now.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInArrow(again, "chunk int, keys binary")
        return now.select("chunk", "keys").unionByName(found)
