"""Records of large text files, read by byte ranges although quotes may hold the separator.

The engine cuts files at line ends; with line breaks inside quotes it reads a whole file in one task
instead. Here a file is read by ranges all the same, in two passes. The first one finds, for each
range, whether it ends inside quotes if it begins outside and if it begins inside; what each range
really begins with follows from the ranges before it, one small row each. The second one
cuts the records. A record that lies over the end of a range is put together from its parts.

What a quote means is told by a ``Quoting``: given a piece of text between two separators, and
whether it begins inside quotes, does it end inside?
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlens.sources.workspace import materialize, new_folder

RECORD, BEGINS, GOES_ON, ENDS = range(4)
_SCHEMA = "file bigint, block bigint, place bigint, kind int, text string"


class Quoting(Protocol):
    quote: str

    def inside(self, piece: str, inside: bool) -> bool: ...


class CsvQuoting:
    """Quotes open at the begin of a field only, and are doubled inside; after a closing quote the
    rest of its field is taken as it is."""

    def __init__(self, separator: str = ",", quote: str = '"') -> None:
        self.quote = quote
        s, q = re.escape(separator), re.escape(quote)
        body = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}[^{s}]*+"
        field = f"(?:{q}{body}|[^{q}{s}][^{s}]*+|)"
        self._closing = re.compile(f"{body}(?:{s}|\\Z)", re.DOTALL)
        self._whole = re.compile(f"(?:{field}{s})*+{field}\\Z", re.DOTALL)

    def inside(self, piece: str, inside: bool) -> bool:
        begin = 0
        if inside:
            closed = self._closing.match(piece)
            if closed is None:
                return True
            begin = closed.end()
        return self._whole.match(piece, begin) is None


class JsonQuoting:
    """JSON strings: a backslash takes the meaning of the character behind it."""

    quote = '"'
    _closing = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
    _whole = re.compile(r'[^"]*+(?:"(?:[^"\\]|\\.)*+"[^"]*+)*+\Z', re.DOTALL)

    def inside(self, piece: str, inside: bool) -> bool:
        begin = 0
        if inside:
            closed = self._closing.match(piece)
            if closed is None:
                return True
            begin = closed.end()
        return self._whole.match(piece, begin) is None


def _twin(spark: SparkSession, range_bytes: int | None) -> SparkSession:
    """A session of the same settings whose ranges do not depend on the executors at hand.

    Both passes must see the same ranges; how files are cut would otherwise follow the number of cores.
    """
    twin = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if twin.conf.isModifiable(key):
            twin.conf.set(key, value)
    twin.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if range_bytes is not None:
        twin.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
        twin.conf.set("spark.sql.files.openCostInBytes", "1")
    return twin


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value, file, block: pieces between separators, in the order of each range."""
    return spark.read.option("lineSep", separator).text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The parts of a batch that belong to one range."""
    if not batch.num_rows:
        return
    keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
    begin = 0
    for at in range(1, len(keys) + 1):
        if at == len(keys) or keys[at] != keys[begin]:
            yield keys[begin], batch.slice(begin, at - begin)
            begin = at


def _quoted_places(values: pa.Array, quote: str) -> pa.Array:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring(values, quote), False))


def _range_ends(pieces: DataFrame, quoting: Quoting) -> DataFrame:
    """file, block, and whether the range ends inside quotes if it begins outside, and inside."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outside, inside = None, False, True
        done: list[tuple] = []
        for batch in batches:
            for now, run in _runs(batch):
                if now != key:
                    if key is not None:
                        done.append((*key, outside, inside))
                    key, outside, inside = now, False, True
                values = run.column("value")
                for piece in values.take(_quoted_places(values, quoting.quote)).to_pylist():
                    same = outside == inside
                    outside = quoting.inside(piece, outside)
                    inside = outside if same else quoting.inside(piece, inside)
        if key is not None:
            done.append((*key, outside, inside))
        names = ["file", "block", "outside", "inside"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in done], schema)

    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])
    return pieces.mapInArrow(ends, "file bigint, block bigint, outside boolean, inside boolean")


def _range_begins(ends: DataFrame) -> DataFrame:
    """file, block, begins_inside.

    A range either decides how it ends, whatever it begins with, or keeps that, or turns it over. What a range
    begins with is what the last deciding range before it ends with, turned over as often as ranges did since.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    decides = F.col("outside") == F.col("inside")
    turned = (~decides & F.col("outside")).cast("int")
    counted = ends.withColumn("turns", F.coalesce(F.sum(turned).over(before), F.lit(0)))
    decided = F.when(decides, F.struct(F.col("outside").cast("int").alias("state"), "turns"))
    known = counted.withColumn("last", F.last(decided, ignorenulls=True).over(before))
    # a deciding range does not turn, so its own turns are those before it
    state = F.coalesce("last.state", F.lit(0)) + F.col("turns") - F.coalesce("last.turns", F.lit(0))
    return known.select("file", "block", (state % 2 == 1).alias("begins_inside"))


def _cut(pieces: DataFrame, begins: DataFrame, quoting: Quoting, separator: str) -> DataFrame:
    """file, block, place, kind, text: records and, where one lies over the end of a range, its parts.

    ``place`` counts the records that begin in a range; blank ones are left out.
    """
    # a row for each range of the input, sent to where the ranges are read
    marked = pieces.join(F.broadcast(begins), ["file", "block"], "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, begun_here, place = None, False, True, 0
        held: list[str] = []
        made: list[tuple] = []

        def close(kind: int) -> None:
            nonlocal held, begun_here, place
            text = separator.join(held)
            held = []
            if kind != RECORD or text.strip():
                made.append((*key, place, kind, text))
                place += kind in (RECORD, BEGINS)
            begun_here = True

        def leave() -> None:
            if held:
                close(BEGINS if begun_here else GOES_ON)

        def batch_of() -> pa.RecordBatch:
            nonlocal made
            columns = [list(c) for c in zip(*made)] or [[]] * 5
            made = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for now, run in _runs(batch):
                if now != key:
                    leave()
                    known = run.column("begins_inside")[0].as_py()
                    if known is None:
                        raise RuntimeError("the ranges of the second pass are not those of the first one")
                    key, inside, begun_here, place = now, known, not known, 0
                values = run.column("value").to_pylist()
                at = 0
                for quoted in [*_quoted_places(run.column("value"), quoting.quote).to_pylist(), len(values)]:
                    # pieces without a quote are records outside, and go on inside
                    if inside:
                        held.extend(values[at:quoted])
                    else:
                        for piece in values[at:quoted]:
                            held.append(piece)
                            close(RECORD)
                    at = quoted
                    if quoted < len(values):
                        held.append(values[quoted])
                        inside = quoting.inside(values[quoted], inside)
                        if not inside:
                            close(RECORD if begun_here else ENDS)
                        at += 1
            yield batch_of()
        leave()
        yield batch_of()

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    names = ["file", "block", "place", "kind", "text"]
    return marked.select("file", "block", "begins_inside", "value").mapInArrow(records, _SCHEMA)


def _joined_parts(parts: DataFrame, separator: str) -> DataFrame:
    """file, block, place, text of the records that lie over ends of ranges."""
    order = [F.col("block"), (F.col("kind") == BEGINS).cast("int")]
    so_far = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbers = parts.select("file", "block", "kind").withColumn("record", F.sum((F.col("kind") == BEGINS).cast("int")).over(so_far))
    pieces = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    joined = parts.join(numbers, ["file", "block", "kind"]).groupBy("file", "record").agg(pieces.alias("pieces"))
    first = F.get("pieces", F.lit(0))
    return joined.select("file", first["block"].alias("block"), first["place"].alias("place"), F.array_join("pieces.text", separator).alias("text"))


def read_records(
    spark: SparkSession, path: str, separator: str, quoting: Quoting, range_bytes: int | None = None
) -> DataFrame:
    """block, place, text: the records of the files in ``path``, stored.

    ``block`` is where in its file the record's range begins and ``place`` its number in there, so the first record of a file has zeros.
    ``range_bytes`` is the size of a range (by default the session's).
    """
    pieces = _pieces(_twin(spark, range_bytes), path, separator)
    begins = materialize(_range_begins(_range_ends(pieces, quoting)), "range-begins")
    target = new_folder(spark, "range-records")
    materialize(_cut(pieces, begins, quoting, separator), "range-records", target)
    stored = spark.read.schema(_SCHEMA).parquet(target)
    whole = stored.where(F.col("kind") == RECORD).select("block", "place", "text")
    parts = stored.where(F.col("kind") != RECORD)
    return whole.union(_joined_parts(parts, separator).select("block", "place", "text"))
