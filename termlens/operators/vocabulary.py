"""Dictionary of terms and integer encoding of token arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions.text import term_counts
from termlens.operators.joins import join_by_content, join_unique
from termlens.sources.workspace import materialize

SIZE = 30_000
MIN_DOCUMENTS = 2

# Entries of token or id arrays that a Python worker handles at once.
ENTRIES_AT_ONCE = 1 << 20


def term_totals(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """term, tf, df over all rows, in one pass and one shuffle.

    A row's terms are counted inside the row, and the counts are summed in the map
    tasks, so a frequent term costs one record per task.
    """
    return (
        rows.select(F.inline(term_counts(tokens)))
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    )


def build_vocabulary(
    rows: DataFrame,
    tokens: str = "tokens",
    min_documents: int = MIN_DOCUMENTS,
    size: int | None = SIZE,
    drop_empty: bool = False,
) -> DataFrame:
    """term, tf, df, term_id: the ``size`` most frequent terms (None: all) found in at least
    ``min_documents`` rows; ids from 1 by falling frequency, ties by term.

    No task sees more than a range of the terms. The frequency that the last
    term in has is found from the number of terms per frequency; the terms from there
    on are sorted over all tasks, and an id is the number of terms in the ranges
    before plus the place in its own.
    """
    kept = term_totals(rows, tokens).where(F.col("df") >= min_documents)
    if drop_empty:
        kept = kept.where(F.col("term") != "")
    kept = materialize(kept, "term-totals")
    if size is not None:
        falling = Window.orderBy(F.desc("tf"))
        steps = kept.groupBy("tf").agg(F.count(F.lit(1)).alias("n")).select(
            "tf", (F.sum("n").over(falling) - F.col("n")).alias("before")
        )
        least = steps.where(F.col("before") < size).agg(F.min("tf").alias("least"))
        kept = kept.join(F.broadcast(least), F.col("tf") >= F.col("least")).drop("least")
    order = [F.desc("tf"), F.asc("term")]
    place = F.monotonically_increasing_id()
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(
        ordered.select("term", "tf", "df", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")),
        "ordered-terms",
    )
    # one row per task of the sort
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    term_id = (F.col("start") + F.col("at") + 1).cast("int").alias("term_id")
    ranked = ordered.join(F.broadcast(starts), "part").select("term", "tf", "df", term_id)
    return ranked if size is None else ranked.where(F.col("term_id") <= size)


def vocabulary_size(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count(F.lit(1)).alias("vocabulary_size"))


def encode_tokens(
    rows: DataFrame, vocabulary: DataFrame, fields: dict[str, str], most: int = SIZE
) -> DataFrame:
    """Add per token column an ``array<int>`` column of term ids, in token order.

    ``fields`` maps token columns to the new columns. Unknown and empty tokens
    are dropped; a row without known tokens, or with null, gets ``[]``.

    The dictionary is read to the driver and looked up in Arrow batches where the
    rows are, with no shuffle. It must have at most ``most`` terms, which is checked; for
    a larger one call ``encode_tokens_join``, which gives the same result.
    """
    known = vocabulary.where(F.col("term") != "").select("term", "term_id")
    head = known.limit(most + 1).toArrow()
    if head.num_rows > most:
        raise ValueError(f"more than {most} terms: use encode_tokens_join")
    return _encode_in_place(rows, head, fields)


def encode_tokens_join(
    rows: DataFrame, vocabulary: DataFrame, fields: dict[str, str]
) -> DataFrame:
    """``encode_tokens`` for a dictionary of any size, by a join.

    Each distinct token array is looked up once, and a term in many of them is split
    over tasks.
    """
    known = vocabulary.where(F.col("term") != "").select("term", "term_id")

    def encode(arrays: DataFrame) -> DataFrame:
        tokens = arrays.select("content", F.posexplode("values").alias("pos", "term"))
        matched = join_unique(tokens, known, "term", spread="content")
        ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term_id"))), lambda e: e["term_id"])
        encoded = matched.groupBy("content").agg(ids.alias("result"))
        empty = F.array().cast("array<int>")
        return arrays.select("content").join(encoded, "content", "left").withColumn(
            "result", F.coalesce("result", empty)
        )

    return join_by_content(rows, fields, encode)


def slices(arrays: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring list entries of at most ``ENTRIES_AT_ONCE`` values, one list at least, in order; an empty one of an empty array."""
    ends = np.cumsum(pc.list_value_length(arrays).fill_null(0).to_numpy())
    first = 0
    while first < len(arrays) or not first:
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + ENTRIES_AT_ONCE, side="right")), first + 1)
        yield arrays.slice(first, last - first)
        first = last


def _encode_in_place(rows: DataFrame, known: pa.Table, fields: dict[str, str]) -> DataFrame:
    terms = known.column("term").combine_chunks()
    ids = known.column("term_id").combine_chunks().cast(pa.int32())

    @F.arrow_udf("array<int>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = []
            for tokens in slices(batch):
                flat = tokens.flatten()
                found = pc.take(ids, pc.index_in(flat, value_set=terms.cast(flat.type)))
                kept_before = np.concatenate(
                    ([0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False)))
                )
                ends = np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy())
                offsets = kept_before[np.concatenate(([0], ends)).astype(np.int64)]
                made.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), found.drop_null()))
            yield pa.concat_arrays(made)

    return rows.withColumns({new: lookup(F.col(old)) for old, new in fields.items()})


def _sized(vocabulary: DataFrame) -> int:
    """Number of terms, whose ids must be 1 to that number."""
    size, last = vocabulary.agg(F.count(F.lit(1)), F.max("term_id")).first()
    if size != (last or 0):
        raise ValueError("the ids of the dictionary have gaps")
    return size


def count_vectors(
    rows: DataFrame,
    vocabulary: DataFrame,
    tokens: str = "tokens",
    output: str = "counts",
    min_count: float = 1.0,
    most: int = SIZE,
) -> DataFrame:
    """Add a sparse ML vector of how often each term of the dictionary comes in a row; term_id n is entry n - 1.

    Terms that come less often than ``min_count`` in the row have no entry; below 1 it is a share of the row's
    tokens, unknown ones included. Null tokens are none. The dictionary is read to the driver and must
    have at most ``most`` terms; for a larger one call ``count_vectors_join``.
    """
    if _sized(vocabulary) > most:
        raise ValueError(f"more than {most} terms: use count_vectors_join")
    terms = [row["term"] for row in vocabulary.select("term", "term_id").orderBy("term_id").collect()]
    filled = rows.withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>")))
    model = CountVectorizerModel.from_vocabulary(terms, "_tokens", outputCol=output, minTF=float(min_count))
    return model.transform(filled).drop("_tokens")


def count_vectors_join(
    rows: DataFrame, vocabulary: DataFrame, fields: dict[str, str], min_count: float = 1.0
) -> DataFrame:
    """``count_vectors`` for a dictionary of any size, by a join: sparse structs (type, size, indices, values), which
    ``features.store_vectors`` reads back as ML vectors. ``fields`` maps token columns to new columns."""
    size = _sized(vocabulary)
    known = vocabulary.select("term", "term_id")

    def count(arrays: DataFrame) -> DataFrame:
        least = F.lit(float(min_count)) * (F.lit(1) if min_count >= 1 else F.size("values"))
        counted = arrays.select("content", least.alias("least"), F.inline(term_counts("values"))).where("tf >= least")
        # read twice by the join; far fewer than the tokens that they are counted from
        matched = join_unique(materialize(counted, "counted"), known, "term", spread="content")
        entries = F.array_sort(F.collect_list(F.struct((F.col("term_id") - 1).alias("index"), F.col("tf").cast("double").alias("tf"))))
        made = matched.groupBy("content").agg(entries.alias("entries"))
        all_rows = arrays.select("content").join(made, "content", "left")
        indices = F.coalesce(F.col("entries.index"), F.array().cast("array<int>"))
        values = F.coalesce(F.col("entries.tf"), F.array().cast("array<double>"))
        sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
        return all_rows.select("content", sparse.alias("result"))

    return join_by_content(rows, fields, count)
