"""Stemming as a job: the frequent terms are stemmed once, not each occurrence, and tokens are neither shuffled nor stored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions.stems import stem
from termlens.operators.vocabulary import slices
from termlens.sources.workspace import materialize

# Frequent terms whose stems go to the rows, and letters of such a term: some 20 MB in each Python worker, 40 at the very most.
MOST_STEMS = 200_000
MOST_LETTERS = 64


def stem_terms(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """term, stem over the distinct terms of all rows."""
    terms = rows.select(F.explode(F.array_distinct(tokens)).alias("term")).distinct()
    return terms.withColumn("stem", stem("term"))


def frequent_stems(rows: DataFrame, fields: list[str], most: int = MOST_STEMS) -> DataFrame:
    """term, stem of the terms that most rows have, ``most`` of them or fewer: terms that equally many rows have are all in
    or all out, those of one row are out, and so are those of more than ``MOST_LETTERS`` letters."""
    own = F.array_distinct(F.concat(*[F.coalesce(name, F.array().cast("array<string>")) for name in fields]))
    terms = rows.select(F.explode(own).alias("term")).where(F.length("term") <= MOST_LETTERS)
    counted = materialize(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "term-rows")
    # one row for each number of rows that some term is in
    reached = F.sum("terms").over(Window.orderBy(F.desc("n")))
    steps = counted.groupBy("n").agg(F.count(F.lit(1)).alias("terms")).select("n", reached.alias("reached"))
    least = steps.where(F.col("reached") <= most).agg(F.min("n").alias("least"))
    frequent = counted.join(F.broadcast(least), F.col("n") >= F.col("least"))
    return frequent.select("term", stem("term").alias("stem"))


def stem_tokens(rows: DataFrame, fields: dict[str, str], most: int = MOST_STEMS) -> DataFrame:
    """Add a stemmed copy of token columns; null tokens are dropped, and a null array gives ``[]``.

    The stems of up to ``most`` frequent terms go to the rows and are looked up there. Any other term is stemmed where it
    stands. So what is shuffled are counts of distinct terms, whatever the number of tokens.
    """
    held = materialize(frequent_stems(rows, list(fields), most), "stems").toArrow()
    terms, own = (held.column(name).combine_chunks() for name in ("term", "stem"))

    @F.arrow_udf("array<string>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = []
            for tokens in slices(batch):
                flat = tokens.flatten()
                found = pc.take(own, pc.index_in(flat, value_set=terms.cast(flat.type), skip_nulls=True))
                ends = np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy())
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                made.append(pa.ListArray.from_arrays(offsets, found))
            yield pa.concat_arrays(made)

    known = rows.withColumns({f"_known_{old}": lookup(F.col(old)) for old in fields})
    stemmed = {
        new: F.coalesce(
            F.array_compact(F.zip_with(old, f"_known_{old}", lambda term, found: F.coalesce(found, stem(term)))),
            F.array().cast("array<string>"),
        )
        for old, new in fields.items()
    }
    return known.withColumns(stemmed).drop(*[f"_known_{old}" for old in fields])
