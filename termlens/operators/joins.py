"""Joins of many rows to a table with one row per key, safe for heavy keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.sources.workspace import materialize, new_folder, stored_bytes

# Rows of one key that one task takes on; keys with more are split.
ROWS_PER_SPLIT = 1_000_000

# Stored size up to which a lookup is sent to all tasks; in memory it may be some ten times that.
BROADCAST_BYTES = 8 << 20

# Parts over which rows without a key are spread: they match nothing.
NULL_PARTS = 64

_COPIES, _SALT = "_copies", "_salt"


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, n: reads one column and is summed before the shuffle."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def join_unique(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: str,
    how: str = "inner",
    counts: DataFrame | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
    broadcast_bytes: int = BROADCAST_BYTES,
    lookup_bytes: int | None = None,
) -> DataFrame:
    """``rows.join(lookup, key, how)`` where one key may hold most of the rows.

    The lookup is stored, unless ``lookup_bytes`` says that it is and how large. One of up to ``broadcast_bytes`` goes to the rows, which
    stay where they are. Otherwise the rows of a heavy key are spread over as many tasks as they
    need, by a hash of the column ``spread``, and its ``lookup`` row is copied to each of them; rows
    without a key are spread as well. The rows are never stored and never sent to all tasks. ``how`` is
    ``inner`` or ``left``: copies of the lookup would show in any other join.

    ``counts`` (key, n) saves the pass that counts the rows of each key, on their key column alone; where that
    repeats the joins that ``rows`` come from, a bound from a plain table is cheaper, and greater numbers only split more.
    The list of heavy keys has at most one entry per ``rows_per_split`` rows. Without any, rows that
    an earlier join dealt out by the key stay where they are.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if lookup_bytes is None:
        path = new_folder(rows.sparkSession, "join-lookup")
        lookup = materialize(lookup, "join-lookup", path)
        lookup_bytes = stored_bytes(rows.sparkSession, path)
    if lookup_bytes <= broadcast_bytes:
        return rows.join(F.broadcast(lookup), key, how)
    if counts is None:
        counts = key_counts(rows, key)
    # rows without a key are in no inner join, and are always spread in a left one
    split = F.when(F.col(key).isNull(), F.lit(how == "left")).otherwise(F.col("n") > rows_per_split)
    found = materialize(
        counts.where(split).select(key, F.ceil(F.col("n") / F.lit(rows_per_split)).cast("int").alias(_COPIES)),
        "heavy-keys",
    )
    if found.isEmpty():
        return rows.hint("merge").join(lookup, key, how)
    heavy = F.broadcast(found.where(F.col(key).isNotNull()))
    copies = F.coalesce(_COPIES, F.lit(1))
    parts = F.when(F.col(key).isNull(), F.lit(NULL_PARTS)).otherwise(copies)
    salted = rows.join(heavy, key, "left").withColumn(
        _SALT, F.pmod(F.xxhash64(spread), parts).cast("int")
    )
    copied = lookup.join(heavy, key, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), copies - F.lit(1)))
    )
    # both sides are shuffled: neither may be sent whole to every task at run time
    salted, copied = salted.drop(_COPIES).hint("merge"), copied.drop(_COPIES)
    return salted.join(copied, [key, _SALT], how).drop(_SALT)


def content_key(column: str) -> Column:
    """One text per distinct value of an array column; null has one too."""
    return F.md5(F.to_json(F.struct(F.col(column).alias("v"))).cast("binary"))


def join_by_content(
    rows: DataFrame, fields: dict[str, str], make: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Add to ``rows`` what ``make`` gives for each array column, worked out once per distinct array.

    ``fields`` maps array columns to new columns. ``make`` takes (content, values) with
    one row per distinct array and returns (content, result). Rows need no key of
    their own: equal arrays have equal results, whatever row they stand in.
    """
    keyed = rows.withColumns({f"_content_{old}": content_key(old) for old in fields})
    keyed = materialize(keyed, "by-content")
    stacked = F.array(
        *[F.struct(F.col(f"_content_{old}").alias("content"), F.col(old).alias("values")) for old in fields]
    )
    distinct = keyed.select(F.inline(stacked)).groupBy("content").agg(F.first("values").alias("values"))
    # stored, as ``make`` reads them several times and each would shuffle all arrays again
    distinct = materialize(distinct, "by-content")
    path = new_folder(rows.sparkSession, "by-content")
    made = materialize(make(distinct), "by-content", path)
    size = stored_bytes(rows.sparkSession, path)
    for old, new in fields.items():
        one = made.select(F.col("content").alias(f"_content_{old}"), F.col("result").alias(new))
        counts = key_counts(keyed, f"_content_{old}")
        keyed = join_unique(keyed, one, f"_content_{old}", f"_content_{old}", "left", counts, lookup_bytes=size)
    return keyed.drop(*[f"_content_{old}" for old in fields])
