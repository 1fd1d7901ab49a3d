"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the mixed corpus over its own size. Every
document's number of copies is the Poisson distribution of that mean, inverted at a
uniform number that a hash of the seed and the doc_id gives: any cluster, at any time,
draws the same copies. The copies are then dealt over all tasks, and ordered in
them, by a hash of seed, document and copy.

Sizes are characters plus one for each document, so a source of empty texts has a size.
The rates are a stored table of one row per source: the planner sends it to the rows
where it is small, and joins it with each source's rows spread over tasks otherwise.

Defined results: a null source is a source of its own; a null text has no characters; a
null doc_id is drawn like the word "null"; rows that repeat a doc_id get the same number
of copies, and very frequent equal rows are dealt over tasks like others. A text may be of any length: it is only
moved. An empty table gives an empty one. A source without a target weight is left out where weights are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlens.llm.components import join_spread
from termlens.sources.workspace import materialize

SEED = "mix-1"
#: Target shares are sizes to this power where no weights are given: small sources gain.
POWER = 0.5
#: Rows that agree in all columns and come more often are numbered, so that they do not all have one place.
OFTEN = 1_000


def _source(column: str = "source") -> Column:
    """A key that also holds for null."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit("null"))


def uniform(seed: str) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the seed and the doc_id."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def poisson_steps(rated: DataFrame) -> DataFrame:
    """__source, __steps from __source, __rate: the distribution function at 0, 1, 2, ... until it is 1 to double precision.

    Logarithms of the terms are running sums, in time that is linear in the rate.
    """
    rate, k = F.col("__rate"), F.col("k")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    terms = rated.where(rate > 0).select("__source", "__rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    so_far = Window.partitionBy("__source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = terms.withColumn("log", F.sum(F.when(k == 0, -rate).otherwise(F.log(rate) - F.log(k.cast("double")))).over(so_far))
    steps = terms.withColumn("step", F.sum(F.exp("log")).over(so_far)).groupBy("__source").agg(
        F.array_sort(F.collect_list(F.struct("k", "step")))["step"].alias("__steps")
    )
    nothing = rated.where(rate <= 0).select("__source", F.array(F.lit(1.0)).alias("__steps"))
    return steps.unionByName(nothing)


def _numbered_copies(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__equal``: numbers from 1 for rows that agree in all columns and come very often, else 0.

    Such rows are counted and written out again with their numbers, so that they can be dealt over tasks.
    """
    key = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns])).cast("binary"))
    often = documents.select(key.alias("__row")).groupBy("__row").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > OFTEN)
    # at most one key for every ``OFTEN`` rows
    often = materialize(often.select("__row"), "frequent-rows")
    if often.isEmpty():
        return documents.withColumn("__equal", F.lit(0))
    keyed = documents.withColumn("__row", key)
    rare = keyed.join(often, "__row", "left_anti").drop("__row").withColumn("__equal", F.lit(0))
    same = keyed.join(often, "__row", "left_semi").groupBy("__row").agg(
        F.count(F.lit(1)).cast("int").alias("__n"), *[F.first(F.col(f"`{c}`")).alias(c) for c in documents.columns]
    )
    numbered = same.withColumn("__equal", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__row", "__n")
    return rare.unionByName(numbered)


def rates(documents: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, power: float = POWER) -> DataFrame:
    """__source, __rate: mean copies of each source's documents.

    ``weights``: target shares by source, which need not sum to one. ``total``: size of the
    mixed corpus, by default that of ``documents``.
    """
    sizes = documents.groupBy(_source().alias("__source")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).cast("double").alias("size")
    )
    if weights is None:
        shares = sizes.withColumn("share", F.pow("size", F.lit(power)))
    else:
        if any(weight < 0 for weight in weights.values()):
            raise ValueError("target weights must not be negative")
        given = [("=" + source, float(weight)) for source, weight in weights.items()]
        table = documents.sparkSession.createDataFrame(given, "__source string, share double")
        shares = sizes.join(table, "__source")
    sums = shares.agg(F.sum("share").alias("shares"))
    whole = sizes.agg(F.sum("size").alias("sizes"))
    wanted = F.lit(float(total)) if total is not None else F.col("sizes")
    # two tables of one row each
    return shares.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(whole)).select(
        "__source", (wanted * F.col("share") / F.col("shares") / F.col("size")).alias("__rate")
    )


def mix(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    power: float = POWER,
    seed: str = SEED,
    copy_column: str | None = None,
) -> DataFrame:
    """The columns of ``documents`` with each document as often as it was drawn, shuffled."""
    steps = materialize(poisson_steps(rates(documents, weights, total, power)), "rates")
    keyed = _numbered_copies(documents).withColumns({"__source": _source(), "__draw": uniform(seed)})
    drawn = join_spread(keyed, steps, "__source", "__draw")
    copies = F.size(F.filter("__steps", lambda step: step <= F.col("__draw")))
    exploded = drawn.withColumn("__copies", copies).where("__copies > 0").drop("__steps")
    exploded = exploded.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    place = F.xxhash64(F.lit(seed), "__draw", "__copy", "__equal", *[F.col(f"`{c}`") for c in documents.columns if c == "text"])
    dealt = exploded.withColumn("__place", place).repartition("__place").sortWithinPartitions("__place")
    kept = [F.col(f"`{c}`") for c in documents.columns]
    return dealt.select(*kept, *([F.col("__copy").alias(copy_column)] if copy_column else []))
