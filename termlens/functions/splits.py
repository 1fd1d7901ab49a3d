"""Key-based row splits: the same row always lands in the same set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 1_000_003
_SPREAD = 7919


def percentile_of_key(key: Column | str, salt: int, is_string: bool = False) -> Column:
    """0 to 99, a function of the key alone, so repartitioning cannot change it."""
    column = F.col(key) if isinstance(key, str) else key
    if is_string:
        return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(100)).cast("int")
    # reduced before each product, so no bigint key overflows under ANSI rules
    reduced = F.pmod(column.cast("bigint"), F.lit(_PRIME))
    spread = F.pmod(reduced * F.lit(_SPREAD) + F.lit(salt), F.lit(_PRIME))
    # squared, or two salts would give the same split but for a shift
    mixed = F.pmod(spread * spread + F.lit(salt), F.lit(_PRIME))
    return (mixed % F.lit(100)).cast("int")


def in_share(
    key: Column | str, percent: int = 80, salt: int = 45, is_string: bool = False
) -> Column:
    """True for about ``percent`` of the keys."""
    return percentile_of_key(key, salt, is_string) < F.lit(percent)


def split_name(
    key: Column | str,
    train_percent: int = 80,
    salt: int = 45,
    inner_percent: int | None = None,
    inner_salt: int = 10,
    is_string: bool = False,
) -> Column:
    """'train' or 'test'; with ``inner_percent`` train is cut again into 'train'/'val'.

    A null key is in no split.
    """
    outer = in_share(key, train_percent, salt, is_string)
    column = F.col(key) if isinstance(key, str) else key
    none = F.when(column.isNull(), None)
    if inner_percent is None:
        return none.when(outer, "train").otherwise("test")
    inner = in_share(key, inner_percent, inner_salt, is_string)
    return none.when(outer & inner, "train").when(outer, "val").otherwise("test")
