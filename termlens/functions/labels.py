"""Relevance labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) of classes 1 to 4; the rest is class 5.
CLASS_BOUNDS = (1.25, 1.75, 2.25, 2.75)

# The relevance each class stands for.
CLASS_VALUES = {1: 1.0, 2: 1.5, 3: 2.0, 4: 2.5, 5: 3.0}


def cast_relevance(text: Column | str) -> Column:
    """Float score; text that is no number, "NaN" too, gives null instead of an error."""
    column = F.col(text) if isinstance(text, str) else text
    number = column.try_cast("float")
    return F.when(~F.isnan(number), number)


def relevance_class(relevance: Column | str) -> Column:
    """Class 1 to 5 of a score; a score that is null or NaN has a null class."""
    score = F.col(relevance) if isinstance(relevance, str) else relevance
    number = F.when(score.isNull() | F.isnan(score), None)
    for label, bound in enumerate(CLASS_BOUNDS, start=1):
        number = number.when(score < F.lit(bound), F.lit(label))
    return number.otherwise(F.lit(len(CLASS_BOUNDS) + 1)).cast("int")


def class_value(label: Column | str) -> Column:
    """Representative score of a class; any label outside 1 to 4 counts as 5."""
    number = F.col(label) if isinstance(label, str) else label
    *below, top = sorted(CLASS_VALUES)
    value = F.when(number.isNull(), None)
    for known in below:
        value = value.when(number == F.lit(known), F.lit(CLASS_VALUES[known]))
    return value.otherwise(F.lit(CLASS_VALUES[top]))
