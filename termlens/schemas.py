"""Schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_FLOAT, _DOUBLE = T.FloatType(), T.DoubleType()
_IDS = T.ArrayType(_INT, containsNull=False)

# External inputs: delimited text with a header, every column a string.
LABELLED_PAIRS_TEXT = _struct(
    product_uid=_TEXT, product_title=_TEXT, search_term=_TEXT, relevance=_TEXT
)
NEW_PAIRS_TEXT = _struct(id=_TEXT, product_uid=_TEXT, product_title=_TEXT, search_term=_TEXT)
ATTRIBUTES_TEXT = _struct(product_uid=_TEXT, name=_TEXT, value=_TEXT)
DESCRIPTIONS_TEXT = _struct(product_uid=_TEXT, product_description=_TEXT)

# Between stages.
PAIRS = _struct(
    id=_LONG, product_uid=_LONG, product_title=_TEXT, search_term=_TEXT, relevance=_TEXT
)
VOCABULARY = _struct(term=_TEXT, tf=_LONG, df=_LONG, term_id=_INT)
ENCODED = _struct(
    id=_LONG, product_uid=_LONG, int_title_tokens=_IDS, int_sterm_tokens=_IDS, relevance=_FLOAT
)
LABELS = _struct(id=_LONG, relevance=_FLOAT)

# Reports.
PREDICTIONS_REPORT = _struct(label=_DOUBLE, prediction=_DOUBLE)
SCORES = _struct(id=_LONG, prediction=_DOUBLE)
