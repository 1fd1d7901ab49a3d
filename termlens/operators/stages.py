"""The text functions as pipeline stages, so that a stored model takes raw text, in tables and in streams."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.functions.text import bigrams, clean_tokens, join_tokens


class _Stage(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One native expression of the input columns."""

    def _made(self, *inputs: Column) -> Column:
        raise NotImplementedError


class _OneColumn(_Stage, HasInputCol):
    def __init__(self, input_column: str | None = None, output_column: str | None = None) -> None:
        super().__init__()
        if input_column is not None:
            self._set(inputCol=input_column, outputCol=output_column)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self._made(F.col(self.getInputCol())))


class _ManyColumns(_Stage, HasInputCols):
    def __init__(self, input_columns: list[str] | None = None, output_column: str | None = None) -> None:
        super().__init__()
        if input_columns is not None:
            self._set(inputCols=input_columns, outputCol=output_column)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self._made(*[F.col(c) for c in self.getInputCols()]))


class CleanTokens(_OneColumn):
    """Text to cleaned tokens."""

    def _made(self, *inputs: Column) -> Column:
        return clean_tokens(inputs[0])


class JoinTokens(_ManyColumns):
    """Token arrays one behind the other."""

    def _made(self, *inputs: Column) -> Column:
        return join_tokens(*inputs)


class Bigrams(_OneColumn):
    """Tokens to the bigrams of neighbours."""

    def _made(self, *inputs: Column) -> Column:
        return bigrams(inputs[0])


class TokenNumber(_OneColumn):
    """Tokens to a vector of one entry, their number."""

    def _made(self, *inputs: Column) -> Column:
        return array_to_vector(F.array(F.size(inputs[0]).cast("double")))


class PlainVector(_OneColumn):
    """A vector column without the names of its entries, which would travel with every task."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        plain = F.col(self.getInputCol()).alias(self.getOutputCol(), metadata={})
        others = [F.col(f"`{c}`") for c in dataset.columns if c not in (self.getInputCol(), self.getOutputCol())]
        return dataset.select(*others, plain)
