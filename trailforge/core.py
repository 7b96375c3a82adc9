"""Transformers and their composition."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """A table lacks columns that a transformer needs."""


def require(schema: T.StructType, columns: Iterable[str]) -> None:
    """Fail with the names of the columns that ``schema`` lacks."""
    missing = [c for c in dict.fromkeys(columns) if c not in schema.fieldNames()]
    if missing:
        raise MissingColumns(f"The {', '.join(missing)} columns are not in the table, which has {', '.join(schema.fieldNames())}")


class Transformer:
    """A lazy function of tables; subclasses name the columns they need and build the plan."""

    def required(self) -> list[str]:
        return []

    def build(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        require(df.schema, self.required())
        return self.build(df)

    __call__ = transform


def process(df: DataFrame, *steps: Transformer) -> DataFrame:
    """The steps in order; every one is checked against the schema that it really gets, before any job runs."""
    for step in steps:
        df = step.transform(df)
    return df
