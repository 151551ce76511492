"""Combining one-row results and fixed lists with tables, without cross joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row (a scalar subquery).

    Spark evaluates the row once and uses it as a constant.
    """
    row = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", row).select(*df.columns, "_one.*")


def with_each(df: DataFrame, name: str, values: Sequence, kind: str = "string") -> DataFrame:
    """Repeat every row for each value of a short fixed list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")))


def fixed_rows(columns: Sequence[str], rows: Sequence[Sequence]) -> Column:
    """A short fixed table as an array of structs, for ``inline``."""
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows])
