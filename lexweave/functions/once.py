"""Evaluating costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that later filters and projections read rather than evaluate again.

    The optimizer copies a projection's expressions into filters above it and into projections that use them; it does not
    do so through a generator, so the columns go through one of a single row.
    """
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, made).select(*(F.col(f"_once.{c}").alias(c) if c in columns else F.col(c) for c in [*df.columns, *(n for n in columns if n not in df.columns)]))
