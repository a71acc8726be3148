"""Row explosion that evaluates a costly array expression once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def exploded(df: DataFrame, kept: list, array: Column, value: str,
             pos: str | None = None) -> DataFrame:
    """One row per array element next to the ``kept`` columns; ``pos`` counts from 0.

    For an inner explode Spark infers the filter ``size(array) > 0`` and moves it below, which
    computes the array expression again.  The outer form does not have that filter.  Elements
    must not be NULL.
    """
    generator = (F.posexplode_outer(array).alias(pos, value) if pos
                 else F.explode_outer(array).alias(value))
    return df.select(*kept, generator).where(F.col(value).isNotNull())
