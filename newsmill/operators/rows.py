"""From arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unnest(
    df: DataFrame, array: Column | str, value: str, pos: str, *keep: Column | str
) -> DataFrame:
    """A row per element: the kept columns, its position and the element.

    A plain explode makes the optimiser add a filter on the size of the array, which
    is then pushed down and computes the whole array a second time.  The outer form
    does not; its rows for empty arrays are dropped here.
    """
    a = F.col(array) if isinstance(array, str) else array
    out = df.select(*keep, F.posexplode_outer(a).alias(pos, value))
    return out.where(F.col(pos).isNotNull())


def settle(df: DataFrame) -> DataFrame:
    """The same rows, with their computed columns evaluated at this point.

    A filter on a computed column is pushed below its projection, which evaluates
    the column once for every mention in the filter and again for the result.  Text
    and markup expressions are too dear for that; a generator in between holds the
    filters back.
    """
    return (
        df.select(F.explode_outer(F.array(F.struct("*"))).alias("_row")).select("_row.*")
    )
