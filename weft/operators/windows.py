"""Window aggregates that Spark's OVER does not take as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def filtered(function: str, value: Column, where: Column, over: WindowSpec) -> Column:
    """f(value) FILTER (WHERE where) OVER (over)."""
    return getattr(F, function)(F.when(where, value)).over(over)


def distinct_count(value: Column, partition: list[Column]) -> Column:
    """COUNT(DISTINCT value) OVER (PARTITION BY partition), without a frame.

    The greatest dense rank of a value that is not null, 0 where a partition has none; no set of values is built.
    """
    from pyspark.sql import Window

    up = F.dense_rank().over(Window.partitionBy(*partition).orderBy(value.asc_nulls_last()))
    return F.coalesce(F.max(F.when(value.isNotNull(), up)).over(Window.partitionBy(*partition)), F.lit(0)).cast("long")
