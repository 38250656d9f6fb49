"""Aggregate states: partial results that can be stored and merged later.

A state holds count, sum, min, max, mean and m2 (the sum of squared deviations from the
mean) of one column. Two passes of plain aggregation build and merge them, each with
Spark's own partial aggregation; m2 merges by the means' spread round the whole's mean,
which is stable where sums of squares are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the merges.
MERGES = ("count", "sum", "avg", "min", "max", "varpop", "stddevpop")


def build(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """One row a key: the keys and ``state``. Nulls of the value count for nothing."""
    x = value.cast("double")
    return df.groupBy(*keys).agg(F.struct(F.count(x).alias("n"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2")).alias("state"))


def merge(states: DataFrame, keys: list[str], *merges: str) -> DataFrame:
    """The keys and a column for each of MERGES that is asked for. No state, or only empty ones, counts 0 and gives null else."""
    s = {c: F.col(f"state.{c}") for c in ("n", "sum", "min", "max", "mean", "m2")}
    rows = states
    spread = F.lit(None).cast("double")
    if {"varpop", "stddevpop"} & set(merges):
        every = Window.partitionBy(*keys)
        rows = states.withColumn("_mean", F.try_divide(F.sum("state.sum").over(every), F.sum("state.n").over(every)))
        spread = F.sum(s["m2"] + s["n"] * (s["mean"] - F.col("_mean")) * (s["mean"] - F.col("_mean")))
    inner = rows.groupBy(*keys).agg(F.sum(s["n"]).alias("n"), F.sum(s["sum"]).alias("sum"), F.min(s["min"]).alias("min"), F.max(s["max"]).alias("max"), spread.alias("spread"))
    varpop = F.try_divide("spread", "n")
    out = {"count": F.coalesce("n", F.lit(0)).cast("long"), "sum": F.col("sum"), "avg": F.try_divide("sum", "n"), "min": F.col("min"), "max": F.col("max"), "varpop": varpop, "stddevpop": F.sqrt(varpop)}
    return inner.select(*keys, *(out[m].alias(m) for m in merges))


def declared(df: DataFrame, column: str, by: str) -> DataFrame:
    """A table of states whose ``column`` says, in its metadata, which of MERGES reads it."""
    if by not in MERGES:
        raise ValueError(f"no such merge: {by}")
    return df.withMetadata(column, {"merge": by})


def read(table: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and each declared state column of table, merged as its metadata says, under its own name; other columns are left out."""
    merges = {f.name: f.metadata["merge"] for f in table.schema if "merge" in f.metadata}
    out = None
    for name, by in merges.items():
        one = merge(table.select(*keys, F.col(f"`{name}`").alias("state")), keys, by).select(*(F.col(k).alias(f"_{k}") if out is not None else F.col(k) for k in keys), F.col(by).alias(name))
        out = one if out is None else out.join(one, [out[k].eqNullSafe(one[f"_{k}"]) for k in keys]).drop(*(f"_{k}" for k in keys))
    if out is None:
        raise ValueError("no column declares a merge")
    return out
