"""Two-stage queries over data that lies on several nodes.

Each node's rows are reduced where they are (scatter) and the partial rows are merged
(gather). Nodes are DataFrames. COUNT is merged by SUM and
is 0 without partial rows; AVG goes as sum and count; group keys always travel, whether
they are shown or not; filters run on the nodes alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotDecomposable(ValueError):
    """An aggregate that has no partial form here, such as one of distinct values."""


@dataclass(frozen=True)
class Aggregate:
    """function (count, sum, avg, min, max) of a column (none: all rows), and the result's name."""

    function: str
    name: str
    column: Column | None = None

    def partial(self) -> list[Column]:
        x = F.lit(1) if self.column is None else self.column
        if self.function == "count":
            return [F.count(x).alias(f"{self.name}__n")]
        if self.function == "avg":
            return [F.sum(x.cast("double")).alias(f"{self.name}__sum"), F.count(x).alias(f"{self.name}__n")]
        if self.function in ("sum", "min", "max"):
            return [getattr(F, self.function)(x).alias(f"{self.name}__{self.function}")]
        raise NotDecomposable(self.function)

    def final(self) -> Column:
        if self.function == "count":
            return F.coalesce(F.sum(f"{self.name}__n"), F.lit(0)).cast("long").alias(self.name)
        if self.function == "avg":
            return F.try_divide(F.sum(f"{self.name}__sum"), F.sum(f"{self.name}__n")).alias(self.name)
        return getattr(F, self.function)(f"{self.name}__{self.function}").alias(self.name)


def _union(nodes: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, nodes)


def over_nodes(nodes: list[DataFrame], keys: list[str], aggregates: list[Aggregate], where: Column | None = None) -> DataFrame:
    """Partial rows of each node (DataFrames of one schema), merged by keys: what the aggregation of all rows gives directly.

    A node without rows adds nothing.
    """
    own = ((n if where is None else n.where(where)).groupBy(*keys).agg(*(p for a in aggregates for p in a.partial())) for n in nodes)
    return _union(own).groupBy(*keys).agg(*(a.final() for a in aggregates))


def passthrough(nodes: list[DataFrame], select: list[Column], where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of all nodes: filtered and projected on each, ordered and limited once; each node sends at most ``limit`` rows."""
    parts = [(n if where is None else n.where(where)).select(*select) for n in nodes]
    if limit is not None:
        parts = [(p.orderBy(*order) if order else p).limit(limit) for p in parts]
    out = _union(parts)
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def by_location(ids: DataFrame, places: DataFrame, here: str) -> DataFrame:
    """cluster and n: how many of ids (column id) each cluster holds by places (id, cluster); unknown ones count as here.

    The ids of a cluster stay rows; they are counted, not gathered into one value.
    """
    return ids.join(places, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(here)))
