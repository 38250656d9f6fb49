"""The portable functions, as columns, and as SQL functions of a session.

The subset has five scalars (coalesce, sqrt, greatest, least, toString), the aggregates
count, sum, avg, min, max and quantile, seven window functions, and merges of aggregate
states (see weft.operators.states). All but toString are Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def to_string(x: Column) -> Column:
    return x.cast("string")


def total(x: Column) -> Column:
    """A sum as double, as the contract types it."""
    return F.sum(x).cast("double")


def rank_long(ranking: Column) -> Column:
    """A ranking function's value as long."""
    return ranking.cast("long")


def quantile(x: Column, level: float = 0.5, exact: bool = False) -> Column:
    """A quantile of a group: approximate in bounded memory, or exact by interpolation."""
    return F.percentile(x, level) if exact else F.percentile_approx(x, level)


def in_list(x: Column, values: Column) -> Column:
    """x IN a list parameter: a null list or no match with a null in it gives null."""
    return F.array_contains(values, x)


def pair(*parts: Column) -> Column:
    """A tuple: a struct of _0, _1 and so on."""
    return F.struct(*(p.alias(f"_{i}") for i, p in enumerate(parts)))


def uuid5(namespace: str, *parts: Column) -> Column:
    """The version 5 UUID of parts joined by colons, within Spark's expressions: SHA-1 with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(F.concat_ws(":", *parts), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


@dataclass(frozen=True)
class Signature:
    """A function that a host adds: its name, kind (scalar, aggregate, window) and body on columns, or a SQL body."""

    name: str
    kind: str
    sql: str | None = None
    body: Callable[..., Column] | None = None


class Registry:
    """Functions by lower-cased name; SQL bodies become temporary functions of a session."""

    def __init__(self):
        self.known: dict[str, Signature] = {}
        self.add(Signature("toString", "scalar", "CREATE OR REPLACE TEMPORARY FUNCTION toString(x STRING) RETURNS STRING RETURN x", to_string))
        self.add(Signature("quantile", "aggregate", None, quantile))

    def add(self, signature: Signature) -> None:
        self.known[signature.name.lower()] = signature

    def find(self, name: str) -> Signature | None:
        return self.known.get(name.lower())

    def install(self, spark: SparkSession) -> None:
        for signature in self.known.values():
            if signature.sql:
                spark.sql(signature.sql)
