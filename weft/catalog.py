"""Relations with a declared schema, as Spark temporary views.

The host declares types, nullability and field metadata; they are laid over what a file
says, since Parquet columns always come back nullable. A catalog has a snapshot id, and a
JSON document holds it whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, NullType, NumericType, StringType, StructField, StructType, TimestampNTZType, TimestampType

# The logical types and the Spark types that hold them.
LOGICAL = {"boolean": BooleanType(), "int32": IntegerType(), "int64": LongType(), "float64": DoubleType(), "utf8": StringType(), "uuid": StringType(), "json": StringType(), "date": DateType(), "timestamp": TimestampNTZType(), "timestamp_utc": TimestampType(), "unknown": NullType()}


def common_type(a: DataType, b: DataType) -> DataType | None:
    """The type that both promote to: equal ones, null with any, int with long, either with double, lists by element; else none."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        inner = common_type(a.elementType, b.elementType)
        return inner and ArrayType(inner, a.containsNull or b.containsNull)
    order = [IntegerType(), LongType(), DoubleType()]
    return order[max(order.index(a), order.index(b))] if a in order and b in order else None


@dataclass
class Relation:
    name: str
    schema: StructType
    aliases: tuple[str, ...] = ()
    kind: str = "table"
    metadata: dict = field(default_factory=dict)

    def over(self, df: DataFrame) -> DataFrame:
        """df with this relation's columns, types, nullability and metadata; unknown columns of df are left out."""
        cast = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in self.schema))
        if all(f.nullable for f in self.schema):
            return cast
        checked = cast.select(*(F.coalesce(F.col(f"`{f.name}`"), F.raise_error(F.lit(f"{self.name}.{f.name} is null")).cast(f.dataType)).alias(f.name, metadata=f.metadata) if not f.nullable else F.col(f"`{f.name}`") for f in self.schema))
        return checked


class Catalog:
    """Relations by lower-cased name and alias."""

    def __init__(self, snapshot: str):
        self.snapshot = snapshot
        self.relations: dict[str, Relation] = {}

    def add(self, relation: Relation) -> None:
        self.relations[relation.name.lower()] = relation

    def find(self, name: str) -> Relation | None:
        key = name.lower()
        return self.relations.get(key) or next((r for r in self.relations.values() if key in map(str.lower, r.aliases)), None)

    def register(self, spark: SparkSession, frames: dict[str, DataFrame]) -> None:
        """Makes each relation, under its name and aliases, a temporary view over the given frame."""
        for name, df in frames.items():
            relation = self.find(name)
            shown = relation.over(df) if relation else df
            for alias in (name, *(relation.aliases if relation else ())):
                shown.createOrReplaceTempView(alias)

    def to_json(self) -> str:
        return json.dumps({"snapshot": self.snapshot, "relations": [{"name": r.name, "aliases": list(r.aliases), "kind": r.kind, "metadata": r.metadata, "schema": r.schema.jsonValue()} for r in self.relations.values()]}, sort_keys=True)

    @classmethod
    def from_json(cls, document: str) -> Catalog:
        read = json.loads(document)
        out = cls(read["snapshot"])
        for r in read["relations"]:
            out.add(Relation(r["name"], StructType.fromJson(r["schema"]), tuple(r["aliases"]), r["kind"], r["metadata"]))
        return out


def portable(df: DataFrame) -> DataFrame:
    """Result columns in the portable contract's types: decimals of expressions and floats become double, smaller ints int."""

    def kind(f: StructField) -> DataType:
        if isinstance(f.dataType, NumericType) and f.dataType not in (IntegerType(), LongType(), DoubleType()):
            return IntegerType() if f.dataType.simpleString() in ("tinyint", "smallint") else DoubleType()
        return f.dataType

    return df.select(*(F.col(f"`{f.name}`").cast(kind(f)).alias(f.name) if kind(f) != f.dataType and not isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`") for f in df.schema))
