"""Files in and out: result formats, repeatable appends, a result cache, content digests, strict tabular CSV."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType, TimestampNTZType

FORMATS = ("parquet", "csv", "json", "orc")
_TOKEN = re.compile(r"[A-Za-z0-9_:-]+")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """A result in one of FORMATS."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    writer = df.write.mode(mode)
    (writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path))


def append_once(df: DataFrame, path: str, token: str) -> None:
    """Appends df under a token; the same token again replaces what it wrote, so a repeated call adds nothing.

    The token is a partition of the files; dynamic overwriting touches that partition only.
    """
    if not _TOKEN.fullmatch(token):
        raise ValueError("a token has letters, digits, _, : and - only")
    df.withColumn("batch_token", F.lit(token)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_token").parquet(path)


def append_json(rows: DataFrame, schema: StructType, path: str, token: str) -> None:
    """append_once() of rows given as JSON objects, one in the only column of each row; ValueError of Spark's where one is none."""
    text = F.col(rows.columns[0])
    append_once(rows.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"), path, token)


def cache_path(folder: str, key: str) -> str:
    """Where a result of that key is kept."""
    return f"{folder}/{key}_{hashlib.md5(key.encode()).hexdigest()[:12]}.parquet"


def cached(df: DataFrame, folder: str, key: str) -> DataFrame:
    """df from its cache, written there first if it is not yet; ValueError if it has no row. A half-written one does not count: it has no _SUCCESS."""
    spark = df.sparkSession
    path = cache_path(folder, key)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jpath):
        if df.isEmpty():
            raise ValueError("an empty result is not cached")
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of each file in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.concat(F.lit("sha2-256:"), F.sha2("content", 256)).alias("sha256"))


# How the strict tabular profile writes each type.
LEXICAL = {
    "boolean": r"^(true|false)$",
    "bigint": r"^(0|-?[1-9][0-9]*)$",
    "double": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z$",
}


def _kind(field) -> str | None:
    if field.metadata.get("logical") == "uuid":
        return "uuid"
    return {BooleanType(): "boolean", LongType(): "bigint", DoubleType(): "double", TimestampNTZType(): "timestamp_ntz"}.get(field.dataType)


def write_tabular(df: DataFrame, path: str) -> None:
    """Strict CSV: header, CRLF, quotes only where needed; a null, a line break in a text or another type is an error."""
    columns = []
    for f in df.schema:
        x = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, (BooleanType, LongType, DoubleType, StringType, TimestampNTZType)):
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} has no tabular form")
        shown = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if isinstance(f.dataType, TimestampNTZType) else x.cast("string")
        wrong = x.isNull() | (shown.rlike(r"[\r\n]") if isinstance(f.dataType, StringType) else F.isnan(x) | x.isin(float("inf"), float("-inf")) if isinstance(f.dataType, DoubleType) else F.lit(False))
        columns.append(F.when(wrong, F.raise_error(F.lit(f"{f.name} has a value without tabular form"))).otherwise(shown).alias(f.name))
    df.select(*columns).write.option("header", True).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_tabular(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Reads what write_tabular() wrote; anything else fails when the rows are used.

    Each line must end with CRLF, have all fields, and hold values of just the lexical form
    that the type has; the header must be the schema's names.
    """
    texts = StructType([type(f)(f.name, StringType(), True) for f in schema])
    raw = spark.read.schema(texts.add("_corrupt", StringType())).option("header", True).option("enforceSchema", False).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)

    def checked(f) -> Column:
        x, kind = F.coalesce(F.col(f"`{f.name}`"), F.lit("")), _kind(f)
        bad = F.col("_corrupt").isNotNull() | (~x.rlike(LEXICAL[kind]) if kind else x.rlike(r"[\r\n]"))
        value = F.to_timestamp_ntz(F.regexp_replace(x, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")) if kind == "timestamp_ntz" else x.cast(f.dataType)
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{f.name}: not in tabular form: "), x))).otherwise(value).alias(f.name, metadata=f.metadata)

    return raw.select(*map(checked, schema))
