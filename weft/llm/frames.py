"""Spark helpers that several of the corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

#: Stands in for a null doc_id, which thus comes before all others.
NO_ID = -(1 << 63)
#: Rows that a Python worker looks at together.
ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """Only what the operators read: _k (doc_id, or NO_ID), doc_id and text, whatever else docs holds.

    rest: the other columns go along as a struct of that name.
    """
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(*own, *([F.struct(*(others or [F.lit(None).cast("int").alias("_")])).alias("rest")] if rest else []))


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from df's doc_id, text and rest."""
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in like.columns))


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch of at most ROWS rows, so that few texts are held at once; none is empty."""

    def over(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from each(batch.slice(at, ROWS))

    return df.mapInArrow(over, schema)


def packed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """keyed(docs, rest) with its texts compressed (null stays null), as they travel through a shuffle."""
    source = keyed(docs, rest)
    schema = StructType().add("_k", LongType()).add("doc_id", LongType()).add("packed", BinaryType())
    if rest:
        schema = schema.add(source.schema["rest"])

    def each(batch):
        press = zstandard.ZstdCompressor(level=1)
        texts = [None if t is None else press.compress(t.encode()) for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.binary()), *batch.columns[3:]], schema.names)

    return arrow_map(source, each, schema)


def unpack(column: pa.Array) -> pa.Array:
    """The texts of packed() again."""
    press = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else press.decompress(t.as_buffer()).decode() for t in column_scalars(column)], pa.large_string())


def column_scalars(column: pa.Array):
    for i, ok in enumerate(column.is_valid().to_pylist()):
        yield column[i] if ok else None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as spark.checkpoint.dir names it.

    Where that is unset, a session within one machine gets a folder in /tmp, and one on a
    cluster a ValueError, since no folder of one machine would do.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of stored(), or of what was made of one, that nothing will read again."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that are over, which else stay until the driver happens to collect its garbage."""
    spark._jvm.System.gc()


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """stored(df), in as many buckets of ``key`` as the session has shuffle partitions, so that joins by it need not move it."""
    spark = df.sparkSession
    name = f"weft_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    return spark.table(name)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links (a long, b long): the least id that links reach.

    Alternating large-star and small-star steps: each is one shuffle of at most the
    edges, a node's neighbours are never gathered, only their least is taken, so a node
    with very many links costs no more memory than one with few.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        edges = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
