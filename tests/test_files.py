import datetime

import pytest
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from weft.sources import files

SCHEMA = StructType([StructField("id", StringType(), True, {"logical": "uuid"}), StructField("n", LongType()), StructField("x", DoubleType()), StructField("ok", BooleanType()), StructField("at", TimestampNTZType()), StructField("label", StringType())])
ROW = ("00000000-0000-0000-0000-000000000001", -9223372036854775808, 1.5e-2, True, datetime.datetime(2026, 1, 2, 3, 4, 5, 600), 'a"b,c')


def test_tabular_round_trip(spark, tmp_path):
    df = spark.createDataFrame([ROW, (*ROW[:5], "")], SCHEMA)
    files.write_tabular(df, f"{tmp_path}/t")
    assert sorted(map(tuple, files.read_tabular(spark, f"{tmp_path}/t", SCHEMA).collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("line", ["01,x", "+1,x", "1,x,y", "1", "1.0,x", ",x"])
def test_tabular_rejects(spark, tmp_path, line):
    (tmp_path / "t.csv").write_bytes(f"n,label\r\n{line}\r\n".encode())
    with pytest.raises(Exception, match="tabular|MALFORMED|CAST|arity|header"):
        files.read_tabular(spark, f"{tmp_path}/t.csv", StructType([SCHEMA["n"], SCHEMA["label"]])).collect()


@pytest.mark.parametrize("value", ["NULL", "double('NaN')", "double('Infinity')"])
def test_tabular_has_no_nulls_or_nans(spark, tmp_path, value):
    with pytest.raises(Exception, match="tabular"):
        files.write_tabular(spark.sql(f"SELECT CAST({value} AS DOUBLE) AS x"), f"{tmp_path}/t")


def test_append_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    for token, n in (("a", 3), ("b:1", 2), ("a", 3)):
        files.append_once(spark.range(n), path, token)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError, match="token"):
        files.append_once(spark.range(1), path, "no/slash")


def test_cache_and_digests(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert files.cached(spark.range(3), path, "k").count() == 3
    assert files.cached(spark.range(9), path, "k").count() == 3
    assert files.cache_path("d", "k").startswith("d/k_") and files.cache_path("d", "k").endswith(".parquet")
    (tmp_path / "f").write_bytes(b"abc")
    assert files.digests(spark, f"{tmp_path}/f").first().sha256 == "sha2-256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
