import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from weft.functions import portable
from weft.operators import federated, governance, states, windows


def test_states_equal_the_direct_aggregate(spark):
    rows = spark.sql("SELECT id % 3 AS k, id % 5 AS shard, IF(id % 7 = 0, NULL, 1e9D + id) AS x FROM range(1000)")
    got = states.merge(states.build(rows, ["k", "shard"], F.col("x")), ["k"], *states.MERGES)
    want = rows.groupBy("k").agg(F.count("x"), F.sum("x"), F.avg("x"), F.min("x"), F.max("x"), F.var_pop("x"), F.stddev_pop("x"))
    for a, b in zip(sorted(got.collect()), sorted(want.collect()), strict=True):
        assert a[:2] == b[:2] and list(a[2:]) == pytest.approx(list(b[2:]), rel=1e-9)


def test_states_of_nothing(spark):
    empty = spark.sql("SELECT 1 AS k, CAST(NULL AS DOUBLE) AS x")
    assert tuple(states.merge(states.build(empty, ["k"], F.col("x")), ["k"], *states.MERGES).first()) == (1, 0, None, None, None, None, None, None)


def test_count_over_no_node_rows_is_zero(spark):
    none = spark.range(0)
    assert tuple(federated.over_nodes([none, none], [], [federated.Aggregate("count", "n"), federated.Aggregate("avg", "a", F.col("id"))]).first()) == (0, None)
    with pytest.raises(federated.NotDecomposable):
        federated.over_nodes([none], [], [federated.Aggregate("median", "m", F.col("id"))])


def test_unknown_places_count_as_here(spark):
    ids, places = spark.range(4), spark.sql("SELECT 1L AS id, 'far' AS cluster")
    got = federated.by_location(ids, places, "here").groupBy("cluster").count()
    assert {tuple(r) for r in got.collect()} == {("here", 3), ("far", 1)}


def test_distinct_window_with_nulls(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'b'), (1, 'a'), (1, NULL), (2, NULL) AS t(k, v)")
    got = rows.select("k", windows.distinct_count(F.col("v"), [F.col("k")]).alias("n"))
    assert sorted({tuple(r) for r in got.collect()}, key=repr) == [(1, 2), (2, 0)]


def test_uuid5_within_spark(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    rows = spark.sql("SELECT CONCAT('näme', id) AS a, CAST(id AS STRING) AS b FROM range(50)")
    for r in rows.select("a", "b", portable.uuid5(space, F.col("a"), F.col("b")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.UUID(space), f"{r.a}:{r.b}"))


def test_access(spark):
    resources = spark.sql("SELECT * FROM VALUES ('a', 'open', NULL), ('b', 'registered', NULL), ('c', 'restricted', 'me'), ('d', 'restricted', 'x'), ('e', 'restricted', 'x'), ('f', 'restricted', 'x'), ('g', NULL, 'me') AS t(resource, mode, owner)")
    members = spark.sql("SELECT 'me' AS account, 'g1' AS `group`")
    grants = spark.sql("SELECT 'd' AS resource, 'g1' AS `group` UNION ALL SELECT 'f', 'g2'")
    agreements = spark.sql("SELECT 'me' AS account, 'e' AS resource")
    seen = lambda who: {r.resource for r in governance.allowed(resources, who, members, grants, agreements).where("allowed").collect()}
    assert seen("me") == {"a", "b", "c", "d", "e"}
    assert seen(None) == {"a"}
    assert seen("other") == {"a", "b"}


def test_provenance(spark):
    at = datetime.datetime(2026, 1, 1)
    log = spark.createDataFrame([(1, "x", "created", at, "r1"), (2, "y", "deleted", at, "r1"), (3, "x", "restored", at, "r1"), (4, "x", "deleted", at, "r2")], "seq long, actor string, activity string, at timestamp_ntz, resource string")
    assert [r.seq for r in governance.history(log, actor="x", since=at).collect()] == [1, 3, 4]
    assert governance.history(log, until=at).count() == 0
    names = spark.sql("SELECT * FROM VALUES ('r1'), ('r2'), ('r3') AS t(resource)")
    assert {r.resource for r in governance.visible(names, log).collect()} == {"r1", "r3"}
