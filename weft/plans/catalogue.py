"""The registered queries over the star schema, each with the SQL that it must agree with."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import portable
from weft.operators import federated, governance, states, windows
from weft.plans import engine
from weft.sources import files

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Queries whose text Spark and the oracle both run as it stands.
SQL = {
    "scan_filter_project": 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000',
    "const_select": 'SELECT 1 AS one FROM nation',
    "wildcard": 'SELECT * FROM region',
    "qualified_wildcard": 'SELECT n.* FROM nation AS n LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey',
    "distinct": 'SELECT DISTINCT o_orderstatus FROM orders',
    "arith_unary": 'SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber / 2 AS half, -l_linenumber AS neg FROM lineitem',
    "bool_logic": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 30 AND l_discount < 0.05) OR NOT (l_returnflag = 'N')",
    "between": 'SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.02 AND 0.04',
    "in_list": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')",
    "like": "SELECT c_custkey FROM customer WHERE c_name LIKE '%1' AND c_mktsegment NOT LIKE 'B%'",
    "ilike": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'",
    "is_null": 'SELECT p.p_partkey FROM part AS p LEFT JOIN supplier AS s ON p.p_partkey = s.s_suppkey WHERE s.s_suppkey IS NULL',
    "case_searched": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS bucket FROM lineitem",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "cast": 'SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS k, CAST(o_orderdate AS DATE) AS d FROM orders',
    "scalar_subquery": 'SELECT o_orderkey, (SELECT COUNT(*) FROM nation) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)',
    "in_subquery": 'SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)',
    "not_in_subquery": 'SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)',
    "exists": 'SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000)',
    "join_inner": 'SELECT o.o_orderkey, c.c_name FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey',
    "join_left": 'SELECT p.p_partkey, s.s_name FROM part AS p LEFT JOIN supplier AS s ON p.p_partkey = s.s_suppkey',
    "join_right": 'SELECT s.s_name, p.p_partkey FROM supplier AS s RIGHT JOIN part AS p ON p.p_partkey = s.s_suppkey',
    "join_full": 'SELECT s.s_suppkey, o.p_partkey FROM supplier AS s FULL JOIN (SELECT p_partkey FROM part WHERE p_partkey > 50) AS o ON s.s_suppkey = o.p_partkey',
    "join_cross": 'SELECT n.n_name, r.r_name FROM nation AS n CROSS JOIN region AS r',
    "join_comma": 'SELECT n.n_name, r.r_name FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey',
    "join_theta": 'SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a INNER JOIN nation AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey',
    "join_nested": 'SELECT n.n_name, COUNT(*) AS c FROM nation AS n INNER JOIN (customer AS cu INNER JOIN orders AS o ON cu.c_custkey = o.o_custkey) ON n.n_nationkey = cu.c_nationkey GROUP BY n.n_name',
    "join_multi_agg": 'SELECT r.r_name, CAST(COUNT(*) AS BIGINT) AS orders FROM region AS r INNER JOIN nation AS n ON r.r_regionkey = n.n_regionkey INNER JOIN customer AS c ON c.c_nationkey = n.n_nationkey INNER JOIN orders AS o ON o.o_custkey = c.c_custkey GROUP BY r.r_name',
    "group_by_having": 'SELECT o_custkey, COUNT(*) AS n, AVG(o_orderkey) AS m FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12',
    "global_agg": 'SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS s, ROUND(AVG(l_quantity), 4) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem',
    "empty_agg": 'SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderdate) AS m FROM orders WHERE o_totalprice < -1',
    "count_distinct": 'SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag',
    "agg_filter": 'SELECT l_linestatus, COUNT(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY l_linestatus',
    "window_ranking": 'SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS dr, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders',
    "window_lag_lead": 'SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders',
    "window_first_last": 'SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders',
    "window_agg": 'SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS running FROM orders',
    "order_limit_offset": 'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 25 OFFSET 5',
    "union_all": 'SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey AS k FROM supplier',
    "cte": 'WITH big (k, p) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT k FROM big',
    "derived": 'SELECT d.k, d.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS d WHERE d.n > 10',
    "scalar_fns": 'SELECT c_custkey, COALESCE(c_acctbal, 0.0) AS c, SQRT(ABS(c_acctbal)) AS r, GREATEST(c_acctbal, 100.0) AS h, LEAST(c_acctbal, 100.0) AS l FROM customer',
    "to_string": 'SELECT o_orderkey, CAST(o_custkey AS VARCHAR(20)) AS s FROM orders',
    "fed_partial": 'SELECT o_custkey, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) AS p GROUP BY o_custkey',
    "sum_decimal": 'SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag',
    "median_exact": 'SELECT o_orderstatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS q FROM orders GROUP BY o_orderstatus',
    "stddev_merge_target": 'SELECT ROUND(STDDEV_POP(l_quantity), 6) AS s, ROUND(VAR_POP(l_quantity), 6) AS v FROM lineitem',
    "window_filter_rewrite": "SELECT o_orderkey, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS BIGINT) AS f FROM orders",
    "not_exists": "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)",
    "join_inner_where": "SELECT n.n_name, r.r_name FROM nation AS n JOIN region AS r ON TRUE WHERE n.n_regionkey = r.r_regionkey",
    "chained_cte": "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE n > 15) SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM b)",
    "scan_1k": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey NULLS LAST LIMIT 1000",
    "key_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 777",
    "scan_1k_second": "SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_partkey NULLS LAST LIMIT 1000",
    "wide_10k": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey NULLS LAST LIMIT 10000",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(text: str, spark: SparkSession, sf_dir: str, values: list | dict | None = None) -> DataFrame:
    """The query over the tables it names; views of these names that the session has are as before afterwards."""
    own = [name for name in TABLES if re.search(rf"\b{name}\b", text)]
    had = {name: spark.table(name) for name in own if spark.catalog.tableExists(name)}
    for name in own:
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    try:
        return engine.dataframe(spark, text, values, strict="WITHIN GROUP" not in text)
    finally:
        for name in own:
            spark.catalog.dropTempView(name)
            if name in had and not spark.catalog.tableExists(name):
                had[name].createOrReplaceTempView(name)


def _money(name: str):
    """A price as decimal, so that sums do not hang on the order of rows."""
    return F.col(name).cast("decimal(18,2)")


def fed_aggregates(spark, sf_dir):
    """All decomposable aggregates, over two nodes and merged."""
    orders = _table(spark, sf_dir, "orders")
    nodes = [orders.where(F.coalesce(F.col("o_orderkey") % 2, F.lit(0)) == i) for i in range(2)]
    key = F.col("o_orderkey")
    wanted = [federated.Aggregate("count", "n"), federated.Aggregate("sum", "total", key), federated.Aggregate("avg", "mean", key), federated.Aggregate("min", "low", key), federated.Aggregate("max", "high", key)]
    return federated.over_nodes(nodes, ["o_custkey"], wanted, F.col("o_totalprice") > 1000)


def fed_nodes(spark, sf_dir):
    """Nodes as DataFrames, one of them empty."""
    orders = _table(spark, sf_dir, "orders")
    nodes = [orders.where(F.col("o_orderkey") % 3 == i) for i in range(4)]
    return federated.over_nodes(nodes, ["o_orderstatus"], [federated.Aggregate("count", "n"), federated.Aggregate("max", "high", F.col("o_totalprice"))])


def fed_global(spark, sf_dir):
    """A global count over nodes without any row."""
    orders = _table(spark, sf_dir, "orders").where("o_totalprice < -1")
    return federated.over_nodes([orders, orders], [], [federated.Aggregate("count", "n"), federated.Aggregate("avg", "mean", F.col("o_totalprice"))])


def fed_passthrough(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    nodes = [orders.where(F.col("o_orderkey") % 4 == i) for i in range(4)]
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]
    return federated.passthrough(nodes, [F.col("o_orderkey"), F.col("o_totalprice")], F.col("o_orderstatus") == "F", order, 50)


def fed_location(spark, sf_dir):
    """Orders by the region that their customer lies in, as the place of each id."""
    ids = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    places = _table(spark, sf_dir, "customer").where("c_nationkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), (F.col("c_nationkey") % 5).cast("string")).alias("cluster"))
    return federated.by_location(ids, places, "here").groupBy("cluster").agg(F.count("*").alias("n"))


def _lineitem_states(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").withColumn("shard", F.col("l_orderkey") % 8)
    return states.build(lines, ["l_returnflag", "shard"], F.col("l_quantity"))


def state_merge(spark, sf_dir):
    """States by shard, merged: count, sum, avg, min and max."""
    merged = states.merge(_lineitem_states(spark, sf_dir), ["l_returnflag"], "count", "sum", "avg", "min", "max")
    return merged.select("l_returnflag", F.col("count").alias("n"), F.col("sum").alias("s"), F.col("avg").alias("a"), F.col("min").alias("lo"), F.col("max").alias("hi"))


def state_merge_spread(spark, sf_dir):
    """Variance and deviation from states, in thousandths, so that the last bits do not show."""
    merged = states.merge(_lineitem_states(spark, sf_dir), ["l_returnflag"], "varpop", "stddevpop")
    return merged.select("l_returnflag", F.floor(F.col("varpop") * 1000 + 0.5).cast("long").alias("v"), F.floor(F.col("stddevpop") * 1000 + 0.5).cast("long").alias("s"))


def window_filter(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    whole = Window.partitionBy("o_custkey")
    return orders.select("o_orderkey", windows.filtered("count", F.col("o_orderkey"), F.col("o_orderstatus") == "F", whole).alias("n"), windows.filtered("max", F.col("o_totalprice"), F.col("o_orderpriority") == "1-URGENT", whole).alias("high"))


def window_distinct(spark, sf_dir):
    """Some customers have no priority but null."""
    orders = _table(spark, sf_dir, "orders")
    known = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority"))
    return orders.select("o_orderkey", windows.distinct_count(known, [F.col("o_custkey")]).alias("n"))


def quantiles(spark, sf_dir):
    """The three quartiles, interpolated, in whole hundredths."""
    orders = _table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderstatus").agg(*(F.floor(portable.quantile(F.col("o_totalprice"), q / 100, exact=True) * 100 + 0.5).cast("long").alias(f"q{q}") for q in (25, 50, 75)))


def parameter_positions(spark, sf_dir):
    return _sql("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", spark, sf_dir, [150000.0, "F"])


def parameter_list(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer")
    wanted = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    return customers.where(portable.in_list(F.col("c_mktsegment"), wanted)).select("c_custkey")


def from_first(spark, sf_dir):
    return _sql("FROM nation WHERE n_regionkey = 1\nSCOPE local\nDOWNLOAD arrow", spark, sf_dir)


def tuple_fields(spark, sf_dir):
    made = _table(spark, sf_dir, "nation").select("n_nationkey", portable.pair(F.col("n_name"), F.col("n_regionkey")).alias("t"))
    return made.select("n_nationkey", F.col("t._0").alias("a"), F.col("t._1").alias("b"))


def array_literal(spark, sf_dir):
    made = _table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.col("n_nationkey"), F.col("n_regionkey")).alias("a"))
    return made.select("n_nationkey", F.element_at("a", 1).alias("first"), F.size("a").cast("long").alias("n"))


def to_string_function(spark, sf_dir):
    portable_functions = portable.Registry()
    portable_functions.install(spark)
    return _sql("SELECT c_custkey, toString(c_nationkey) AS s FROM customer", spark, sf_dir)


def _shared(spark) -> str:
    """A new folder in spark.checkpoint.dir; only a session within one machine may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or '/tmp/checkpoints'}/{uuid.uuid4().hex}"


def append_twice(spark, sf_dir):
    """The same batch appended twice under one token, and another under its own."""
    at, parts = _shared(spark), _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    for token, rows in (("a", parts.where("p_partkey % 2 = 0")), ("b", parts.where("p_partkey % 2 = 1")), ("a", parts.where("p_partkey % 2 = 0"))):
        files.append_once(rows, at, token)
    return spark.read.parquet(at).select("p_partkey", "p_size")


def tabular_round_trip(spark, sf_dir):
    """Written as strict CSV and read back with its checks."""
    at, made = _shared(spark), _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.write_tabular(made, at)
    return files.read_tabular(spark, at, made.schema)


def cached_result(spark, sf_dir):
    at, made = _shared(spark), _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    files.cached(made, at, "suppliers")
    return files.cached(made, at, "suppliers")


def json_round_trip(spark, sf_dir):
    at, made = _shared(spark), _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    files.write(made, at, "json")
    return spark.read.schema(made.schema).json(at)


def json_insert(spark, sf_dir):
    """Rows given as JSON, inserted twice under one token."""
    at, made = _shared(spark), _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    for _ in range(2):
        files.append_json(made.select(F.to_json(F.struct(*made.columns)).alias("row")), made.schema, at, "suppliers")
    return spark.read.parquet(at).select(*made.columns)


def state_table(spark, sf_dir):
    """Two state columns by shard, read by the merges that their metadata names."""
    lines = _table(spark, sf_dir, "lineitem").withColumn("shard", F.col("l_orderkey") % 8)
    keys = ["l_returnflag", "shard"]
    quantity = states.build(lines, keys, F.col("l_quantity")).withColumnRenamed("state", "mean")
    number = states.build(lines, keys, F.col("l_linenumber")).withColumnRenamed("state", "high")
    both = states.declared(states.declared(quantity.join(number, keys), "mean", "avg"), "high", "max")
    return states.read(both, ["l_returnflag"]).select("l_returnflag", F.floor(F.col("mean") * 1000 + 0.5).cast("long").alias("mean"), F.col("high").cast("long").alias("high"))


def import_actions(spark, sf_dir):
    """What an import of the orders of each customer would do, where a third of them is there, a third differs and a third is not."""
    orders = _table(spark, sf_dir, "orders").where("o_custkey is not null")
    bundle = orders.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.sum("o_orderkey").cast("string").alias("digest"), F.count("*").alias("rows"))
    present = bundle.where("cast(path as bigint) % 3 <> 0").withColumn("rows", F.col("rows") + (F.col("path").cast("long") % 3 - 1))
    return governance.import_plan(bundle, present).groupBy("action").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))


def import_repeated(spark, sf_dir):
    """Orders whose keys no receipt has."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return governance.import_new(orders, orders.where("o_orderkey % 4 <> 1"), "o_orderkey")


def access_filter(spark, sf_dir):
    """Orders that customer 7 may see, by mode, ownership, group and agreement."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    resources = orders.select(F.col("o_orderkey").alias("resource"), F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "P", "registered").otherwise("restricted").alias("mode"), F.col("o_custkey").cast("string").alias("owner"))
    members = customers.select(F.col("c_custkey").cast("string").alias("account"), F.col("c_nationkey").alias("group"))
    grants = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("resource"), (F.col("o_orderkey") % 25).cast("int").alias("group"))
    agreements = orders.where("o_orderkey % 100 = 3").select((F.col("o_custkey") % 10).cast("string").alias("account"), F.col("o_orderkey").alias("resource"))
    return governance.allowed(resources, "7", members, grants, agreements).where("allowed").select("resource", "mode")


def _log(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "deleted").when(F.col("event_id") % 11 == 0, "restored").otherwise(F.col("event_type"))
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor"), kind.alias("activity"), F.col("ts").alias("at"), (F.col("user_id") % 50).alias("resource"))


def provenance_history(spark, sf_dir):
    log = _log(spark, sf_dir)
    return governance.history(log, tag="deleted").select("seq", "actor", "at")


def provenance_numbered(spark, sf_dir):
    return governance.numbered(_log(spark, sf_dir), "resource").select("seq", "resource", "number")


def visible_resources(spark, sf_dir):
    log = _log(spark, sf_dir)
    return governance.visible(log.select("resource").distinct(), log)


_KIND = "CASE WHEN event_id % 7 = 0 THEN 'deleted' WHEN event_id % 11 = 0 THEN 'restored' ELSE event_type END"

#: Composed queries and what they must agree with.
COMPOSED: dict[Callable, str] = {
    fed_aggregates: "SELECT o_custkey, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS total, AVG(o_orderkey) AS mean, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey",
    fed_nodes: "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS high FROM orders GROUP BY o_orderstatus",
    fed_global: "SELECT COUNT(*) AS n, AVG(o_totalprice) AS mean FROM orders WHERE o_totalprice < -1",
    fed_passthrough: "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 50",
    fed_location: "SELECT CASE WHEN c_nationkey % 5 <> 0 THEN 'c' || (c_nationkey % 5) ELSE 'here' END AS cluster, COUNT(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    state_merge: "SELECT l_returnflag, COUNT(l_quantity) AS n, SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag",
    state_merge_spread: "SELECT l_returnflag, CAST(FLOOR(VAR_POP(l_quantity) * 1000 + 0.5) AS BIGINT) AS v, CAST(FLOOR(STDDEV_POP(l_quantity) * 1000 + 0.5) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
    window_filter: "SELECT o_orderkey, COUNT(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey) AS high FROM orders",
    window_distinct: "SELECT o_orderkey, COUNT(DISTINCT CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END) OVER (PARTITION BY o_custkey) AS n FROM orders",
    quantiles: "SELECT o_orderstatus, CAST(FLOOR(QUANTILE_CONT(o_totalprice, 0.25) * 100 + 0.5) AS BIGINT) AS q25, CAST(FLOOR(QUANTILE_CONT(o_totalprice, 0.5) * 100 + 0.5) AS BIGINT) AS q50, CAST(FLOOR(QUANTILE_CONT(o_totalprice, 0.75) * 100 + 0.5) AS BIGINT) AS q75 FROM orders GROUP BY o_orderstatus",
    parameter_positions: "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.0 AND o_orderstatus = 'F'",
    parameter_list: "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    from_first: "SELECT * FROM nation WHERE n_regionkey = 1",
    tuple_fields: "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation",
    array_literal: "SELECT n_nationkey, n_nationkey AS first, CAST(2 AS BIGINT) AS n FROM nation",
    to_string_function: "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS s FROM customer",
    append_twice: "SELECT p_partkey, p_size FROM part",
    tabular_round_trip: "SELECT c_custkey, c_name, c_acctbal FROM customer",
    cached_result: "SELECT s_suppkey, s_name FROM supplier",
    json_round_trip: "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    json_insert: "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    state_table: "SELECT l_returnflag, CAST(FLOOR(AVG(l_quantity) * 1000 + 0.5) AS BIGINT) AS mean, CAST(MAX(l_linenumber) AS BIGINT) AS high FROM lineitem GROUP BY l_returnflag",
    import_actions: """
        WITH b AS (SELECT o_custkey AS c, COUNT(*) AS rows FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)
        SELECT CASE c % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'keep' ELSE 'refuse' END AS action, COUNT(*) AS n, CAST(SUM(rows) AS BIGINT) AS rows FROM b GROUP BY 1""",
    import_repeated: "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 1 OR o_orderkey IS NULL",
    access_filter: """
        WITH m AS (SELECT c_nationkey AS g FROM customer WHERE c_custkey = 7),
        r AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'P' THEN 'registered' ELSE 'restricted' END AS mode FROM orders)
        SELECT o_orderkey AS resource, mode FROM r
        WHERE mode <> 'restricted' OR o_custkey = 7
          OR (o_orderkey % 10 = 0 AND o_orderkey % 25 IN (SELECT g FROM m))
          OR (o_orderkey % 100 = 3 AND o_custkey % 10 = 7)""",
    provenance_history: f"SELECT event_id AS seq, user_id AS actor, ts AS at FROM events WHERE {_KIND} = 'deleted'",
    provenance_numbered: "SELECT event_id AS seq, user_id % 50 AS resource, ROW_NUMBER() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS number FROM events",
    visible_resources: f"""
        WITH l AS (SELECT user_id % 50 AS resource, {_KIND} AS k, ts, event_id FROM events),
        d AS (SELECT resource, arg_max(k, (ts, event_id)) AS k FROM l WHERE k IN ('deleted', 'restored') GROUP BY resource)
        SELECT DISTINCT l.resource FROM l LEFT JOIN d ON l.resource = d.resource WHERE d.k IS NULL OR d.k <> 'deleted'""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_sql, text) for name, text in SQL.items()} | {f.__name__: f for f in COMPOSED}


def oracle_sql() -> dict[str, str]:
    return SQL | {f.__name__: text for f, text in COMPOSED.items()}
