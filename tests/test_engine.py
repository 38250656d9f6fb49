import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, NullType, StringType, StructField, StructType

from weft.catalog import Catalog, Relation, common_type
from weft.plans import engine


def test_prepare_takes_directives_off():
    query = engine.prepare("EXPLAIN FROM t WHERE a = 'x ? -- $1' AND b = ? AND c = $2 -- note\nSCOPE Global\nDOWNLOAD parquet")
    assert query.explain and query.scope == "global" and query.download == "parquet"
    assert " ".join(query.text.split()) == "SELECT * FROM t WHERE a = 'x ? -- $1' AND b = :p1 AND c = :p2"
    query = engine.prepare("SELECT a FROM t FORMAT Arrow SETTINGS max_threads = 4, x = 1")
    assert query.settings == {"max_threads": "4", "x": "1"} and query.format == "arrow"
    assert query.text.strip() == "SELECT a FROM t"


@pytest.mark.parametrize(
    ("text", "code"),
    [("", "parse"), ("SELECT 1; SELECT 2", "parse"), ("SELEC 1", "parse"), ("SELECT * FROM nowhere_at_all", "QF0005"), ("SELECT nope FROM (SELECT 1 AS a)", "QF0015"), ("SELECT nofunction(1)", "QF0013"), ("SELECT 1 UNION ALL SELECT 1, 2", "QF0022"), ("SELECT a FROM (SELECT 1 AS a) x JOIN (SELECT 1 AS a) y ON TRUE", "QF0016"), ("SELECT (SELECT 1, 2)", "QF0023"), ("SELECT :missing", "QF0018")],
)
def test_codes(spark, text, code):
    with pytest.raises(engine.QueryError) as error:
        engine.dataframe(spark, text).schema
    assert error.value.code == code


def test_budgets():
    with pytest.raises(engine.QueryError, match="budget"):
        engine.prepare("SELECT " + "1," * (1 << 20))
    with pytest.raises(engine.QueryError, match="budget"):
        engine.prepare("SELECT " + ", ".join("?" * 257))


def test_bounded(spark):
    rows, more = engine.bounded(spark.range(20), 5)
    assert len(rows) == 5 and more
    assert engine.bounded(spark.range(5), 5)[1] is False


def test_null_semantics(spark):
    text = "SELECT a FROM VALUES (1), (2), (NULL) AS t(a) WHERE a NOT IN (SELECT b FROM VALUES (1), (NULL) AS u(b))"
    assert engine.dataframe(spark, text).collect() == []


def test_promotion():
    assert common_type(IntegerType(), LongType()) == LongType()
    assert common_type(LongType(), DoubleType()) == DoubleType()
    assert common_type(NullType(), StringType()) == StringType()
    assert common_type(StringType(), LongType()) is None
    assert common_type(ArrayType(IntegerType()), ArrayType(DoubleType())) == ArrayType(DoubleType())


def test_catalog(spark):
    schema = StructType([StructField("id", LongType(), False, {"unit": "none"}), StructField("score", DoubleType())])
    catalog = Catalog("s1")
    catalog.add(Relation("records_t", schema, ("r_t",)))
    again = Catalog.from_json(catalog.to_json())
    assert again.find("R_T").schema == schema and again.snapshot == "s1"
    again.register(spark, {"records_t": spark.sql("SELECT 1 AS id, 2.5 AS score, 'x' AS other")})
    assert [tuple(r) for r in spark.sql("SELECT * FROM r_t").collect()] == [(1, 2.5)]
    again.register(spark, {"records_t": spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 2.5 AS score")})
    with pytest.raises(Exception, match="is null"):
        spark.sql("SELECT * FROM r_t").collect()


@pytest.mark.parametrize(
    "text",
    ["SELECT a FROM t ORDER BY format DESC", "SELECT a FROM t ORDER BY scope DESC", "SELECT * FROM download", "SELECT * FROM t AS scope", 'SELECT "a?b" FROM t', "SELECT `a$1` FROM t", 'SELECT "@x" FROM t', "SELECT `settings x = 1` FROM t"],
)
def test_prepare_leaves_queries_alone(text):
    assert engine.prepare(text).text == text


def test_explain_shows_the_plan(spark):
    out = engine.dataframe(spark, "EXPLAIN SELECT a FROM VALUES (1), (2) AS t(a) WHERE a > ?", [1])
    assert out.columns == ["plan"] and "Physical Plan" in out.first()[0]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT * FROM a JOIN b USING (k)", "QF0000"), ("SELECT * FROM a NATURAL JOIN b", "QF0000"), ("SELECT * FROM a LEFT SEMI JOIN b ON a.k = b.k", "QF0000"), ("SELECT * FROM a LEFT ANTI JOIN b ON a.k = b.k", "QF0000"), ("SELECT * FROM a, LATERAL (SELECT 1) t", "QF0000"),
        ("SELECT a FROM t UNION SELECT a FROM u", "QF0002"), ("SELECT a FROM t INTERSECT SELECT a FROM u", "QF0002"), ("SELECT a FROM t EXCEPT SELECT a FROM u", "QF0002"), ("SELECT x FROM (SELECT a AS x FROM t UNION SELECT a FROM u) d", "QF0002"),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r", "QF0001"),
        ("SELECT a, COUNT(*) FROM t GROUP BY ALL", "QF0012"), ("SELECT a, COUNT(*) FROM t GROUP BY ROLLUP(a)", "QF0012"), ("SELECT a, COUNT(*) FROM t GROUP BY a WITH CUBE", "QF0012"), ("SELECT a, COUNT(*) FROM t GROUP BY GROUPING SETS ((a), ())", "QF0012"),
        ("SELECT SUM(a) OVER (ORDER BY a ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "QF0000"), ("SELECT SUM(a) OVER w FROM t WINDOW w AS (ORDER BY a)", "QF0000"), ("SELECT PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY a) FROM t", "QF0000"), ("SELECT FIRST_VALUE(a) IGNORE NULLS OVER (ORDER BY a) FROM t", "QF0000"),
        ("SELECT a FROM t ORDER BY ALL", "QF0000"), ("FROM t |> WHERE a > 1", "QF0000"), ("SELECT a FROM t SORT BY a", "QF0000"), ("INSERT INTO t VALUES (1)", "QF0000"), ("SELECT a FROM (" * 80 + "SELECT a FROM t" + ") AS d" * 80, "budget"),
        ("SELECT 1 FROM t " + " ".join(f"JOIN t AS t{i} ON TRUE" for i in range(300)), "budget"), ("SELECT " + ", ".join("1" for _ in range(6000)), "budget"),
    ],
)
def test_outside_the_subset(spark, text, code):
    with pytest.raises(engine.QueryError) as error:
        engine.dataframe(spark, text)
    assert error.value.code == code


def test_the_subset_passes_the_gate(spark):
    for text in ("SELECT 'x UNION y', 'WITHIN GROUP', 'rollup(Vector' AS a", "SELECT a, COUNT(*) FROM VALUES (1) AS t(a) GROUP BY a", "SELECT a FROM VALUES (1) AS t(a) UNION ALL SELECT 2", "SELECT SUM(a) OVER (ORDER BY a) FROM VALUES (1) AS t(a)", "SELECT DISTINCT a FROM (SELECT 1 AS a UNION ALL SELECT 1) AS d"):
        engine.dataframe(spark, text)
    assert engine.dataframe(spark, "SELECT a FROM VALUES (1) AS t(a) INTERSECT SELECT 1", strict=False).count() == 1


def test_query_hash():
    """Spacing, comments and directives do not count; names and literals do."""
    same = {engine.query_hash(t) for t in ("SELECT a FROM t", "SELECT  a\nFROM t -- note", "SELECT a FROM t\nSCOPE local")}
    assert len(same) == 1 and next(iter(same)).startswith("sha2-256:")
    assert engine.query_hash("SELECT 'a  b'") != engine.query_hash("SELECT 'a b'")


def test_bounded_by_bytes(spark):
    rows, more = engine.bounded(spark.range(100), 50, most_bytes=20)
    assert 1 <= len(rows) < 50 and more
