"""Relational helpers on rows that the tables don't have."""

import pytest
from pyspark.errors import ArithmeticException, NumberFormatException, ParseException
from pyspark.sql import functions as F

from lakewright.operators import relational
from lakewright.sources import formats


def test_sum_and_max_of_others(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("a", 4, 7), ("b", 5, 3), ("c", 6, None), ("c", 7, 2), ("d", 8, 9), ("d", 9, 4)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    df = relational.sum_of_others(df, ["k"], "v", "s")
    df = relational.max_of_others(df, ["k"], "v", "m")
    for r in df.collect():
        others = [v for k, i, v in rows if k == r["k"] and i != r["i"] and v is not None]
        assert r["s"] == (sum(others) if others else None) and r["m"] == (max(others) if others else None), r


def test_salted_join(spark):
    big = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    small = spark.createDataFrame([(1, "p"), (3, "q")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(relational.salted_join(big, small, "k", 3, how).collect(), key=repr) == sorted(big.join(small, "k", how).collect(), key=repr)
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            relational.salted_join(big, small, "k", 3, how)


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (None, 7)], "src long, dst long")
    start = spark.createDataFrame([(1,), (1,)], "node long")
    assert sorted(r["node"] for r in relational.reachable(edges, start).collect()) == [1, 2, 3]


def test_broadcast_by_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 50, "t string")
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(relational.broadcast_if_small(df)) and "broadcast" not in plan(relational.broadcast_if_small(df, 40_000))


def test_identities(spark):
    a, b = spark.range(0, 60).select((F.col("id") % 7).alias("x")), spark.range(0, 30).select((F.col("id") % 11).alias("x"))
    count = lambda d: sorted(map(tuple, d.groupBy("x").agg(F.count("*")).collect()))
    assert count(a.exceptAll(b).union(a.intersectAll(b))) == count(a)
    assert count(a.subtract(b).union(a.intersect(b))) == count(a.distinct())


def test_errors(spark):
    for text, error in (("SELECT 1 / 0", ArithmeticException), ("SELECT CAST('x' AS INT)", NumberFormatException), ("SELECT 2147483647 + 1", ArithmeticException), ("BEGIN TRANSACTION", ParseException)):
        with pytest.raises(error):
            spark.sql(text).collect()
    with pytest.raises(ValueError):
        formats.read(spark, "/tmp/none", "csv")
