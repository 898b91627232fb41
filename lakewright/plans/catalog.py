"""Registered queries, by the ids of the operator inventory, and the SQL that checks them.

Names are the inventory's: s sources, p projection and predicates, j joins, a aggregation,
w windows, o order and limits, u set operations, x scalar functions, m changes, t streaming,
f user-defined functions.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import portable, udfs
from ..operators import changes, relational
from ..session import table
from ..sources import formats
from ..streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def query(oracle: str | None = None):
    """Register a function of tables: its parameters are named like them, or spark."""

    def add(f: Callable) -> Callable:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(**{n: spark if n == "spark" else sf_dir if n == "sf_dir" else table(spark, sf_dir, n) for n in names})

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql(name: str, text: str, duck: str | None = None) -> None:
    """Register SQL text with {table} references; duck is the other engine's text where it differs."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", duck or text)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the shared checkpoints, or a local one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir() + "/checkpoints/lakewright"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/scratch-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks

sql("s01_parquet_scan", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'")


def _round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, df = scratch(spark), table(spark, sf_dir, "part")
        formats.write(df, path, kind)
        return formats.read(spark, path, kind, df.schema)

    return run


for _n, _kind in (("s01_parquet_write", "parquet"), ("s02_csv", "csv"), ("s03_json", "json"), ("s04_orc", "orc"), ("s05_xml", "xml")):
    QUERIES[_n], ORACLES[_n] = _round_trip(_kind), "SELECT * FROM part"

sql("s08_literal_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(k, s)")


@query("SELECT count(*) > 0 AS some, count(*) < (SELECT count(*) FROM lineitem) AS fewer FROM lineitem USING SAMPLE 10 PERCENT (bernoulli, 7)")
def s09_sample(lineitem):
    n = lineitem.count()
    return lineitem.sample(0.1, seed=7).agg((F.count("*") > 0).alias("some"), (F.count("*") < n).alias("fewer"))


@query("SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS BIGINT) AS square FROM range(1000) t(n)")
def s10_custom_source(spark):
    spark.dataSource.register(formats.Squares)
    return spark.read.format("squares").option("rows", 1000).load()


@query("SELECT r_name FROM region WHERE r_regionkey > 1")
def s11_temp_view(spark, region):
    region.createOrReplaceTempView("lakewright_region")
    return spark.sql("SELECT r_name FROM lakewright_region WHERE r_regionkey > 1")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def s12_batch_sink(spark, sf_dir):
    path = scratch(spark)
    ev.batches_into(ev.stream(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- projection and predicates


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) AS flag FROM lineitem")
def p01_select(lineitem):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", net.alias("net"), F.upper("l_returnflag").alias("flag"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_tax < 0.05")
def p02_filter(lineitem):
    c = F.col
    return lineitem.where(c("l_quantity").between(10, 20) & c("l_returnflag").isin("A", "R") & (c("l_tax") < 0.05)).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def p03_distinct(customer):
    return customer.select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def p04_distinct_on(orders):
    return relational.distinct_on(orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


sql(
    "p05_three_valued",
    "SELECT k, CAST(a = b AS INT) AS eq, CAST(a IN (1, NULL) AS INT) AS isin, CAST(a NOT IN (1, NULL) AS INT) AS notin, CAST((a = 1) AND (b = 1) AS INT) AS both "
    "FROM (VALUES (1, 1, 1), (2, 2, NULL), (3, CAST(NULL AS INT), NULL), (4, 1, 2)) AS v(k, a, b)",
)
sql("p06_null_safe_equal", "SELECT k, a IS NOT DISTINCT FROM b AS same FROM (VALUES (1, 1, 1), (2, 2, NULL), (3, CAST(NULL AS INT), CAST(NULL AS INT))) AS v(k, a, b)")
sql("p07_like", "SELECT p_partkey, p_name LIKE '%in%' AS has_in, p_type ILIKE 'eco%' AS economy FROM {part} WHERE p_name LIKE '%a%' OR p_type LIKE '_A%'")
sql(
    "p08_case",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'none') AS open_status, "
    "ifnull(nullif(o_orderstatus, 'O'), '-') AS other, if(o_orderpriority = '1-URGENT', 1, 0) AS urgent FROM {orders}",
)
sql(
    "p09_exists",
    "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey) "
    "AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0)",
)
sql("p10_scalar_subquery", "SELECT p_partkey FROM {part} p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)")
sql(
    "p11_cte",
    "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN top ON n = m",
)
sql(
    "p12_recursive_cte",
    "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
)


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), "
    "r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r"
)
def p13_recursive_union(spark, lineitem):
    scratch(spark)
    e = lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return relational.reachable(e, spark.range(1, 2).select(F.col("id").alias("node")))


sql(
    "p14_lateral",
    "SELECT c_custkey, n FROM {customer} c, LATERAL (SELECT count(*) AS n FROM {orders} o WHERE o.o_custkey = c.c_custkey) x",
)


@query(
    "SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS o FROM lineitem GROUP BY l_returnflag"
)
def p15_pivot(lineitem):
    wide = lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return wide.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def p15_unpivot(part):
    wide = part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot(["p_partkey"], ["size", "price"], "what", "value")


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS place, unnest(embedding) AS x FROM embeddings")
def p16_explode(embeddings):
    return embeddings.select("vec_id", F.posexplode("embedding").alias("place", "x"))


# ---------------------------------------------------------------- joins

_CO = "SELECT c_custkey, o_orderkey FROM {customer} %s JOIN {orders} ON c_custkey = o_custkey"
sql("j01_inner", _CO % "INNER")
sql("j02_left", _CO % "LEFT")
sql("j02_right", _CO % "RIGHT")
sql("j02_full", _CO % "FULL")
sql("j03_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("j04_using", "SELECT v.k, a, b FROM (VALUES (1, 'x'), (2, 'y')) v(k, a) JOIN (VALUES (1, 'p'), (1, 'q'), (3, 'r')) w(k, b) USING (k)")
sql("j05_natural", "SELECT k, a, b FROM (VALUES (1, 'x'), (2, 'y')) v(k, a) NATURAL JOIN (VALUES (1, 'p'), (3, 'r')) w(k, b)")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j06_semi(customer, orders):
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    return customer.join(urgent, customer.c_custkey == urgent.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j07_anti(orders, lineitem):
    return orders.join(lineitem, orders.o_orderkey == lineitem.l_orderkey, "left_anti").select("o_orderkey")


sql(
    "j08_null_aware_anti",
    "SELECT k FROM (VALUES (1), (2), (CAST(NULL AS INT))) v(k) WHERE k NOT IN (SELECT w FROM (VALUES (2), (3)) x(w)) UNION ALL SELECT k FROM (VALUES (7)) v(k) WHERE k NOT IN (SELECT w FROM (VALUES (2), (CAST(NULL AS INT))) x(w))",
)
sql("j09_theta", "SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey + b.n_nationkey > 30")
sql(
    "j10_interval",
    "SELECT e.event_id, f.event_id AS later FROM {events} e JOIN {events} f ON e.user_id = f.user_id AND e.event_type = 'click' AND f.event_type = 'purchase' "
    "AND f.ts >= e.ts AND f.ts < e.ts + INTERVAL 1 HOUR",
)


@query(
    "SELECT e.event_id, b.name FROM events e JOIN (VALUES (0.0, 50.0, 'low'), (50.0, 120.0, 'mid'), (120.0, 1e9, 'high')) b(lo, hi, name) ON e.value >= b.lo AND e.value < b.hi"
)
def j10_bucketed_range(spark, events):
    bands = spark.createDataFrame([(0.0, 50.0, "low"), (50.0, 120.0, "mid"), (120.0, 1000.0, "high")], "lo double, hi double, name string")
    return relational.interval_join(events, bands, F.col("value"), F.col("lo"), F.col("hi"), 50.0).select("event_id", "name")


@query(
    "WITH o AS (SELECT o_custkey, o_orderdate, max((o_totalprice, o_orderkey)) AS v FROM orders GROUP BY ALL), x AS (SELECT event_id, user_id, ts, "
    "(SELECT max((o_orderdate, v)) FROM o WHERE o_custkey = user_id AND o_orderdate <= ts) AS m FROM events) "
    "SELECT event_id, m[2][1] AS o_totalprice, m[2][2] AS o_orderkey FROM x".replace("m[2][1]", "struct_extract(struct_extract(m, 2), 1)").replace("m[2][2]", "struct_extract(struct_extract(m, 2), 2)")
)
def j11_as_of(events, orders):
    right = orders.select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_totalprice", "o_orderkey")
    left = events.select("event_id", "user_id", "ts")
    return relational.as_of(left, right, ["user_id"], "ts", "o_orderdate", ["o_totalprice", "o_orderkey"]).select("event_id", "o_totalprice", "o_orderkey")


_HINTED = "SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _hinted(hint: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
        o = relational.broadcast_if_small(o) if hint == "broadcast" else o.hint(hint)
        return l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count("*").alias("n"))

    return run


for _n, _hint in (("j12_broadcast_hash", "broadcast"), ("j13_sort_merge", "merge"), ("j14_shuffled_hash", "shuffle_hash")):
    QUERIES[_n], ORACLES[_n] = _hinted(_hint), _HINTED


@query("SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_acctbal > n_nationkey * 100 GROUP BY n_name")
def j15_nested_loop(nation, supplier):
    return supplier.join(relational.broadcast_if_small(nation), F.col("s_acctbal") > F.col("n_nationkey") * 100).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, c_mktsegment, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def j16_salted(lineitem, orders, customer):
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    big = relational.salted_join(lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"), o, "l_orderkey", 4)
    return big.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("l_returnflag", "c_mktsegment").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- aggregation

_D = "CAST(sum(CAST(%s AS DECIMAL(18,4))) AS DOUBLE)"


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, "
    + ", ".join(f"{_D % e} AS {a}" for e, a in (("l_quantity", "quantity"), ("l_extendedprice", "price"), ("l_extendedprice * (1 - l_discount)", "revenue")))
    + f", {_D % 'l_quantity'} / count(*) AS avg_quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
)
def a01_pricing_summary(lineitem):
    price, c = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col
    return (
        lineitem.where(c("l_shipdate") <= F.lit("2000-09-02 00:00:00").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            portable.exact_sum(c("l_quantity")).alias("quantity"),
            portable.exact_sum(c("l_extendedprice")).alias("price"),
            portable.exact_sum(price).alias("revenue"),
            portable.exact_avg(c("l_quantity")).alias("avg_quantity"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


sql("a02_min_max", "SELECT l_shipdate IS NULL AS none, min(l_quantity + 0) AS low, max(l_quantity + 0) AS high, min(l_returnflag) AS first_flag FROM {lineitem} GROUP BY 1")
sql("a03_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id, value) AS pairs FROM {events} GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT (user_id, value)) AS pairs FROM {events} GROUP BY event_type")


@query("SELECT event_type, true AS near FROM events GROUP BY event_type")
def a04_approx_distinct(events):
    both = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("e"))
    return both.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("near"))


sql("a05_deviation", "SELECT p_brand, round(stddev(p_retailprice), 4) AS sd, round(var_pop(p_size), 4) AS v FROM {part} GROUP BY p_brand")
sql("a06_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS s FROM {lineitem}")
sql("a07_median", "SELECT p_type, median(p_size) AS m, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_size) AS q FROM {part} GROUP BY p_type")
sql("a08_max_by", "SELECT p_brand, max_by(p_partkey, p_retailprice * 100000 + p_partkey) AS dearest, bool_and(p_size > 0) AS sized, bool_or(p_size > 49) AS big FROM {part} GROUP BY p_brand")
sql("a08_mode", "SELECT mode(x) AS m FROM (VALUES (1), (2), (2), (3)) v(x)")


@query("SELECT n_regionkey, list_sort(list(n_name)) AS names, string_agg(n_name, ',' ORDER BY n_name) AS joined FROM nation GROUP BY n_regionkey")
def a09_array_agg(nation):
    names = F.array_sort(F.collect_list("n_name"))
    return nation.groupBy("n_regionkey").agg(names.alias("names"), F.array_join(names, ",").alias("joined"))


sql("a10_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM {orders} GROUP BY o_orderstatus")
_SETS = "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM {lineitem} GROUP BY "
sql("a11_grouping_sets", _SETS + "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", _SETS + "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
sql("a11_rollup", _SETS + "ROLLUP (l_returnflag, l_linestatus)")
sql("a11_cube", _SETS + "CUBE (l_returnflag, l_linestatus)")
sql("a12_group_by_all", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ALL")
sql("a13_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("a13_having_whole", "SELECT count(*) AS n FROM {orders} HAVING count(*) > 10")
sql(
    "a14_more_aggregates",
    "SELECT p_brand, round(skewness(p_size), 4) AS sk, bit_or(p_size) AS bo, bit_and(p_size) AS ba, bit_xor(p_size) AS bx, count_if(p_size > 25) AS n, round(regr_slope(p_retailprice, p_size), 4) AS slope FROM {part} GROUP BY p_brand",
    "SELECT p_brand, round(m3 / pow(m2, 1.5), 4) AS sk, bo, ba, bx, n, slope FROM (SELECT p_brand, avg(pow(p_size - m, 3)) AS m3, avg(pow(p_size - m, 2)) AS m2, bit_or(p_size) AS bo, bit_and(p_size) AS ba, bit_xor(p_size) AS bx, "
    "CAST(count_if(p_size > 25) AS BIGINT) AS n, round(regr_slope(p_retailprice, p_size), 4) AS slope FROM (SELECT *, avg(p_size) OVER (PARTITION BY p_brand) AS m FROM {part}) GROUP BY p_brand)",
)


@query("SELECT event_type, true AS near FROM events GROUP BY event_type")
def a14_sketches(events):
    """An HLL sketch of each day, merged: what a rollup table would keep."""
    day = F.to_date("ts").alias("day")
    daily = events.groupBy("event_type", day).agg(F.hll_sketch_agg("user_id").alias("s"))
    merged = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("a"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("e"))
    return merged.join(exact, "event_type").select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("near"))


sql(
    "a15_join_then_aggregate",
    f"SELECT n_name, {_D % 'l_extendedprice * (1 - l_discount)'} AS revenue FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey GROUP BY n_name",
)

# ---------------------------------------------------------------- windows

_W = "(PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)"
sql(
    "w01_ranks",
    "SELECT p_partkey, rank() OVER r AS rk, dense_rank() OVER r AS dr, ntile(4) OVER t AS q, percent_rank() OVER r AS pr FROM {part} WINDOW r AS (PARTITION BY p_brand ORDER BY p_size), t AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)",
    "SELECT p_partkey, CAST(rank() OVER r AS INT) AS rk, CAST(dense_rank() OVER r AS INT) AS dr, CAST(ntile(4) OVER t AS INT) AS q, percent_rank() OVER r AS pr FROM {part} WINDOW r AS (PARTITION BY p_brand ORDER BY p_size), t AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)",
)
sql("w02_row_number", f"SELECT p_partkey, CAST(row_number() OVER {_W} AS INT) AS n FROM {{part}}")
sql("w03_cume_dist", "SELECT p_partkey, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS c FROM {part}")
sql("w04_nth_value", f"SELECT p_partkey, nth_value(p_partkey, 2) OVER {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {{part}}")
sql(
    "w05_lag_ignore_nulls",
    "SELECT event_id, lag(nullif(event_type, 'view')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {events}",
    "SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {events}",
)
sql(
    "w06_lead_first_last",
    f"SELECT p_partkey, lead(p_partkey, 1, -1) OVER {_W} AS nxt, first_value(p_partkey) OVER {_W} AS f, last_value(p_partkey) OVER {_W} AS l FROM {{part}}",
)
sql("w07_rows", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM {events}")
sql("w08_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM {part}")
sql("w09_range_time", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def w10_groups(part):
    return relational.groups_frame(part, ["p_brand"], "p_size", 1, 1, F.count("*"), "n").select("p_partkey", "n")


@query(
    "SELECT p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS rest, max(p_size) OVER w AS other FROM part "
    "WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)"
)
def w11_exclude_current(part):
    df = relational.sum_of_others(part, ["p_brand"], "p_size", "rest")
    return relational.max_of_others(df, ["p_brand"], "p_size", "other").select("p_partkey", F.col("rest").cast("bigint").alias("rest"), "other")


sql("w12_named", "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS n, lag(o_orderkey) OVER w AS before FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) <= 2")
def w13_qualify(orders):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return relational.qualify(orders, F.rank().over(w), lambda r: r <= 2).select("o_custkey", "o_orderkey")


# ---------------------------------------------------------------- order, limit, top-k

sql("o01_order_by", "SELECT n_name, n_regionkey FROM {nation} ORDER BY n_regionkey DESC, n_name ASC NULLS FIRST")
sql("o02_nulls_last", "SELECT k FROM (VALUES (2), (CAST(NULL AS INT)), (1)) v(k) ORDER BY k DESC NULLS LAST LIMIT 2")
sql("o03_limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o04_top_k(orders):
    return orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def o05_top_k_per_group(customer):
    return relational.top_per_group(customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey")


# ---------------------------------------------------------------- set operations

_A, _B = "SELECT c_custkey % 40 AS k FROM {customer}", "SELECT s_nationkey AS k FROM {supplier}"
for _n, _op in (("u01_union", "UNION"), ("u01_union_all", "UNION ALL"), ("u02_intersect", "INTERSECT"), ("u02_intersect_all", "INTERSECT ALL"), ("u03_except", "EXCEPT"), ("u03_except_all", "EXCEPT ALL")):
    sql(_n, f"{_A} {_op} {_B}")


@query("SELECT c_custkey AS k, c_name AS name, NULL AS size FROM customer UNION ALL BY NAME SELECT p_size AS size, p_partkey AS k FROM part")
def u04_union_by_name(customer, part):
    a = customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(part.select(F.col("p_size").alias("size"), F.col("p_partkey").alias("k")), allowMissingColumns=True)


# ---------------------------------------------------------------- scalar functions

sql(
    "x01_string",
    "SELECT p_partkey, p_name || '-' || p_brand AS j, substring(p_name, 2, 4) AS s, length(p_name) AS n, instr(p_name, '1') AS i, trim('  x ') AS t, replace(p_type, 'E', 'e') AS r, concat_ws('/', p_brand, p_type) AS c, "
    "lpad(CAST(p_size AS STRING), 5, '0') AS l, rpad(p_brand, 12, '.') AS rp, left(p_name, 3) AS lf, right(p_name, 2) AS rt, reverse(p_brand) AS rv, regexp_extract(p_name, '([0-9]+)', 1) AS d, md5(p_name) AS m, "
    "levenshtein(p_brand, p_type) AS lv, split_part(p_name, '#', 1) AS sp, translate(p_type, 'AEI', 'aei') AS tr, repeat(p_brand, 2) AS rep, ascii(p_name) AS a, ltrim('  y') AS lt, rtrim('z  ') AS rr, lower(p_type) AS lo, upper(p_name) AS u FROM {part}",
    "SELECT p_partkey, p_name || '-' || p_brand AS j, substring(p_name, 2, 4) AS s, CAST(length(p_name) AS INT) AS n, CAST(instr(p_name, '1') AS INT) AS i, trim('  x ') AS t, replace(p_type, 'E', 'e') AS r, concat_ws('/', p_brand, p_type) AS c, "
    "lpad(CAST(p_size AS STRING), 5, '0') AS l, rpad(p_brand, 12, '.') AS rp, left(p_name, 3) AS lf, right(p_name, 2) AS rt, reverse(p_brand) AS rv, regexp_extract(p_name, '([0-9]+)', 1) AS d, md5(p_name) AS m, "
    "CAST(levenshtein(p_brand, p_type) AS INT) AS lv, split_part(p_name, '#', 1) AS sp, translate(p_type, 'AEI', 'aei') AS tr, repeat(p_brand, 2) AS rep, ascii(p_name) AS a, ltrim('  y') AS lt, rtrim('z  ') AS rr, lower(p_type) AS lo, upper(p_name) AS u FROM {part}",
)
sql("x01_regexp_replace", "SELECT p_partkey, regexp_replace(p_name, '[0-9]', '#') AS masked FROM {part}", "SELECT p_partkey, regexp_replace(p_name, '[0-9]', '#', 'g') AS masked FROM {part}")
sql(
    "x02_math",
    "SELECT p_partkey, abs(p_size - 25) AS a, CAST(sign(p_size - 25) AS DOUBLE) AS sg, round(p_retailprice, 1) AS r, pow(p_size, 2) AS p, p_size % 7 AS m, p_size & 12 AS b, greatest(p_size, 20) AS g, least(p_size, 20) AS l, round(ln(p_size), 9) AS ln, "
    "round(log10(p_size), 9) AS lg, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_size), 9) AS s, round(exp(p_size / 50.0), 9) AS e, p_size div 4 AS d, round(sin(p_size), 9) AS si, round(cbrt(p_size), 9) AS cb, round(degrees(p_size), 6) AS dg, bit_count(p_size) AS bc FROM {part}",
    "SELECT p_partkey, abs(p_size - 25) AS a, CAST(sign(p_size - 25) AS DOUBLE) AS sg, round(p_retailprice, 1) AS r, pow(p_size, 2) AS p, p_size % 7 AS m, p_size & 12 AS b, greatest(p_size, 20) AS g, least(p_size, 20) AS l, round(ln(p_size), 9) AS ln, "
    "round(log10(p_size), 9) AS lg, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_size), 9) AS s, round(exp(p_size / 50.0), 9) AS e, CAST(p_size // 4 AS BIGINT) AS d, round(sin(p_size), 9) AS si, round(cbrt(p_size), 9) AS cb, round(degrees(p_size), 6) AS dg, CAST(bit_count(p_size) AS INT) AS bc FROM {part}",
)


@query("SELECT p_partkey, 1000.0 / nullif(p_size - 25, 0) AS q, CASE WHEN p_size > 25 THEN ln(p_size - 25) END AS g, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS h FROM part".replace("ln(p_size - 25)", "round(ln(p_size - 25), 9)"))
def x02_guarded(part):
    size = F.col("p_size")
    return part.select("p_partkey", portable.safe_divide(F.lit(1000.0), size - 25).alias("q"), F.round(portable.guarded_log(size - 25), 9).alias("g"), portable.half_up(F.col("p_retailprice")).alias("h"))


sql(
    "x03_dates",
    "SELECT o_orderkey, date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS m, CAST(last_day(o_orderdate) AS STRING) AS l, weekofyear(o_orderdate) AS w, quarter(o_orderdate) AS q, year(o_orderdate) AS y, dayofweek(o_orderdate) - 1 AS d, "
    "datediff(DATE '2002-01-01', o_orderdate) AS days, CAST(add_months(o_orderdate, 1) AS STRING) AS am, date_format(o_orderdate, 'yyyy/MM/dd') AS f, CAST(date_add(o_orderdate, 10) AS STRING) AS da, CAST(make_date(2001, 2, 3) AS STRING) AS md FROM {orders}",
    "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, CAST(last_day(o_orderdate) AS STRING) AS l, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(quarter(o_orderdate) AS INT) AS q, CAST(year(o_orderdate) AS INT) AS y, CAST(dayofweek(o_orderdate) AS INT) AS d, "
    "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS days, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS STRING) AS am, strftime(o_orderdate, '%Y/%m/%d') AS f, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS STRING) AS da, '2001-02-03' AS md FROM {orders}",
)


@query(
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS square, len(embedding) AS n, embedding[1] AS head, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings".replace("len(", "CAST(len(").replace(") AS n,", ") AS INT) AS n,").replace(") AS positive", ") AS INT) AS positive")
)
def x04_arrays(embeddings):
    e = F.col("embedding")
    return embeddings.select("vec_id", F.round(portable.dot(e, e), 5).alias("square"), F.size(e).alias("n"), e[0].alias("head"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"))


@query(
    "SELECT list_sort(list_distinct([3, 1, 3])) AS d, list_contains([1, 2], 2) AS c, [1, 2, 3, 4][2:3] AS s, flatten([[1], [2, 3]]) AS f, list_transform([1, 2], lambda x: x * 10) AS t, list_position([5, 6], 6) AS p".replace("list_position([5, 6], 6)", "CAST(list_position([5, 6], 6) AS BIGINT)")
)
def x04_array_functions(spark):
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    return spark.range(1).select(
        F.array_sort(F.array_distinct(a(3, 1, 3))).alias("d"), F.array_contains(a(1, 2), 2).alias("c"), F.slice(a(1, 2, 3, 4), 2, 2).alias("s"), F.flatten(F.array(a(1), a(2, 3))).alias("f"),
        F.transform(a(1, 2), lambda x: x * 10).alias("t"), F.array_position(a(5, 6), 6).alias("p"),
    )


@query("SELECT 2 AS at_b, 2 AS n, 'v' AS x, 3 AS y")
def x05_maps_structs(spark):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    s = F.struct(F.lit("v").alias("x"), F.lit(3).alias("y"))
    return spark.range(1).select(m["b"].alias("at_b"), F.size(F.map_keys(m)).alias("n"), s["x"].alias("x"), s["y"].alias("y"))


sql(
    "x06_json",
    "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(from_json(props, 'k INT').k AS INT) AS n, CAST(try_variant_get(parse_json(props), '$.k', 'int') AS INT) AS v FROM {events}",
    "SELECT event_id, props ->> '$.k' AS k, CAST(props ->> '$.k' AS INT) AS n, CAST(props ->> '$.k' AS INT) AS v FROM {events}",
)
sql(
    "x07_conversion",
    "SELECT CAST('12' AS INT) AS i, try_cast('x' AS INT) AS t, CAST(2.0 AS INT) AS d, CAST(true AS INT) AS b, CAST(DATE '2001-02-03' AS STRING) AS s, nvl(NULL, 5) AS n",
    "SELECT CAST('12' AS INT) AS i, try_cast('x' AS INT) AS t, CAST(2.0 AS INT) AS d, CAST(true AS INT) AS b, CAST(DATE '2001-02-03' AS STRING) AS s, ifnull(NULL, 5) AS n",
)
sql("x08_hashes", "SELECT p_partkey, sha2(p_name, 256) AS h, base64(CAST(p_name AS BINARY)) AS b, lower(hex(CAST(p_name AS BINARY))) AS x FROM {part}", "SELECT p_partkey, sha256(p_name) AS h, base64(encode(p_name)) AS b, lower(hex(encode(p_name))) AS x FROM {part}")


@query("SELECT c_custkey, coalesce(CAST(c_nationkey AS STRING), '') || '/' || coalesce(c_name, '') AS j FROM customer")
def x09_join_text(customer):
    return customer.select("c_custkey", portable.join_text(F.col("c_nationkey"), F.lit("/"), F.col("c_name")).alias("j"))


# ---------------------------------------------------------------- changes


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT 0, 'new'")
def m01_tables(spark, supplier):
    name = f"lakewright_{uuid.uuid4().hex[:12]}"
    try:
        supplier.select("s_suppkey", "s_name").write.saveAsTable(name)
        spark.sql(f"INSERT INTO {name} VALUES (0, 'new')")
        path = scratch(spark)
        spark.table(name).write.parquet(path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.parquet(path)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def m02_update(customer):
    return changes.update(customer.select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})


@query("SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING')")
def m02_delete(customer):
    return changes.delete(customer, F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query(
    "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT n_nationkey, upper(n_name) || '!', n_regionkey FROM nation WHERE n_nationkey < 10 AND n_regionkey <> 0 UNION ALL SELECT 99, 'NEW', 1"
)
def m02_merge(spark, nation):
    source = nation.where("n_nationkey < 10").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    source = source.unionByName(spark.createDataFrame([(99, "NEW", 1)], nation.schema))
    return changes.merge(nation, source, ["n_nationkey"], F.col("n_regionkey") == 0)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def m03_key_violations(lineitem):
    return changes.repeated_keys(lineitem, ["l_orderkey", "l_linenumber"])


@query('SELECT \'o_orderstatus\' AS "column", count(*) AS nulls FROM orders WHERE o_orderstatus = \'F\'')
def m04_null_violations(orders):
    return changes.nulls_in(orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F"))), ["o_orderkey", "o_orderstatus"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL")
def m05_missing_parents(lineitem, orders):
    return changes.missing_parents(lineitem, orders.where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def m08_views_and_pipes(spark, nation, region):
    nation.createOrReplaceTempView("lakewright_nation")
    return spark.sql("FROM lakewright_nation |> JOIN {r} ON n_regionkey = r_regionkey |> AGGREGATE count(*) AS n GROUP BY r_name", r=region)


# ---------------------------------------------------------------- streaming


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def t02_tumbling(spark, sf_dir):
    return ev.settled(ev.tumbling(ev.stream(spark, sf_dir))).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR for k in range(4)]) AS s FROM events) GROUP BY ALL"
)
def t03_sliding(spark, sf_dir):
    return ev.settled(ev.sliding(ev.stream(spark, sf_dir))).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query(
    "SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, g"
)
def t04_sessions(spark, sf_dir):
    return ev.settled(ev.sessions(ev.stream(spark, sf_dir)), scratch(spark)).select("user_id", "n")


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def t05_dedup(spark, sf_dir):
    """All events are one batch here, so no key comes again after the watermark has passed it."""
    return ev.settled(ev.first_of_users(ev.stream(spark, sf_dir)), scratch(spark), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts < c.ts + INTERVAL 1 HOUR"
)
def t06_stream_stream(spark, sf_dir):
    return ev.settled(ev.purchases_after_clicks(ev.stream(spark, sf_dir), ev.stream(spark, sf_dir)), scratch(spark), "append")


@query("SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def t07_stream_static(spark, sf_dir, customer):
    return ev.settled(ev.with_customers(ev.stream(spark, sf_dir), customer).groupBy("c_mktsegment").agg(F.count("*").alias("n")))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def t09_own_state(spark, sf_dir):
    return ev.settled(ev.running_counts(ev.stream(spark, sf_dir)), scratch(spark), "update").groupBy("user_id").agg(F.max("n").alias("n"))


@query(
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' OR event_id % 10 <> 0 GROUP BY ALL"
)
def t10_late_data(spark, events):
    """Every tenth event of the first half comes late, in a second run: by then days before 15 January are behind the watermark, and what is late for them is dropped."""
    source, found = scratch(spark), scratch(spark)
    half, tenth = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), F.col("event_id") % 10 == 0
    for part in (events.where(half & ~tenth), events.where(~half | tenth)):
        part.write.mode("append").parquet(source)
        days = ev.stream_of(spark, source, events.schema).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
        ev.batches_into(days, found, "update")
    return spark.read.parquet(found).groupBy(F.date_format("w.start", "yyyy-MM-dd").alias("day")).agg(F.max("n").alias("n"))


# ---------------------------------------------------------------- user-defined functions


@query("SELECT p_partkey, left(p_name, 1) || list_aggregate(list_transform(list_slice(string_split(replace(p_name, '#', ' '), ' '), 2, 99), lambda w: left(w, 1)), 'string_agg', '') AS i FROM part")
def f01_scalar(part):
    return part.select("p_partkey", udfs.initials("p_name").alias("i"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, round(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem")
def f02_vectorised(lineitem):
    return lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.round(udfs.with_tax("l_extendedprice", "l_tax"), 4).alias("gross"))


@query("SELECT p_brand, (min(p_retailprice + 0) + max(p_retailprice + 0)) / 2 AS m FROM part GROUP BY p_brand")
def f03_aggregate(part):
    return part.groupBy("p_brand").agg(udfs.midrange("p_retailprice").alias("m"))


@query("SELECT n_nationkey, w AS word, CAST(i - 1 AS INT) AS place FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w, generate_subscripts(string_split(n_name, ' '), 1) AS i FROM nation)")
def f04_table_function(spark, nation):
    udfs.register(spark)
    return spark.sql("SELECT n_nationkey, word, place FROM {n}, LATERAL split_words(n_name)", n=nation)


@query(
    "SELECT p_brand, p_retailprice, CAST(c * n - sum(c) OVER (PARTITION BY p_brand) AS DOUBLE) / (n * 10000) AS centred "
    "FROM (SELECT p_brand, p_retailprice, CAST(round(p_retailprice * 10000) AS BIGINT) AS c, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"
)
def f05_grouped_map(part):
    return udfs.centred(part, "p_brand", "p_retailprice")


@query("SELECT event_id, value FROM events WHERE value > 100")
def f05_batch_map(events):
    return udfs.flagged(events.select("event_id", "value"), "value", 100.0)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def f06_sql_function(spark, lineitem):
    udfs.register(spark)
    return spark.sql("SELECT l_orderkey, l_partkey, l_suppkey, net_price(l_extendedprice, l_discount) AS net FROM {l}", l=lineitem)
