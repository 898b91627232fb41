"""Relational forms that Spark SQL has no syntax for, as DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, value: Column, predicate) -> DataFrame:
    """Rows whose window value satisfies predicate(column)."""
    return df.withColumn("_q", value).where(predicate(F.col("_q"))).drop("_q")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. order must be total for a repeatable result."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), lambda n: n == 1)


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark prunes to k a task before the shuffle (WindowGroupLimit)."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), lambda n: n <= k)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its key at or before its time.

    Both sides are put together and one window carries the last right row forward: one shuffle, no
    pairs. Of right rows with one key and time the largest values win. A hot key is one window
    partition; cut it by a coarse time column in keys where that is known to be safe.
    """
    r = right.groupBy(*keys, F.col(right_at).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    r = r.select(*keys, "_t", F.lit(0).alias("_side"), "_v", F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    l = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Pairs with start <= at < end, through buckets of a width: an equi-join with a residual in place of a nested loop. Each span is repeated once a bucket."""
    p = points.withColumn("_b", F.floor(at / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))
    return p.join(s, "_b").where((at >= start) & (at < end)).drop("_b")


def groups_frame(df: DataFrame, keys: list[str], order: str, preceding: int, following: int, value: Column, name: str) -> DataFrame:
    """An aggregate over a frame counted in groups of equal order values: a RANGE frame over dense_rank."""
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.withColumn(name, value.over(Window.partitionBy(*keys).orderBy("_g").rangeBetween(-preceding, following))).drop("_g")


def sum_of_others(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """EXCLUDE CURRENT ROW for a sum over the whole partition: null where no other row has a value."""
    w = Window.partitionBy(*keys)
    others = F.count(value).over(w) - F.col(value).isNotNull().cast("int")
    return df.withColumn(name, F.when(others > 0, F.sum(value).over(w) - F.coalesce(F.col(value), F.lit(0))))


def max_of_others(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """EXCLUDE CURRENT ROW for a maximum: the second largest value for the only row with the largest, which all others get. No frame, so linear in the partition."""
    w = Window.partitionBy(*keys)
    top, v = F.max(value).over(w), F.col(value)
    marked = df.withColumn("_top", top).withColumn("_ties", F.sum((v == F.col("_top")).cast("int")).over(w))
    below = F.max(F.when(v < F.col("_top"), v)).over(w)
    return marked.withColumn(name, F.when((v == F.col("_top")) & (F.col("_ties") == 1), below).otherwise(F.col("_top"))).drop("_top", "_ties")


def reachable(edges: DataFrame, start: DataFrame, limit: int = 1000) -> DataFrame:
    """Recursion with UNION: all nodes that (src, dst) edges lead to from start (node).

    Each round joins only what the last one found, and checkpoints only that, so plans don't grow
    and no round writes again what earlier ones found.
    """
    fresh = start.select("node").distinct().checkpoint()
    seen = fresh
    for _ in range(limit):
        step = fresh.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = step.join(seen, "node", "left_anti").checkpoint()
        if not fresh.limit(1).count():
            return seen
        seen = seen.unionByName(fresh)
    raise RuntimeError(f"no fixpoint after {limit} rounds")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """A join that spreads each key of big over several tasks; small is repeated salts times. For keys that AQE cannot split (outer sides, later aggregates on the key)."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: rows of small are repeated, so only joins that keep rows of big can be salted")
    left = big.withColumn("_s", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    right = small.withColumn("_s", F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)])))
    return left.join(right, [key, "_s"], how).drop("_s")


def broadcast_if_small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows, as the width of their types and texts tells, have at most so many bytes; else as it is, for Spark to shuffle."""
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = df.agg(F.sum(sum(text, F.lit(16 + 8 * len(df.columns)).cast("long")))).first()[0] or 0
    return F.broadcast(df) if size <= most else df
