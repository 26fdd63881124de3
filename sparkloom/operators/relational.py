"""Relational operators with fixed null rules: nulls last, null keys dropped, NaN skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import ascii_bucket
from sparkloom.sources.folders import scratch

AGGREGATES = ("count", "sum", "avg", "min", "max")


def filter_rows(df: DataFrame, column: str, condition: str, value: object) -> DataFrame:
    """``==``, ``>`` or ``<`` against a value read as the column's type; NaN matches nothing."""
    kind = dict(df.dtypes)[column]
    c, v = F.col(column), F.lit(value).cast(kind)
    tests = {"==": c == v, ">": c > v, "<": c < v}
    if condition not in tests:
        raise ValueError(f"unknown condition {condition!r}")
    test = tests[condition]
    return df.where(test & ~F.isnan(c) if kind in ("double", "float") else test)


def group_by(df: DataFrame, column: str, agg: str, value: str = "value") -> DataFrame:
    """One aggregate per key: (key, count) for count, else (key, value). Null keys go; NaN is skipped; an empty sum is 0."""
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    rows = df.where(F.col(column).isNotNull())
    if agg == "count":
        return rows.groupBy(column).agg(F.count("*").alias("count"))
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    made = {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "avg": F.avg(v), "min": F.min(v), "max": F.max(v)}[agg]
    return rows.groupBy(column).agg(made.alias(value))


def order_by(df: DataFrame, column: str, ascending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """A global sort, nulls last either way; ``tie`` columns make it the same every time."""
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *tie)


def top(df: DataFrame, column: str, n: int, ascending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    return order_by(df, column, ascending, tie).limit(n)


def repartition_random(df: DataFrame, n: int = 3) -> DataFrame:
    return df.repartition(n)


def repartition_hash(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    return df.repartition(n, column)


def bucket_of(column: str, n: int = 3) -> Column:
    """The bucket, 1 to n, of a key by the sum of its character codes."""
    return ascii_bucket(F.col(column).cast("string"), n)


def repartition_skewed(df: DataFrame, share: float = 0.9, n: int = 3, seed: int = 0) -> DataFrame:
    """Sends about ``share`` of the rows to one partition, to try how a job bears skew; the rest is spread."""
    to = F.when(F.rand(seed) < share, F.lit(0)).otherwise(F.floor(F.rand(seed + 1) * (n - 1)) + 1)
    return df.withColumn("_to", to.cast("int")).repartition(n, "_to").drop("_to")


def coalesce(df: DataFrame, n: int) -> DataFrame:
    return df.coalesce(n)


def range_partitioned(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.repartitionByRange(n, F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())


def blocks(df: DataFrame, order: str, k: int) -> DataFrame:
    """Adds ``block``: k contiguous runs in order, the first ones a row longer where k does not divide the rows.

    Ranks come from counts of ranges and a prefix sum over them, so no window spans the table.
    """
    ranked = with_rank(df, order)
    n = df.count()
    short, longer = n // k, n % k
    cut, r = longer * (short + 1), F.col("rank")
    block = F.when(r < cut, F.floor(r / (short + 1))).otherwise(longer + F.floor((r - cut) / max(short, 1)))
    return ranked.withColumn("block", (block + 1).cast("int")).drop("rank")


#: Rows that a part should hold, most parts, and values read for each bound between parts.
PART_ROWS, MOST_PARTS, SAMPLES = 1_000_000, 4_096, 16
#: Bounds are searched in blocks of this many.
BOUNDS = 64


def with_parts(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """Adds ``_part``: contiguous ranges of ``order``, numbered in its order (nulls first), and tells how many there may be.

    The bounds are taken once, from values with small hashes, and stand in the plan. So a row's part depends on its
    value alone, whatever columns are read and however the plan is run. The sample only balances the parts.
    """
    kind = df.schema[order].dataType
    values = df.select(F.col(order).alias("v")).where("v is not null")
    n = values.count()
    parts = int(min(MOST_PARTS, max(-(-n // PART_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    share = min(1.0, parts * SAMPLES / max(n, 1))
    some = values.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= int(share * (1 << 20))).distinct().orderBy("v")
    found = [r["v"] for r in some.collect()]
    bounds = [found[k * len(found) // parts] for k in range(1, parts)] if len(found) >= parts else found[1:]
    blocks = [bounds[k : k + BOUNDS] for k in range(0, len(bounds), BOUNDS)]
    if not blocks:
        return df.withColumn("_part", F.lit(0)), 1
    v, literal = F.col(order), lambda some: F.array(*[F.lit(x) for x in some]).cast(T.ArrayType(kind))
    below = F.size(F.filter(literal([b[-1] for b in blocks]), lambda b: b <= v))
    inner = F.size(F.filter(F.get(F.array(*map(literal, blocks)), below), lambda b: b <= v))
    return df.withColumn("_part", F.when(v.isNull(), 0).otherwise(below * BOUNDS + F.when(below < len(blocks), inner).otherwise(0) - F.when(below == len(blocks), len(blocks) * BOUNDS - len(bounds)).otherwise(0)).cast("int")), len(bounds) + 1


def running_total(df: DataFrame, order: str, size: Column, name: str) -> DataFrame:
    """Adds the sum of ``size`` over the rows before each row in the order of a unique column, without one task seeing every row.

    Sums within ranges of the order, and the ranges' totals before them: at most MOST_PARTS of these go through the driver.
    """
    parts, _ = with_parts(df.withColumn("_size", size), order)
    totals = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.sum("_size").alias("n")).collect()}
    before, sums = 0, []
    for part in sorted(totals):
        sums.append((part, before))
        before += totals[part] or 0
    own = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = df.sparkSession.createDataFrame(sums, "_part int, _before long")
    return parts.withColumn("_own", own).join(F.broadcast(known), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_size", "_own", "_before")


def with_rank(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """Adds the place of each row (from 0) in the order of a unique column."""
    return running_total(df, order, F.lit(1), name)


def with_places(df: DataFrame, name: str = "place") -> DataFrame:
    """Adds the place (from 0) at which each row of a sorted table stands: partitions in order, and rows in order within each.

    A sort that runs twice may cut its partitions elsewhere, by another sample or other sizes. So it runs once, into a table in
    the shared folder (which stays); a row's partition and its number there, and the sizes of partitions, are all read from that.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "sorted")
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    marked.write.parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before, sums = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("_part").agg(F.count("*")).collect())):
        sums.append((part, before))
        before += n
    known = spark.createDataFrame(sums, "_part long, _before long")
    return rows.join(F.broadcast(known), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, aligned by name; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def union_distinct(*tables: DataFrame) -> DataFrame:
    return union_all(*tables).distinct()


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def is_gapless(df: DataFrame, column: str) -> DataFrame:
    """One row: whether the distinct values are exactly 0 to max."""
    return df.agg((F.coalesce(F.min(column), F.lit(0)) == 0).alias("from_zero"), (F.count_distinct(column) == F.coalesce(F.max(column) + 1, F.lit(0))).alias("no_gap")).select((F.col("from_zero") & F.col("no_gap")).alias("gapless"))


def movement(df: DataFrame, target: Column) -> DataFrame:
    """How many rows a redistribution moves from each partition to each target."""
    return df.select(F.spark_partition_id().alias("from"), target.alias("to")).groupBy("from", "to").count()


def over_limit(df: DataFrame, partition: Column, limit: int) -> DataFrame:
    """Rows of each partition against a limit: count, load (at most 1) and whether it is over."""
    counted = df.groupBy(partition.alias("partition")).agg(F.count("*").alias("rows"))
    return counted.withColumns({"load": F.least(F.col("rows") / F.lit(limit), F.lit(1.0)), "over": F.col("rows") > limit})


def duplicate_claims(claims: DataFrame) -> DataFrame:
    """Values of a kind that more than one name claims: (kind, value, names)."""
    return claims.groupBy("kind", "value").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)


def compare_counts(a: DataFrame, b: DataFrame, key: str, count: str = "count") -> DataFrame:
    """Keys whose counts differ between two tables, with both and the difference; a missing key counts 0."""
    both = a.select(key, F.col(count).alias("left_count")).join(b.select(key, F.col(count).alias("right_count")), key, "full")
    filled = both.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_count", "right_count")])
    return filled.withColumn("delta", F.col("left_count") - F.col("right_count")).where("delta <> 0")


def partition_checksums(df: DataFrame, partition: str, keys: Sequence[str]) -> DataFrame:
    """Rows and an order-free checksum of the keys for each partition."""
    return df.groupBy(partition).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*keys)).alias("checksum"))
