"""Building blocks that keep hot keys and large top-k requests distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonecast.session import materialize

# largest k for which Spark prunes each input partition before the ranking shuffle
_PRUNED_K = 1000
# largest n handed to a single final task by orderBy().limit()
_SMALL_LIMIT = 100_000
# rows that one task ranks
_BUCKET_ROWS = 50_000


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank",
                    salts: int = 64) -> DataFrame:
    """First ``k`` rows of every group with their 1-based rank.

    Up to 1000 rows per group the optimiser itself limits every group inside each
    input partition before the shuffle. For larger ``k`` rows are first ranked in
    salted sub-groups, so no task ever sorts a whole hot group.
    """
    if k > _PRUNED_K:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= k).drop("_salt", "_r")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def join_hot_keys(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot_share: float = 1e-3,
                  salts: int = 256) -> DataFrame:
    """Equi-join that spreads keys holding more than ``hot_share`` of the left rows.

    At most ``1/hot_share`` keys can be that frequent, so the table of hot keys has a
    proven bound and may be broadcast. Left rows of a hot key get one of ``salts``
    sub-keys, the few right rows of that key are copied to all of them; all other rows
    keep sub-key 0. Works for inner, left, left_semi and left_anti joins.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    floor = counts.agg(F.sum("_n") * hot_share).scalar()
    hot = F.broadcast(counts.filter(F.col("_n") > F.greatest(floor, F.lit(1000.0)))
                      .select(key, F.lit(True).alias("_hot")))
    # content and input partition fix the sub-key, so a re-run task repeats it exactly
    content = [c for c in left.columns if left.schema[c].dataType.typeName() != "map"]
    spread = F.pmod(F.xxhash64(*content, F.spark_partition_id()), F.lit(salts))
    l = (left.join(hot, key, "left")
         .withColumn("_sub", F.when(F.col("_hot") | F.col(key).isNull(), spread).otherwise(F.lit(0).cast("long")))
         .drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(
        F.array(F.lit(0).cast("long")))
    r = right.join(hot, key, "left").withColumn("_sub", F.explode(copies)).drop("_hot")
    return l.join(r, [key, "_sub"], how).drop("_sub")


def hash_sample(df: DataFrame, n: int, hashed: Column, tie: Column) -> DataFrame:
    """The ``n`` rows of lowest ``hashed`` text (hex digits), an exact and repeatable sample.

    Small samples are one top-n. For large ones the cut is found on the 65,536 counts
    of four-digit prefixes; all rows below the cut pass a filter and only the prefix that
    contains it is ordered.
    """
    keyed = df.withColumn("_h", hashed)
    if n <= _SMALL_LIMIT:
        return keyed.orderBy("_h", tie).limit(n).drop("_h")
    prefix = F.substring("_h", 1, 4)
    sizes = keyed.groupBy(prefix.alias("p")).count().orderBy("p").collect()  # at most 65,536 rows
    taken, cut = 0, None
    for row in sizes:
        if taken + row["count"] > n:
            cut = row["p"]
            break
        taken += row["count"]
    if cut is None:
        return keyed.drop("_h")
    whole = keyed.filter(prefix < cut)
    rest = keyed.filter(prefix == cut).orderBy("_h", tie).limit(n - taken)
    return whole.unionByName(rest).drop("_h")


def first_in_order(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first ``n`` rows by ``keys``. Small results are one top-n.

    For large ones the rows are written in ranges of the keys; whole ranges pass, and only the range that holds the
    cut is ordered.
    """
    if n <= _SMALL_LIMIT:
        return df.orderBy(*keys).limit(n)
    ranged = materialize(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # one row per partition
    taken, cut = 0, None
    for part in sorted(sizes):
        if taken + sizes[part] > n:
            cut = part
            break
        taken += sizes[part]
    if cut is None:
        return ranged.drop("_range")
    whole = ranged.filter(F.col("_range") < cut)
    rest = ranged.filter(F.col("_range") == cut).orderBy(*keys).limit(n - taken)
    return whole.unionByName(rest).drop("_range")


def distributed_rank(df: DataFrame, group: str, hashed: Column, tie: Column, rank: str = "rank") -> DataFrame:
    """``row_number() over (partition by group order by hash, tie)`` without one task per group.

    Rows are ranked inside (group, leading hash digits); the bucket sizes per group give the offsets. The number
    of digits follows the number of rows, so that a bucket holds about ``_BUCKET_ROWS`` of them at every size.
    Null is a group like any other.
    """
    digits = 1
    rows = df.count()
    while rows > _BUCKET_ROWS * 16 ** digits:
        digits += 1
    keyed = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, digits))
    sizes = keyed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_b").alias("_c"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(group, "_b").orderBy("_h", tie)
    ranked = keyed.withColumn("_r", F.row_number().over(inner))
    same = ranked[group].eqNullSafe(offsets["_g"]) & (ranked["_b"] == offsets["_c"])
    return (ranked.join(offsets, same)
            .withColumn(rank, F.col("_r") + F.col("_o")).drop("_h", "_b", "_r", "_o", "_g", "_c"))


def spread_small_input(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition an input with fewer splits than cores, before costly work per row.

    A no-op for inputs with enough splits, so large tables are never shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def compact(df: DataFrame, rows: int, rows_per_task: int = 5_000) -> DataFrame:
    """Fewer partitions for a small table that an iterative fit passes over many times.

    Each pass costs every task a full-size gradient, so tasks should hold enough rows to pay for it.
    Tables with enough rows per partition are left as they are.
    """
    wanted = max(1, -(-rows // rows_per_task))
    return df.repartition(wanted) if wanted < df.rdd.getNumPartitions() else df


def for_steps(df: DataFrame, rows: int, rows_per_task: int = 50_000) -> tuple[DataFrame, int]:
    """A table for a fit of many steps, and the aggregation depth with which each step sends the driver one sum.

    ``treeAggregate`` divides the partitions by the depth-th root of their number, rounded up, until that no longer helps,
    and what is left sends its sum to the driver. From 28 partitions and depth 3 it goes to 7 and to 1, as it does from 28
    times a power of 4 with one more level for each. Small tables stay in the few tasks they have.
    """
    if rows <= 25_000:
        return df, 2
    partitions, depth = 28, 3
    while rows > partitions * rows_per_task:
        partitions, depth = 4 * partitions, depth + 1
    return df.repartition(partitions), depth
