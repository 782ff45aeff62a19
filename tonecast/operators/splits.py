"""Leakage-safe train, validation and test splits: copies of a text never part."""

from __future__ import annotations

from statistics import pstdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonecast.functions import expressions as ex
from tonecast.operators import scaling
from tonecast.session import materialize

FOLDS = 5


def hash_fold(group: Column, folds: int = FOLDS, seed: int = 42) -> Column:
    """Fold that depends on the group id alone: map-only, repeatable, equal shares in expectation."""
    digits = F.substring(ex.seeded_hash(seed, group), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(folds)).cast("int")


def split_name(fold: Column) -> Column:
    return F.when(fold == 0, "test").when(fold == 1, "val").otherwise("train")


def with_split(df: DataFrame, folds: int = FOLDS, seed: int = 42, group: str = "text_id") -> DataFrame:
    return df.withColumn("split", split_name(hash_fold(F.col(group), folds, seed)))


def stratified_folds(df: DataFrame, folds: int = FOLDS, seed: int = 42, group: str = "text_id",
                     stratum: str = "sentiment") -> DataFrame:
    """One row per group with a fold dealt round-robin inside the group's most frequent label.

    A tie goes to the smaller label, missing labels do not count, and groups without any label are a stratum
    of their own. Ranking is distributed over hash buckets, so a label
    holding most groups is not sorted by one task.
    """
    counted = df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col(stratum).isNotNull(), F.struct(-F.col("n"), F.col(stratum)))
    # ranking reads the groups several times
    majority = materialize(counted.groupBy(group).agg(F.min_by(stratum, known).alias("label"), F.sum("n").alias("rows")), "groups")
    ranked = scaling.distributed_rank(majority, "label", ex.seeded_hash(seed, F.coalesce(group, F.lit(""))), F.col(group))
    fold = F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int")
    return ranked.select(group, "label", "rows", fold.alias("fold"), split_name(fold).alias("split"))


def deal_profiles(profiles: list[tuple[tuple[int, ...], int]], folds: int) -> list[list[int]]:
    """How many groups of each profile (label counts) go to each fold, so that every fold gets its share of every label.

    Profiles with the most uneven counts come first. Whole multiples of the number of folds are dealt evenly, which
    changes no balance; each group that is left goes to the fold where the label shares deviate least afterwards.
    """
    if not profiles:
        return []
    labels = len(profiles[0][0])
    totals = [max(1, sum(p[j] * n for p, n in profiles)) for j in range(labels)]
    held = [[0] * labels for _ in range(folds)]
    groups = [0] * folds
    out = [[n // folds] * folds for _, n in profiles]
    for i, (p, n) in enumerate(profiles):
        for k in range(folds):
            held[k] = [h + p[j] * out[i][k] for j, h in enumerate(held[k])]
            groups[k] += out[i][k]

    def spread(p: tuple[int, ...]) -> float:
        return sum((x - sum(p) / labels) ** 2 for x in p)
    for i in sorted(range(len(profiles)), key=lambda i: (-spread(profiles[i][0]), profiles[i][0])):
        p, n = profiles[i]
        for _ in range(n % folds):
            def deviation(k: int, p=p) -> tuple:
                shares = [[(h[j] + (p[j] if i == k else 0)) / totals[j] for i, h in enumerate(held)] for j in range(labels)]
                return sum(pstdev(x) for x in shares), groups[k], k
            k = min(range(folds), key=deviation)
            out[i][k] += 1
            groups[k] += 1
            held[k] = [h + p[j] for j, h in enumerate(held[k])]
    return out


def mixed_folds(df: DataFrame, labels: list[str], folds: int = FOLDS, seed: int = 42, group: str = "text_id",
                stratum: str = "sentiment") -> DataFrame:
    """One row per group with a fold, every fold holding about the same share of each of ``labels``.

    A group counts with all its labels: groups are reduced to their distinct profiles of label counts (few, as most texts
    occur once or twice), profiles are dealt on the driver, and the groups of a profile take the folds in order of a seeded
    hash, ranked over tasks. Other or missing labels do not count.
    """
    counted = df.groupBy(group).agg(*[F.count_if(F.col(stratum) == x).alias(f"c{i}") for i, x in enumerate(labels)],
                                    F.count(F.lit(1)).alias("rows"))
    profile = F.concat_ws(",", *[F.col(f"c{i}").cast("string") for i in range(len(labels))])
    groups = materialize(counted.select(group, profile.alias("profile"), "rows"), "groups")
    sizes = [(r["profile"], r["count"]) for r in groups.groupBy("profile").count().orderBy("profile").collect()]
    dealt = deal_profiles([(tuple(map(int, p.split(","))), n) for p, n in sizes], folds)
    bounds = [(p, [sum(d[:k + 1]) for k in range(folds)]) for (p, _), d in zip(sizes, dealt, strict=True)]
    table = df.sparkSession.createDataFrame(bounds, "profile string, bounds array<long>")
    ranked = scaling.distributed_rank(groups, "profile", ex.seeded_hash(seed, F.coalesce(group, F.lit(""))), F.col(group))
    fold = F.size(F.filter("bounds", lambda b: b < F.col("rank"))).alias("fold")
    placed = ranked.join(table, "profile").select(group, "profile", "rows", fold)
    return placed.withColumn("split", split_name(F.col("fold")))


def attach_split(df: DataFrame, folds_table: DataFrame, group: str = "text_id") -> DataFrame:
    """Split of every row from a table of groups; rows of a very frequent text are spread."""
    return scaling.join_hot_keys(df, folds_table.select(group, "split"), group, "left")


def leaking_groups(df: DataFrame, group: str = "text_id", split: str = "split") -> DataFrame:
    """Groups that occur in more than one split; must be empty."""
    seen = df.select(group, split).distinct()
    return (seen.groupBy(group).agg(F.count(F.lit(1)).alias("n_splits")).filter(F.col("n_splits") > 1))


def leakage_counts(df: DataFrame, group: str = "text_id", split: str = "split") -> DataFrame:
    """Number of shared groups for every pair of splits, from one pass over the groups."""
    per = df.groupBy(group).agg(*[F.max(F.col(split) == s).alias(s) for s in ("train", "val", "test")])
    return per.agg(F.count_if(F.col("train") & F.col("val")).alias("train_val"),
                   F.count_if(F.col("train") & F.col("test")).alias("train_test"),
                   F.count_if(F.col("val") & F.col("test")).alias("val_test"))


def verify_no_leakage(df: DataFrame, group: str = "text_id") -> None:
    row = leakage_counts(df, group).first()
    if any(row.asDict().values()):
        raise RuntimeError(f"Group leakage in splits: {row.asDict()}")


def require_two_classes(train: DataFrame, label: str = "sentiment") -> None:
    if train.select(label).distinct().limit(2).count() < 2:
        raise ValueError("Train split contains fewer than 2 sentiment classes.")


def remaining_groups(df: DataFrame, *taken: DataFrame, group: str = "text_id") -> DataFrame:
    """Distinct group ids of ``df`` that are in none of the ``taken`` tables (set difference)."""
    left = df.select(group).distinct()
    for other in taken:
        left = left.subtract(other.select(group))
    return left


def shared_groups(a: DataFrame, b: DataFrame, group: str = "text_id") -> DataFrame:
    return a.select(group).intersect(b.select(group))
