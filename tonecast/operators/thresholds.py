"""One-vs-rest decision thresholds on class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonecast.schema import SENTIMENTS

GRID = [0.15 + i * 0.05 for i in range(14)]


def f1_curve(df: DataFrame, prob_cols: dict[str, str], true: str = "sentiment", grid: list[float] = GRID) -> DataFrame:
    """Binary F1 of every class at every grid point.

    Each row is reduced to the number of grid points its probability reaches, so one aggregate
    over (class, level) is enough; the curve is summed up from those few counts.
    """
    cells = []
    for label, column in prob_cols.items():
        level = sum((F.when(F.col(column) >= t, 1).otherwise(0) for t in grid), F.lit(0))
        cells.append(F.struct(F.lit(label).alias("label"), level.alias("level"),
                              F.coalesce(F.col(true) == label, F.lit(False)).alias("is_label")))
    levels = (df.select(F.inline(F.array(*cells))).groupBy("label", "level")
              .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_label").alias("pos")))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    points = levels.select("label", "level", "n", "pos", F.inline(steps))
    reached = F.col("level") > F.col("step")
    sums = points.groupBy("label", "step", "threshold").agg(
        F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(reached, F.col("n")).otherwise(0)).alias("predicted"), F.sum("pos").alias("actual"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("predicted") + F.col("actual"), F.lit(0)), F.lit(0.0))
    return sums.select("label", "step", "threshold", f1.alias("f1"))


def tune(df: DataFrame, prob_cols: dict[str, str], true: str = "sentiment", grid: list[float] = GRID) -> DataFrame:
    """Best threshold per class; the lowest wins a tie."""
    curve = f1_curve(df, prob_cols, true, grid)
    best = F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("step")))
    return curve.groupBy("label").agg(best.alias("b")).select("label", F.col("b.threshold").alias("threshold"),
                                                              F.col("b.f1").alias("f1"))


def as_dict(tuned: DataFrame, default: float = 0.5) -> dict[str, float]:
    """Tuned thresholds on the driver: one number per class."""
    found = {r["label"]: r["threshold"] for r in tuned.collect()}
    return {label: found.get(label, default) for label in SENTIMENTS}


def decide(prob_cols: dict[str, str], thresholds: dict[str, float]) -> Column:
    """Class with the largest margin over its threshold (a tie goes to the later name);
    if none is reached, the most probable class (the first one on a tie)."""
    labels = list(prob_cols)
    candidates = [F.when(F.col(prob_cols[c]) >= thresholds[c],
                         F.struct((F.col(prob_cols[c]) - F.lit(thresholds[c])).alias("margin"), F.lit(c).alias("label")))
                  for c in labels if c in thresholds]
    reached = F.array_compact(F.array(*candidates))
    probs = F.array(*[F.col(prob_cols[c]) for c in labels])
    first_best = F.array_position(probs, F.array_max(probs)).cast("int")
    likeliest = F.element_at(F.array(*[F.lit(c) for c in labels]), first_best)
    return F.when(F.size(reached) > 0, F.array_max(reached)["label"]).otherwise(likeliest)
