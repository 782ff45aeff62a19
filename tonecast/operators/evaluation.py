"""Classifier quality from counts of (true, predicted) pairs.

Every metric starts from one grouped count; what follows handles label pairs, not reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonecast.functions import expressions as ex
from tonecast.schema import SENTIMENTS
from tonecast.session import materialize


def pair_counts(df: DataFrame, *keys: str, true: str = "sentiment", pred: str = "sentiment_pred") -> DataFrame:
    present = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)) if keys else df
    return present.groupBy(*keys, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def _zero_safe(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def class_report(df: DataFrame, *keys: str, true: str = "sentiment", pred: str = "sentiment_pred",
                 labels: list[str] | None = SENTIMENTS) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined ratios are 0.

    With ``labels`` every listed class appears in every group; with None only the classes
    seen as truth or prediction of the group.
    """
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)

    def part(label: Column, tp: Column, actual: Column, predicted: Column) -> Column:
        return F.struct(label.alias("label"), tp.alias("tp"), actual.alias("actual"), predicted.alias("predicted"))

    parts = [part(F.col("t"), hit, F.col("n"), zero), part(F.col("p"), zero, zero, F.col("n"))]
    parts += [part(F.lit(name), zero, zero, zero) for name in labels or []]
    long = pair_counts(df, *keys, true=true, pred=pred).select(*keys, F.inline(F.array(*parts)))
    long = long.filter(F.col("label").isin(*labels) if labels else F.col("label").isNotNull())
    t = long.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    tp, actual, predicted = F.col("tp"), F.col("actual"), F.col("predicted")
    return t.select(*keys, "label", _zero_safe(tp, predicted).alias("precision"), _zero_safe(tp, actual).alias("recall"),
                    _zero_safe(2 * tp, actual + predicted).alias("f1"), actual.alias("support"), "tp")


def averages(report: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, macro and support-weighted means over the classes of a report."""
    weight = F.col("support")
    cols = [F.sum("support").alias("rows"), _zero_safe(F.sum("tp"), F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        cols.append(F.avg(m).alias(f"macro_{m}"))
        cols.append(_zero_safe(F.sum(F.col(m) * weight), F.sum(weight)).alias(f"weighted_{m}"))
    return report.groupBy(*keys).agg(*cols) if keys else report.agg(*cols)


def quality(df: DataFrame, true: str = "sentiment", pred: str = "sentiment_pred",
            labels: list[str] | None = None) -> DataFrame:
    """One row: rows, accuracy, macro and weighted scores. By default classes present in the data count."""
    return averages(class_report(df, true=true, pred=pred, labels=labels))


def quality_by(df: DataFrame, key: str, min_rows: int = 30, labels: list[str] | None = None,
               true: str = "sentiment", pred: str = "sentiment_pred") -> DataFrame:
    """Scores per key value for values with enough rows, best weighted F1 first.

    A row without a true label is a row of its key that no prediction matches.
    """
    table = averages(class_report(df, key, true=true, pred=pred, labels=labels), key)
    matched = F.round(F.col("accuracy") * F.col("rows"))  # the number of hits again
    table = table.withColumn("_hits", matched).drop("rows").join(_all_rows(df, key, true, pred, min_rows), key)
    table = table.withColumn("accuracy", F.col("_hits") / F.col("rows")).drop("_hits")
    return table.select(key, "rows", *[c for c in table.columns if c not in (key, "rows")]).orderBy(F.desc("weighted_f1"), key)


def _all_rows(df: DataFrame, key: str, true: str, pred: str, least: int) -> DataFrame:
    """Rows per key value, from the same grouped counts as the report (their shuffle is shared)."""
    rows = pair_counts(df, key, true=true, pred=pred).groupBy(key).agg(F.sum("n").alias("rows"))
    return rows.filter(F.col("rows") >= least)


def class_report_by(df: DataFrame, key: str, min_rows: int = 30, true: str = "sentiment",
                    pred: str = "sentiment_pred") -> DataFrame:
    report = class_report(df, key, true=true, pred=pred)
    return report.join(_all_rows(df, key, true, pred, min_rows), key)


def confusion(df: DataFrame, labels: list[str] = SENTIMENTS, true: str = "sentiment",
              pred: str = "sentiment_pred") -> DataFrame:
    """Full matrix on fixed labels as long rows, with the share of each true class; other labels are ignored."""
    pairs = [(t, p) for t in labels for p in labels]
    counts = df.agg(*[F.count_if((F.col(true) == t) & (F.col(pred) == p)).alias(f"c{i}")
                      for i, (t, p) in enumerate(pairs)])
    k = len(labels)
    row_sum = {t: sum((F.col(f"c{i * k + j}") for j in range(k)), F.lit(0)) for i, t in enumerate(labels)}
    cells = [F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"), F.col(f"c{i}").alias("rows"),
                      (F.col(f"c{i}") / F.greatest(row_sum[t], F.lit(1))).alias("share"))
             for i, (t, p) in enumerate(pairs)]
    return counts.select(F.inline(F.array(*cells)))


def label_union(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sorted distinct labels of two columns."""
    return (df.select(F.col(a).alias("label")).union(df.select(F.col(b).alias("label")))
            .filter(F.col("label").isNotNull()).distinct().orderBy("label"))


_LABEL_BLOCK = 512  # labels that a true label meets in one row of the zero fill


def union_confusion(df: DataFrame, true: str = "aspect", pred: str = "aspect_pred") -> DataFrame:
    """Matrix over the union of both label sets, zero-filled, with row shares.

    The labels, an open set, stay a table. It is dealt into blocks by hash; each true label is copied to every block and
    meets the labels of one there, so the fill is an even equi-join that no task holds a whole side of.
    """
    pairs = materialize(pair_counts(df, true=true, pred=pred).filter(F.col("t").isNotNull() & F.col("p").isNotNull()), "pairs")
    labels = pairs.select(F.explode(F.array("t", "p")).alias("label")).distinct()
    blocks = max(1, -(-labels.count() // _LABEL_BLOCK))
    totals = pairs.groupBy("t").agg(F.sum("n").alias("total"))
    rows = labels.join(totals, F.col("label") == F.col("t"), "left").select(
        F.col("label").alias("true_label"), F.coalesce("total", F.lit(0)).alias("total"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    columns = labels.select(F.col("label").alias("pred_label"), F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("block"))
    cells = rows.join(columns, "block").drop("block")
    n = F.coalesce("n", F.lit(0))
    found = pairs.select(F.col("t").alias("true_label"), F.col("p").alias("pred_label"), "n")
    return cells.join(found, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", n.alias("rows"), (n / F.greatest(F.col("total"), F.lit(1))).alias("share"))


def calibration(df: DataFrame, confidence: str = "sentiment_confidence", bins: int = 10,
                true: str = "sentiment", pred: str = "sentiment_pred") -> DataFrame:
    """Accuracy and mean confidence in equal-width, right-closed bins over the observed range; empty bins vanish."""
    # confidences carry four places: one row per value is left for everything that follows
    correct = ex.equal(F.col(true), F.col(pred)).cast("int")
    values = (df.filter(F.col(confidence).isNotNull()).groupBy(F.col(confidence).alias("c"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("ok")))
    # bounds over whole rows: the same columns are shuffled for both uses, so the scan is shared
    row = F.struct("c", "n", "ok")
    bounds = values.agg(F.struct(F.min(row).alias("low"), F.max(row).alias("high")).alias("b")).scalar()
    values = values.withColumn("b", bounds)
    low, high = F.col("b.low.c"), F.col("b.high.c")
    step = (high - low) / bins
    above = sum((F.when(F.col("c") > low + k * step, 1).otherwise(0) for k in range(1, bins)), F.lit(0))
    bin_no = F.when(high == low, F.lit(bins // 2)).otherwise(above + 1)
    return values.groupBy(bin_no.alias("bin")).agg(
        (F.sum("ok") / F.sum("n")).alias("accuracy"), (F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("avg_conf"),
        F.sum("n").alias("rows"))


def agreement(df: DataFrame, true: str = "aspect", pred: str = "aspect_pred") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.avg(ex.equal(F.col(true), F.col(pred)).cast("int")), F.lit(0.0)).alias("agreement"))


def comparison(runs: list[tuple[str, str, DataFrame]], true: str = "sentiment", pred: str = "sentiment_pred") -> DataFrame:
    """Summary table of several (model, split, scored rows) runs."""
    rows = [quality(df, true, pred).select(F.lit(model).alias("model"), F.lit(split).alias("split"),
                                           F.col("accuracy").alias("acc"), F.col("macro_f1"))
            for model, split, df in runs]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
