"""Batch jobs: cleaning, score artifacts, training, whole-table scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonecast.operators import (cleaning, errors, evaluation, oversampling, phrases, retrieval, splits, tallies,
                                thresholds, topics)
from tonecast.operators.classifier import (PAIR, PROBABILITIES, SentimentModel, prediction_view, score_reviews,
                                           select_variant, with_pair)
from tonecast.schema import DOCUMENT_SCHEMA, SCORED_COLUMNS
from tonecast.session import materialize
from tonecast.sources import caches, readers, writers
from tonecast.sources.collection import Collection


def clean(spark: SparkSession, raw_csv: str, out: str) -> DataFrame:
    """Raw CSV to the cleaned table (10 aspects), written as CSV."""
    cleaned = cleaning.clean_reviews(readers.read_csv(spark, raw_csv, ["review_text", "aspect"]))
    writers.write_csv(cleaned, out)
    return cleaned


def prepare_dashboard(spark: SparkSession, scored_csv: str, out: str) -> DataFrame:
    """Scored reviews with parsed dates, calendar and lengths as Parquet by year and month, parsed once for all reports.

    Rows are written in ranges of month and id, so a month of any size is spread over tasks and files.
    """
    _write_months(readers.read_dashboard(spark, scored_csv), out, "errorifexists")
    return readers.read_prepared(spark, out)


def refresh_dashboard(spark: SparkSession, scored_csv: str, out: str) -> list[str]:
    """Bring a prepared table up to date with its source: only months whose rows differ are written again.

    Months are compared by row counts and sums of row hashes on both sides. A month that has no rows any more is left
    out. Returns the months written.
    """
    new, old = readers.read_dashboard(spark, scored_csv), readers.read_prepared(spark, out)

    def told(df: DataFrame, side: str) -> DataFrame:
        columns = sorted(c for c in new.columns if c != "month_of")
        return _with_month(df).groupBy("month_of").agg(
            F.count("*").alias(f"{side}_n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(f"{side}_h"))
    both = told(new, "new").join(told(old, "old"), "month_of", "full")
    same = F.col("new_n").eqNullSafe(F.col("old_n")) & F.col("new_h").eqNullSafe(F.col("old_h"))
    changed = both.filter(~same).select("month_of", F.col("new_n").isNull().alias("gone")).collect()  # calendar months
    months = sorted(r["month_of"] for r in changed if not r["gone"])
    if months:
        _write_months(_with_month(new).filter(F.col("month_of").isin(months)), out, "overwrite")
    for r in changed:
        if r["gone"]:
            year = "__HIVE_DEFAULT_PARTITION__" if r["month_of"] == "none" else int(r["month_of"][:4])
            writers.remove(spark, f"{out.rstrip('/')}/year={year}/month_of={r['month_of']}")
    return months + sorted(r["month_of"] for r in changed if r["gone"])


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month_of", F.coalesce("year_month", F.lit("none")))


def _write_months(df: DataFrame, out: str, mode: str) -> None:
    dated = _with_month(df)
    ranged = dated.repartitionByRange("month_of", F.xxhash64("review_text", "aspect", "created_at_date"))
    writers.write_parquet(ranged, out, ["year", "month_of"], mode, overwrite_parts=mode == "overwrite")


def grow_collection(reviews: DataFrame, path: str, force: bool = False) -> Collection:
    """Retrieval documents of all reviews put into the collection kept under ``path`` (see ``sources.collection``)."""
    kept = Collection(reviews.sparkSession, path, DOCUMENT_SCHEMA)
    kept.upsert(retrieval.seed_documents(reviews), force)
    return kept


def score_artifacts(spark: SparkSession, raw_csv: str, out: str) -> dict[str, DataFrame]:
    """Overall, daily and per-aspect scores of the labelled raw table."""
    labelled = cleaning.clean_labels(readers.read_raw(spark, raw_csv))
    dated = cleaning.with_calendar(cleaning.with_dates(labelled))
    tables = {
        "overall": tallies.nss_overall(dated).select("rows", "nss"),
        "daily": tallies.nss_table(dated, "date").select("date", "rows", "nss").orderBy("date"),
        "by_aspect": tallies.nss_table(dated, "aspect").select("aspect", "rows", "nss").orderBy(F.desc("rows"), "aspect"),
    }
    writers.write_nss_text(tables["overall"], f"{out}/nss_overall")
    writers.write_csv(tables["daily"], f"{out}/nss_daily")
    writers.write_csv(tables["by_aspect"], f"{out}/nss_by_aspect")
    return tables


@dataclass
class TrainingResult:
    model: SentimentModel
    rows: DataFrame            # split, rows
    summary: DataFrame         # model, split, acc, macro_f1
    reports: dict[str, DataFrame]
    errors: DataFrame


def _reports(scored: DataFrame, split: str) -> dict[str, DataFrame]:
    return {f"{split}_report": evaluation.class_report(scored), f"{split}_confusion": evaluation.confusion(scored),
            f"{split}_by_aspect": evaluation.quality_by(scored, "aspect", 30)}


def train(spark: SparkSession, reviews: DataFrame, out: str | None = None, max_rows: int | None = None,
          key: str = "review_id", max_iter: int = 2000, min_df: int = 2) -> TrainingResult:
    """Second-generation training: split by text, fit on train, report on validation and test.

    The labelled, split table is written once before the iterative fit.
    """
    rows = cleaning.prepare_cleaned(reviews)
    if max_rows is not None:
        rows = cleaning.sample_rows(rows, max_rows, key=key)
    rows = materialize(splits.attach_split(rows, splits.stratified_folds(rows)), "training-rows")
    splits.verify_no_leakage(rows)
    part = {s: rows.filter(F.col("split") == s) for s in ("train", "val", "test")}
    splits.require_two_classes(part["train"])
    model = SentimentModel.fit(part["train"], max_iter=max_iter, min_df=min_df)
    scored = {s: model.transform(part[s]) for s in ("val", "test")}
    result = TrainingResult(
        model, rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows")),
        evaluation.comparison([("baseline", s, df) for s, df in scored.items()]),
        {**_reports(scored["val"], "val"), **_reports(scored["test"], "test")},
        errors.first_errors(scored["test"], 30, key))
    if out:
        model.save(f"{out}/model")
        writers.write_csv(result.errors, f"{out}/errors_baseline")
        writers.write_json(result.summary, f"{out}/summary")
        for name, report in result.reports.items():
            writers.write_json(report, f"{out}/{name}")
    return result


def text_artifacts(reviews: DataFrame) -> dict[str, DataFrame]:
    """Daily and aspect scores, cloud words and topics of the cleaned table."""
    dated = cleaning.with_calendar(cleaning.with_dates(reviews))
    return {
        "nss_daily": tallies.nss_table(dated, "date").orderBy("date"), "nss_by_aspect": tallies.nss_by_aspect(reviews),
        "cloud_positive": phrases.top_terms(reviews.filter(F.col("sentiment") == "Positive"), 150),
        "cloud_negative": phrases.top_terms(reviews.filter(F.col("sentiment") == "Negative"), 150),
        "topics": topics.topics_by_polarity(reviews),
    }


def train_with_thresholds(spark: SparkSession, reviews: DataFrame, use_predicted_aspect: bool = False,
                          cache: DataFrame | None = None, key: str = "review_id", max_rows: int | None = None,
                          max_iter: int = 2000, out: str | None = None) -> dict:
    """First-generation training: balanced weights against oversampling, thresholds tuned on validation.

    ``reviews`` are raw labelled rows. Splits are fixed by text before predicted aspects are joined.
    The variant with the better validation macro-F1 wins; the weighted one keeps a tie. The oversampled fit may take
    500 steps more than ``max_iter``. With ``out`` the metric record, reports, model and the grown cache are written.
    """
    rows = cleaning.clean_labels(reviews)
    if max_rows is not None:
        rows = cleaning.first_rows(rows, max_rows, key)
    rows = splits.attach_split(rows, splits.stratified_folds(rows))
    grown = cache
    if use_predicted_aspect:
        empty = spark.createDataFrame([], "text_id string, aspect_pred string")
        rows, grown = caches.complete_cache(rows, cache if cache is not None else empty, cleaning.with_rule_aspect)
    aspect = "aspect_pred" if use_predicted_aspect else "aspect"
    rows = materialize(rows, "training-rows")
    splits.verify_no_leakage(rows)
    part = {s: rows.filter(F.col("split") == s) for s in ("train", "val", "test")}
    splits.require_two_classes(part["train"])

    weighted = SentimentModel.fit(part["train"], aspect, max_iter=max_iter, sublinear=False, min_df=1)
    vectors = weighted.features.transform(with_pair(part["train"], aspect), PAIR).select(key, "sentiment", "features")
    balanced_rows = materialize(oversampling.interpolate_minority(vectors, key=key), "balanced-rows")
    oversampled = SentimentModel.fit_vectors(weighted.features, balanced_rows, "sentiment", 1.5, max_iter + 500, False)

    models = {"tfidf_logreg_classweight_balanced": weighted, "tfidf_logreg_smote": oversampled}
    tuned, decided = {}, {}
    for name, model in models.items():
        val = model.transform(part["val"], aspect)
        tuned[name] = thresholds.as_dict(thresholds.tune(val, PROBABILITIES))
        decided[name] = val.withColumn("decision", thresholds.decide(PROBABILITIES, tuned[name]))
    chosen, macro_f1 = select_variant(decided, "decision")
    test = models[chosen].transform(part["test"], aspect).withColumn(
        "decision", thresholds.decide(PROBABILITIES, tuned[chosen]))
    result = {"variant": chosen, "thresholds": tuned[chosen], "validation_macro_f1": macro_f1, "model": models[chosen],
              "val_report": evaluation.class_report(decided[chosen], pred="decision"),
              "test_report": evaluation.class_report(test, pred="decision"),
              "test_by_aspect": evaluation.class_report_by(test, aspect, 50, pred="decision"),
              "rows": rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows")), "cache": grown}
    if out:
        models[chosen].save(f"{out}/model")
        metrics = [(chosen, label, float(cut), float(macro_f1[chosen])) for label, cut in tuned[chosen].items()]
        writers.write_json(spark.createDataFrame(metrics, "variant string, label string, threshold double, macro_f1 double"),
                           f"{out}/metrics")
        for name in ("val_report", "test_report", "test_by_aspect", "rows"):
            writers.write_json(result[name], f"{out}/{name}")
        if grown is not None:
            writers.write_parquet(grown, f"{out}/aspect_cache")
    return result


def score_table(reviews: DataFrame, model: SentimentModel, out: str | None = None) -> DataFrame:
    """Whole-table scoring: keyword aspect, predicted sentiment, confidence; known columns in fixed order."""
    scored = cleaning.project_known(score_reviews(reviews, model), SCORED_COLUMNS)
    if out:
        writers.write_parquet(scored, out)
    return scored


def score_file(spark: SparkSession, path: str, model: SentimentModel) -> DataFrame:
    """Predictions for a text file with one review per line."""
    return prediction_view(score_reviews(readers.read_lines(spark, path), model))
