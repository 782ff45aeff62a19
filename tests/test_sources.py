import pytest
from pyspark.sql import functions as F

from tonecast.plans import jobs
from tonecast.schema import RAW_COLUMNS
from tonecast.session import materialize, shared_dir
from tonecast.sources import readers, writers

ROWS = [
    ('He said "fine",\nthen left', "5", "web", "2020-01-02", "Silom", "Town", "Staff quality", "Positive"),
    ("dirty floor", "1", "", "03/04/2020", "", "", "Cleanliness", "Negative"),
    ("no date", "2", "web", "never", "", "", "Cleanliness", "Neutral"),
    ("nothing to say", "3", "web", "2020-01-02", "", "", "Irrelevant", "Neutral"),
]


@pytest.fixture
def raw_csv(tmp_path):
    def quote(x):
        return '"' + x.replace('"', '""') + '"' if x else ""
    path = tmp_path / "raw.csv"
    path.write_text(",".join(RAW_COLUMNS) + "\n" + "\n".join(",".join(map(quote, r)) for r in ROWS) + "\n")
    return str(path)


def test_csv_with_line_breaks_and_quotes(spark, raw_csv):
    df = readers.read_raw(spark, raw_csv)
    assert df.count() == 4
    row = df.filter("review_rating = 5").first()
    assert row["review_text"] == 'He said "fine",\nthen left' and row["review_rating"] == 5
    assert df.filter("source is null").count() == 1


def test_missing_columns(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("review_text,aspect\nx,y\n")
    with pytest.raises(ValueError, match="sentiment"):
        readers.read_raw(spark, str(path))


def test_score_artifacts(spark, raw_csv, tmp_path):
    tables = jobs.score_artifacts(spark, raw_csv, str(tmp_path / "out"))
    assert tuple(tables["overall"].first()) == (2, 0.0)
    text = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "nss_overall")).collect()]
    assert text == ["rows=2", "NSS=0.00"]
    daily = spark.read.option("header", True).csv(str(tmp_path / "out" / "nss_daily"))
    assert sorted(r["date"] for r in daily.collect()) == ["2020-01-02", "2020-03-04"]


def test_clean_job(spark, raw_csv, tmp_path):
    jobs.clean(spark, raw_csv, str(tmp_path / "clean"))
    again = readers.read_cleaned(spark, str(tmp_path / "clean"))
    assert {r["review_text"]: r["aspect"] for r in again.collect()} == {
        'He said "fine",\nthen left': "Staff & Service Quality", "dirty floor": "Cleanliness & Hygiene", "no date": "Cleanliness & Hygiene"}


def test_dashboard_reader(spark, raw_csv):
    df = readers.read_dashboard(spark, raw_csv)
    assert df.count() == 3 and "word_count" in df.columns


def test_parquet_partitions_and_pruning(spark, tmp_path):
    df = spark.range(10).withColumn("year", F.when(F.col("id") < 5, 2019).otherwise(2020))
    writers.write_parquet(df, str(tmp_path / "p"), "year")
    read = spark.read.parquet(str(tmp_path / "p")).filter("year = 2020")
    assert read.count() == 5
    assert "PartitionFilters: [isnotnull(year" in read._jdf.queryExecution().executedPlan().toString()


def test_json_sink(spark, tmp_path):
    writers.write_json(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["s"] == "a"


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(7), "seven")
    assert df.count() == 7
    assert df.inputFiles()[0].replace("file://", "").startswith(shared_dir(spark))


def test_prepared_dashboard_is_pruned(spark, tmp_path):
    from pyspark.sql import functions as F
    from tonecast.plans import jobs
    rows = [(f"text {k}", k % 5 + 1, "web", f"{2019 + k % 4}-0{1 + k % 9}-1{k % 9}", "Silom", "here", "Staff", "Positive") for k in range(40)]
    names = "review_text review_rating source created_at_date bts_line reviewer_hometown aspect sentiment".split()
    spark.createDataFrame(rows, names).coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    table = jobs.prepare_dashboard(spark, str(tmp_path / "csv"), str(tmp_path / "prepared"))
    assert table.count() == 40
    plan = table.filter((F.col("year") == 2020) & (F.col("created_at_date") >= F.lit("2020-03-01").cast("timestamp"))).select("aspect")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text and "GreaterThanOrEqual(created_at_date" in text
    assert "review_text" not in text.split("ReadSchema")[1]


def _reviews(spark, ids, text, aspect="Staff"):
    return spark.createDataFrame([(i, text, 3, "web", "2020-01-01", aspect, "Negative") for i in ids],
                                 "review_id string, review_text string, review_rating int, source string, created_at_date string, aspect string, sentiment string")


def _documents(collection, version=None):
    return sorted((r.id, r.document) for r in collection.read(version).collect())


def test_collection_is_kept_in_versions(spark, tmp_path):
    """Unchanged aspects keep their files; every version stays readable; seeding again changes nothing."""
    from tonecast.plans import jobs
    path = str(tmp_path / "docs")
    both = _reviews(spark, ["a", "b"], "old").union(_reviews(spark, ["x"], "fare", "Fare & Payment"))
    kept = jobs.grow_collection(both, path)
    assert _documents(kept) == [("Fare & Payment_x", "fare"), ("Staff_a", "old"), ("Staff_b", "old")]
    before = kept.manifest()
    jobs.grow_collection(_reviews(spark, ["z"], "late"), path)
    assert kept.versions() == [1]
    jobs.grow_collection(_reviews(spark, ["b", "c"], "new").union(_reviews(spark, ["x"], "fare", "Fare & Payment")), path, force=True)
    assert _documents(kept) == [("Fare & Payment_x", "fare"), ("Staff_a", "old"), ("Staff_b", "new"), ("Staff_c", "new")]
    assert kept.manifest()['"Fare & Payment"'] == before['"Fare & Payment"'] and kept.manifest()['"Staff"'] != before['"Staff"']
    assert len(_documents(kept, 1)) == 3
    assert kept.upsert(kept.read()) is None and kept.versions() == [1, 2]
    plan = kept.read().filter("aspect = 'Staff'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(aspect" in plan


def test_collection_survives_a_broken_change(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from tonecast.plans import jobs
    path = str(tmp_path / "docs")
    kept = jobs.grow_collection(_reviews(spark, ["a", "b"], "old"), path)
    want = _documents(kept)
    # a task fails while the documents are written
    broken = _reviews(spark, ["b", "c"], "new").withColumn("review_text", F.when(F.col("review_id") == "c", F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        jobs.grow_collection(broken, path, force=True)
    assert _documents(kept) == want
    # the documents are there, but the manifest is not
    monkeypatch.setattr(type(kept), "_publish", lambda self, folders: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        jobs.grow_collection(_reviews(spark, ["c"], "new"), path, force=True)
    monkeypatch.undo()
    assert _documents(kept) == want
    # the newest manifest was cut off
    jobs.grow_collection(_reviews(spark, ["c"], "new"), path, force=True)
    file = tmp_path / "docs" / "manifests" / "000000000002.json"
    whole = file.read_bytes()
    file.write_bytes(whole[:len(whole) // 2])
    (tmp_path / "docs" / "manifests" / ".000000000002.json.crc").unlink(missing_ok=True)
    assert _documents(kept) == want


def _raw(days):
    return [(f"text {k}", k % 5 + 1, "web", day, "Silom", "here", "Staff", "Positive", "Staff", "Positive", 0.9) for k, day in enumerate(days)]


_NAMES = "review_text review_rating source created_at_date bts_line reviewer_hometown aspect sentiment aspect_pred sentiment_pred sentiment_confidence".split()


def test_prepared_table_is_refreshed_by_month(spark, tmp_path):
    """A second load writes the months that changed only; a month of most rows is spread over files."""
    import os
    from tonecast.plans import jobs

    def csv(rows, name):
        spark.createDataFrame(rows, _NAMES).coalesce(1).write.option("header", True).csv(str(tmp_path / name))
        return str(tmp_path / name)
    days = ["2020-03-05"] * 300 + ["2020-04-01"] * 20 + ["2021-01-09"] * 20 + ["no date"] * 5
    out = str(tmp_path / "prepared")
    first = csv(_raw(days), "one")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    jobs.prepare_dashboard(spark, first, out)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(out) for f in names if f.endswith(".parquet")}
    before = files()
    sizes = [spark.read.parquet(f).count() for f in before if "2020-03" in f]
    assert len(sizes) > 2 and max(sizes) < 200
    assert jobs.refresh_dashboard(spark, str(tmp_path / "one"), out) == [] and files() == before
    changed = _raw(days)
    changed[305] = ("other text", *changed[305][1:])  # of April
    rows = [r for r in changed if not r[3].startswith("2021")]
    second = csv(rows, "two")
    assert jobs.refresh_dashboard(spark, second, out) == ["2020-04", "2021-01"]
    after = files()
    assert {f for f in before if "2020-03" in f or "none" in f} == {f for f in after if "2020-03" in f or "none" in f}
    assert not [f for f in after if "2021-01" in f]
    from tonecast.sources import readers
    columns = sorted(readers.read_dashboard(spark, second).columns)
    told = lambda df: sorted(map(str, df.select(columns).collect()))
    assert told(readers.read_prepared(spark, out)) == told(readers.read_dashboard(spark, second))


def test_bucketed_cache_is_not_shuffled(spark):
    from pyspark.sql import functions as F
    from tonecast.sources import caches
    old = spark.range(500).select(F.col("id").cast("string").alias("text_id"), F.lit("old").alias("aspect_pred"))
    caches.write_bucketed(old.union(old), "kept_aspects", buckets=8)
    try:
        df = spark.range(900).select((F.col("id") % 600).cast("string").alias("text_id"), F.lit("t").alias("review_text")).union(
            spark.createDataFrame([(None, "x")], "text_id string, review_text string"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = df.select("text_id").distinct().repartition(8, "text_id").join(spark.table("kept_aspects"), "text_id", "left_anti")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in text and "Exchange" not in text[text.index("BatchScan") if "BatchScan" in text else text.index("FileScan") - 200:]
        seen = []

        def scorer(rows):
            seen.append(rows.count())
            return rows.withColumn("aspect_pred", F.lit("new"))
        got = caches.complete_bucketed(df, "kept_aspects", scorer)
        values = {r["text_id"]: r["aspect_pred"] for r in got.collect()}
        assert got.count() == 901 and values["3"] == "old" and values["599"] == "new" and values[None] is None
        assert spark.table("kept_aspects").count() == 600
        caches.complete_bucketed(df, "kept_aspects", scorer)
        assert seen == [100, 0] and spark.table("kept_aspects").count() == 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE kept_aspects")


@pytest.mark.parametrize("text", ["plain", " both ends ", "\ttab", 'say "so"', '"', "a,b", "a\nb\n", "\n", "a\\b", "\\", "", " ", None, "é ü\u2003"])
def test_csv_keeps_every_text(spark, tmp_path, text):
    """An empty field is null; everything else comes back as it was."""
    rows = [("1", text, "x"), ("2", "next", None)]
    df = spark.createDataFrame(rows, "review_id string, review_text string, source string")
    writers.write_csv(df, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv")).orderBy("review_id").collect()
    assert [tuple(r) for r in back] == [("1", text or None, "x"), rows[1]]
