from pyspark.sql import functions as F

from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.operators import cleaning
from tonecast.operators.filters import Filters, apply_filters


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "review_text string")


def test_keyword_rules(spark):
    df = cleaning.with_rule_aspect(texts(
        spark, "The BTS was packed during rush hour", "Tickets are too expensive", "Random nonsense xyz",
        "The elevator was broken", "Top up at the counter", "real time updates", "new line to the suburb", None))
    got = [r["aspect_pred"] for r in df.collect()]
    assert got == ["Crowding & Comfort", "Fare & Payment System", tx.RULE_FALLBACK, "Facilities & Accessibility",
                   "Fare & Payment System", "Information & Navigation", "Route Coverage & Connectivity", tx.RULE_FALLBACK]


def test_keyword_search_equals_the_regex(spark):
    """Substring search and the plain regex agree on every rule, also for regex alternatives."""
    words = ["topup", "top-up", "top  up", "airxcon", "air con", "aircon", "realtime", "real/time", "crowded", "FEES",
             "coffee", "late", "plate", "sanitizer", "", "wheelchairs", "on  time", "on time"]
    df = texts(spark, *words)
    for name, pattern in tx.ASPECT_RULES:
        fast = column(df, ex.first_rule(F.col("review_text"), [(name, pattern)], "-"))
        slow = column(df, F.when(F.lower("review_text").rlike(pattern), name).otherwise("-"))
        assert fast == slow, name


def test_first_rule_wins(spark):
    assert column(texts(spark, "cheap and clean"), ex.first_rule(F.col("review_text"), tx.ASPECT_RULES, "-")) == [
        "Fare & Payment System"]


def test_known_aspect(spark):
    df = texts(spark, "Why is staff rude?", "Are the trains clean? cleanliness", "What about safety", "no clue", "with & and")
    assert column(df, ex.known_aspect(F.col("review_text"), tx.QUESTION_WORDS)) == [
        "Staff & Service", "Cleanliness", "Safety & Security", None, None]


def test_text_id_ignores_case_and_spacing(spark):
    ids = column(texts(spark, "Good  Train", " good\ttrain\n", "good train!", None, ""), ex.text_id(F.col("review_text")))
    assert ids[0] == ids[1] != ids[2]
    assert ids[3] == ids[4] and all(len(i) == 16 for i in ids)


def test_lenient_dates(spark):
    df = spark.createDataFrame([("2020-02-30",), ("2020-02-03",), ("05/03/2020",), ("25/03/2020",), ("Mar 5, 2021",),
                                ("soon",), (None,)], "d string")
    got = column(df, F.date_format(ex.lenient_timestamp(F.col("d")), "yyyy-MM-dd"))
    assert got == [None, "2020-02-03", "2020-05-03", "2020-03-25", "2021-03-05", None, None]


def test_dashboard_table_drops_the_corrupt_month(spark):
    df = spark.createDataFrame([("a b", "2026-03-31 23:59:59"), ("c", "2026-04-01"), ("d", "2026-04-30 23:59:59"),
                                ("e  f g", "2026-05-01"), ("h", "x")], "review_text string, created_at_date string")
    rows = {r["review_text"]: r for r in cleaning.dashboard_table(df).collect()}
    assert set(rows) == {"a b", "e  f g"}
    assert rows["e  f g"]["word_count"] == 3 and rows["e  f g"]["text_length"] == 6
    assert rows["a b"]["year_month"] == "2026-03" and rows["a b"]["date"] == "2026-03-31"


def raw(spark, *rows):
    return spark.createDataFrame(rows, "review_text string, aspect string, sentiment string")


def test_clean_labels(spark):
    df = raw(spark, ("a", " Staff quality\t", "\nPositive "), ("b", "Irrelevant", "Positive"), ("c", "Facilities", "Mixed"),
             ("d", "Unknown", "Neutral"), ("e", None, "Neutral"), ("f", "Convenience", "Negative"))
    got = [(r["review_text"], r["aspect"], r["sentiment"]) for r in cleaning.clean_labels(df).orderBy("review_text").collect()]
    assert got == [("a", "Staff & Customer Service", "Positive"), ("f", "Convenience", "Negative")]


def test_cleaning_is_idempotent(spark):
    df = raw(spark, ("dirty seats", "Positive", "Positive"), ("zzz", "Irrelevant", "Negative"), ("x", "Safety", "Neutral"),
             ("y", "Other name", "Neutral"))
    once = cleaning.clean_reviews(df)
    assert sorted(once.collect()) == sorted(cleaning.clean_reviews(once).collect())
    assert {r["review_text"]: r["aspect"] for r in once.collect()} == {
        "dirty seats": "Crowding & Comfort", "x": "Safety & Security", "y": "Other name"}


def test_filters(spark):
    df = spark.createDataFrame(
        [("a", "x", "Positive", "2020-01-31 12:00:00", 0.9), ("b", "x", "Negative", "2020-01-31 00:00:00", None),
         ("c", "y", "Positive", "2020-02-01 00:00:00", 0.5)],
        "id string, aspect string, sentiment string, created_at_date string, sentiment_confidence double")
    df = df.withColumn("created_at_date", F.to_timestamp("created_at_date"))

    def ids(**kw):
        return [r["id"] for r in apply_filters(df, Filters(**kw)).orderBy("id").collect()]

    assert ids() == ["a", "b", "c"]
    assert ids(date_start="2020-01-01") == ["a", "b", "c"]  # both bounds are needed
    assert ids(date_start="2020-01-01", date_end="2020-01-31") == ["b"]
    assert ids(date_start="2020-01-01", date_end="2020-01-31", end_of_day=True) == ["a", "b"]
    assert ids(min_confidence=0.5) == ["a", "c"]
    assert ids(aspects=["x"], sentiments=["Positive"]) == ["a"]


def test_signed_text_and_cache_name(spark):
    df = spark.createDataFrame([(12.25,), (-51.25,), (0.0,)], "v double")
    assert column(df, ex.signed_percent(F.col("v"))) == ["+12.2", "-51.2", "+0.0"]
    names = spark.createDataFrame([("Staff & Service",), ("a/b c",)], "a string")
    assert column(names, ex.cache_name(F.col("a"))) == ["Staff_and_Service", "a_b_c"]
