"""Sample, learning and rejection of the language operator."""
import random

import pytest

from tonecast.llm import langid

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


def _text(lang, rng):
    return " ".join("".join(rng.choices(LETTERS[lang], k=5)) for _ in range(8))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    rows = [(_text(lang, rng), lang) for lang in ("aa", "bb") for _ in range(3000)]
    rows += [(_text("cc", rng), "cc") for _ in range(12)]
    rows += [(rows[0][0], "aa")] * 3000 + [(rows[-1][0], "cc")] * 3000 + [(None, "aa"), ("x", None)]
    return spark.createDataFrame(rows, "text string, lang string").repartition(6)


def test_rare_languages_and_copies(labelled):
    got = langid.sampled(labelled, sample=300, least=50).collect()
    count = {lang: sum(r["_label"] == lang for r in got) for lang in LETTERS}
    assert count["cc"] == 12 and all(70 <= count[x] <= 160 for x in ("aa", "bb"))
    assert len(got) == len({(r["_text"], r["_label"]) for r in got})
    assert sorted(got) == sorted(langid.sampled(labelled.repartition(3), sample=300, least=50).collect())


def test_rare_language_is_learned(spark, labelled):
    model = langid.train(labelled, sample=300, least=50)
    assert model.classes == ["aa", "bb", "cc"]
    rng = random.Random(8)
    rows = [(_text(lang, rng), lang) for lang in LETTERS for _ in range(30)]
    got = langid.predict(spark.createDataFrame(rows, "text string, lang string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 85
    assert all(r.accepted == (r.score >= model.accept) for r in got) and any(r.accepted for r in got)


def test_unlike_text_is_less_sure(spark, labelled):
    model = langid.train(labelled, sample=300, least=50)
    texts = [("abcde abced edcba",), ("zzzz wwww vvvv yyyy",), ("123 456",), (None,)]
    clear, unlike, digits, null = langid.predict(spark.createDataFrame(texts, "text string").coalesce(1), model).collect()
    assert clear.score > unlike.score and not digits.accepted and not null.accepted
    assert (digits.lang_pred, digits.score, null.lang_pred, null.score) == ("und", 0.0, "und", 0.0)


def test_more_languages_than_parts(spark):
    rows = [(f"{chr(97 + k)}{chr(98 + k)} " * 4 + str(j), f"l{k}") for k in range(20) for j in range(5)]
    got = langid.sampled(spark.createDataFrame(rows, "text string, lang string"), sample=10, least=3).collect()
    assert {r["_label"] for r in got} <= {f"l{k}" for k in range(20)} and len(got) < 100
