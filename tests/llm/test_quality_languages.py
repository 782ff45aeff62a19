"""The stop-word rule on texts of listed languages, of other scripts and of none."""
from tonecast.llm import quality_rules

NOUNS = "kolor dom rzeka miasto pole okno stol lampa ogrod droga"
LISTED = {"pl": "nie jest do na", "nl": "het van niet op", "it": "della che non il", "tr": "bir ve bu ile", "sv": "och att det som"}


def _long(words, n=70):
    """Words in an order without repeated windows."""
    return " ".join(words[(i * i + i // 7) % len(words)] + ("" if i % 3 else f" {words[i % len(words)]}{i}") for i in range(n))


def _broken(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.broken_rules for r in quality_rules.judge(df).orderBy("doc_id").collect()]


def test_listed_languages_keep_their_texts(spark):
    texts = [_long((NOUNS + " " + words).split()) for words in LISTED.values()]
    assert _broken(spark, texts) == [""] * len(texts)


def test_other_scripts_are_not_asked(spark):
    scripts = ["дом река город поле окно лампа сад дорога и не на что", "घर नदी शहर मैदान खिड़की दीपक बाग सड़क और का", "집 강은 도시가 들판 창문을 등불 정원 길에서"]
    assert _broken(spark, [_long(x.split()) for x in scripts]) == [""] * 3


def test_texts_without_stop_words_are_rejected(spark):
    digits = " ".join(str(1000 + 37 * i) for i in range(80))
    short = " ".join(NOUNS.split()[:9])
    assert _broken(spark, [_long(NOUNS.split()), digits, short, None]) == ["stop_words", "stop_words", "", ""]
