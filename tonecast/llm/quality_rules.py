"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

The measures (lengths, symbols, stop words, repeated lines and windows) are column expressions over the text, the
rules are rows of a table that are turned into comparisons. There is no shuffle and no user function.

Edge cases: a null or empty text has no words and fails the base rule; a text of any length is measured whole; a measure
equal to a bound breaks no rule; repeated rows are judged row by row; an empty table gives no row; extra columns are kept, a column named like a
result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch, Polish, Swedish,
# Danish and Norwegian, Czech, Romanian, Turkish, Finnish, Hungarian, Indonesian
STOP_WORDS = sorted(set((
    "the of and to in is a that for on as by are was with it from this at or be an "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur "
    "el y los se del las por con no una su para es al lo como "
    "il di che per con non sono della del si " "os um uma não com da do em mais "
    "het een van dat niet op te zijn met voor " "nie na do że jest się jak ale od " "och att det som på av för inte har "
    "og at til ikke af som har " "je že ve na se jako ale byl " "și să cu nu mai din sunt este "
    "ve bir bu için ile çok olarak " "ja ei on että oli hän mutta " "az és hogy nem egy is volt "
    "yang dan untuk dengan tidak ini itu dari").split()))
#: as they are written inside and at the start of a sentence
STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within [low, high]; asked only of texts of ``min_words`` words or more."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 1


#: Ratios are per word, but dup_lines per line with a word.
DEFAULT_RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 16.0),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("stop_words", "stop_ratio", 0.06, None, 50),
    Rule("dup_lines", "dup_line_ratio", None, 0.5),
)


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` evaluates it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more in the text, from a column bound by ``_let``.

    Windows are compared by 64-bit hashes. Only texts with a repeated one sort theirs to find the words they cover.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                         lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def repeated(s):
        kept = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
                        | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(p):
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                           lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"),
                                                 x.alias("last")), lambda a: a["n"])

    def count(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(_let(pairs, repeated), covered))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, count))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_beyond_ascii, n_lines, n_dup_lines, n_stop_words, n_repeat_words (long) and the ratios.

    ``stop_ratio`` is null, and no rule on it broken, where most characters lie beyond ASCII: the lists hold no language
    of another script.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = F.struct(
        _let(words, lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).alias("n_stop_words"),
            F.length(F.concat_ws("", w)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct(
            F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[\x00-\x7F]+", "")).alias("n_beyond_ascii"))
    # the generator of one row keeps the optimiser from copying the expression into every use
    out = df.withColumn("_q", F.explode(F.array(counted)))
    out = out.withColumns({
        "n_words": F.col("_q.w.n_words").cast("long"), "word_chars": F.col("_q.w.word_chars").cast("long"),
        "n_symbols": F.col("_q.n_symbols").cast("long"), "n_beyond_ascii": F.col("_q.n_beyond_ascii").cast("long"),
        "n_lines": F.col("_q.l.n_lines").cast("long"),
        "n_dup_lines": F.col("_q.l.n_dup_lines").cast("long"), "n_stop_words": F.col("_q.w.n_stop_words").cast("long"),
        "n_repeat_words": F.col("_q.w.n_repeat_words").cast("long")}).drop("_q")
    return out.withColumns({
        "mean_word_length": _ratio("word_chars", "n_words"), "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_ratio": F.when(2 * F.col("n_beyond_ascii") <= F.col("word_chars"), _ratio("n_stop_words", "n_words")), "dup_line_ratio": _ratio("n_dup_lines", "n_lines")})


def _ratio(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")


def broken(rule: Rule) -> Column:
    """The rule as a boolean column: true where a text breaks it."""
    value, off = F.col(rule.measure), F.lit(False)
    if rule.low is not None:
        off = off | (value < rule.low)
    if rule.high is not None:
        off = off | (value > rule.high)
    return off & (F.col("n_words") >= rule.min_words)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Measures plus base_failed, broken_rules (names, comma-joined) and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    names = F.concat_ws(",", *(F.when(broken(r), F.lit(r.name)) for r in rules))
    return with_measures(df, text).withColumns({"base_failed": base, "broken_rules": names}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))
