"""Tokenising and n-grams as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonecast import taxonomy as tx

# runs of a-z of at least three letters that are not part of a longer Unicode word
_PLAIN_WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}+(?![\p{L}\p{N}_])"
_ANY_WORD = r"[\p{L}\p{N}_]{2,}+"
_URL = r"(?U)https?://\S+|www\.\S+"

# stop words and URL handling per consumer
VARIANTS = {
    "plain": (tx.BASE_STOP_WORDS, False),
    "context": (tx.BASE_STOP_WORDS + tx.DOMAIN_STOP_WORDS, False),
    "business": (tx.BASE_STOP_WORDS + tx.DOMAIN_STOP_WORDS + tx.URL_STOP_WORDS + tx.FILLER_STOP_WORDS, True),
    "voice": (tx.BASE_STOP_WORDS + tx.DOMAIN_STOP_WORDS + tx.URL_STOP_WORDS + tx.PAGE_STOP_WORDS
              + tx.FILLER_STOP_WORDS, True),
}


def words(text: Column, variant: str = "plain") -> Column:
    """Content words in text order. Null text has none."""
    stop, drop_urls = VARIANTS[variant]
    stop = [w for w in stop if len(w) > 2]
    source = F.coalesce(text, F.lit(""))
    if drop_urls:
        # the regex pass is only paid by texts that hold the start of a URL
        linked = source.contains("http") | source.contains("www.")
        source = F.when(linked, F.regexp_replace(source, _URL, " ")).otherwise(source)
    found = F.regexp_extract_all(F.lower(source), F.lit(_PLAIN_WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop))


def terms(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores: the classifier's unigrams."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_ANY_WORD), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Blank-joined runs of ``n`` tokens; empty when there are fewer.

    ``tokens`` should be a column of an earlier projection: it is referenced once per order.
    """
    runs = tokens
    for shift in range(2, n + 1):
        pairs = F.zip_with(runs, F.slice(tokens, F.lit(shift), F.greatest(F.size(tokens), F.lit(0))),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        runs = F.filter(pairs, lambda p: p.isNotNull())
    return runs
