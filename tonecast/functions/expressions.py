"""Column expressions shared by the operators. All of them stay in the JVM, but for ``first_rule``."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# formats tried after the ISO forms; month-first wins where both could apply
DATE_FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy"]


def nss(pos: Column, neg: Column, rows: Column) -> Column:
    """Net sentiment score in percent, 0 where there are no rows (ANSI-safe)."""
    return F.coalesce((pos - neg) / F.nullif(rows, F.lit(0)) * 100, F.lit(0.0))


def share(part: Column, rows: Column) -> Column:
    """``part`` in percent of ``rows``, with a denominator of at least 1."""
    return part / F.greatest(rows, F.lit(1)) * 100


def is_label(sentiment: Column, label: str) -> Column:
    return F.count_if(sentiment == label)


def equal(a: Column, b: Column) -> Column:
    """Equality that is false, not null, when a side is missing."""
    return F.coalesce(a == b, F.lit(False))


def differs(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """Lower text with every white-space run collapsed to one blank; null becomes empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def text_id(text: Column) -> Column:
    """16 hex digits of SHA-256 over the normalised text: copies share one id."""
    return F.substring(F.sha2(squash(text), 256), 1, 16)


def seeded_hash(seed: int, key: Column) -> Column:
    """Reproducible pseudo-random order for samples and folds (hex text)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def lenient_timestamp(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """Parse mixed date texts; what no format accepts becomes null instead of failing."""
    text = c.cast("string")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def in_months(ts: Column, months: list[tuple[int, int]]) -> Column:
    """True when ``ts`` lies in one of the calendar months, as half-open ranges that reach the scan."""
    def span(year: int, month: int) -> Column:
        after = (year + 1, 1) if month == 12 else (year, month + 1)
        return (ts >= F.lit(f"{year:04d}-{month:02d}-01").cast("timestamp")) & (
            ts < F.lit(f"{after[0]:04d}-{after[1]:02d}-01").cast("timestamp"))
    return reduce(lambda a, b: a | b, [span(y, m) for y, m in months], F.lit(False))


def word_count(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), r"(?U)\s+")
    return F.size(F.filter(words, lambda w: w != ""))


def model_input(aspect: Column, text: Column) -> Column:
    return F.concat(F.lit("Aspect: "), aspect, F.lit("\nReview: "), F.coalesce(text, F.lit("")))


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def _found(lowered: Column, pattern: str) -> Column:
    """``lowered`` matches an alternation of keywords.

    Plain keywords become substring searches, several times faster than a regex that tries every
    alternative at every position; a keyword that contains another one adds nothing. Only
    alternatives with regex syntax are left to ``rlike``.
    """
    if re.search(r"[()\[\]\\]", pattern):
        return lowered.rlike(pattern)
    parts = pattern.split("|")
    plain = [p for p in parts if re.fullmatch(r"[\w ]+", p)]
    tests = [lowered.contains(p) for p in plain if not any(o != p and o in p for o in plain)]
    special = [p for p in parts if p not in plain]
    if special:
        tests.append(lowered.rlike("|".join(special)))
    return reduce(lambda a, b: a | b, tests)


def first_rule_plain(text: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    """``first_rule`` without Python, for plans that run none. It searches the text once per keyword."""
    (name, pattern), *rest = rules

    def named(lowered: Column) -> Column:
        chain = F.when(_found(lowered, pattern), name)
        for other, words in rest:
            chain = chain.when(_found(lowered, words), other)
        return chain.otherwise(fallback)

    # the lambda holds the lowered text, which would otherwise be made anew for every keyword
    return F.transform(F.array(_lowered(text)), named)[0]


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def first_rule(text: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    """Name of the first keyword rule found in the text, else ``fallback``, on Arrow batches.

    Alternations of plain keywords and optional characters are matched by an automaton, in one pass over the text for all
    keywords of a rule; rules with other regex syntax are left to ``first_rule_plain``.
    """
    if all(re.fullmatch(r"(?:[\w |]|\.\?)+", pattern, re.ASCII) for _, pattern in rules):
        return _first_keyword(rules, fallback)(_lowered(text))
    return first_rule_plain(text, rules, fallback)


def _first_keyword(rules: list[tuple[str, str]], fallback: str):
    # a dot stands for any character but the line ends of Java's patterns
    patterns = [(name, words.replace(".", "[^\\n\\r\\x{85}\\x{2028}\\x{2029}]")) for name, words in rules]

    @F.arrow_udf("string")
    def first(texts: pa.Array) -> pa.Array:
        names, left = np.full(len(texts), fallback, dtype=object), np.arange(len(texts))
        for name, pattern in patterns:
            hit = pc.match_substring_regex(texts, pattern)
            found = hit.to_numpy(zero_copy_only=False).astype(bool)
            names[left[found]] = name
            texts, left = texts.filter(pc.invert(hit)), left[~found]
        return pa.array(names, pa.string())
    return first


def known_aspect(question: Column, named: dict[str, tuple[str, ...]]) -> Column:
    """First aspect one of whose words the question holds, else null."""
    lowered = F.lower(question)
    held = {aspect: reduce(Column.__or__, [lowered.contains(w) for w in words]) for aspect, words in named.items()}
    return F.coalesce(*(F.when(test, aspect) for aspect, test in held.items()))


def nss_band(value: Column) -> Column:
    return F.when(value < 0, "critical").when(value < 30, "warning").otherwise("good")


def negative_band(pct: Column) -> Column:
    return F.when(pct > 30, "critical").when(pct > 15, "warning").otherwise("good")


def gauge(value: Column) -> Column:
    """Position of an NSS between -100 and 100 on a 0..1 scale."""
    return F.least(F.greatest((value + 100) / 200, F.lit(0.0)), F.lit(1.0))


def signed_percent(value: Column, digits: int = 1) -> Column:
    """Text such as ``+12.3``; halves go to the even digit."""
    return F.format_string(f"%+.{digits}f", F.bround(value, digits))


def cache_name(aspect: Column) -> Column:
    """File-system safe name of an aspect."""
    return F.replace(F.translate(aspect, "/ ", "__"), F.lit("&"), F.lit("and"))
