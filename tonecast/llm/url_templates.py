"""URL verdicts by host rules and, where none fits, by a path-template tree of each host.

Urls that a rule judges are the labels. The tree of a host is grown level by level on counts of distinct paths:
segments that are numbers or ids become ``{n}`` or ``{id}``, a place with many different segments becomes ``*``, and
branches whose labelled shares do not differ significantly are merged. A branch is grown as deep as its paths go, unless
all below it is labelled or it has too few labels to reject anything. A template is rejected when it has enough labels
and its share of blocked ones, smoothed towards its parent's and a prior, is high; all else is allowed. Everything is
built-in functions; counts are aggregated before they are shuffled, and each level is a written table.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; repeated rows
are judged alike; of rules of the same length the first is taken; urls are read whole; an empty table gives no row;
extra columns pass through, but columns named ``host``, ``path``, ``rule`` or ``verdict`` are replaced and those named
``_host``, ``_segments`` or ``_bad`` dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonecast.session import materialize

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = ["_host", "_segments"]


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the url's path starts with ``path``."""
    allow: bool
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    many: int = 8  # at so many different segments, more than ``share`` of the distinct paths there, a place is a wildcard
    share: float = 0.5
    z: float = 1.96  # branches whose shares differ less are merged
    support: int = 5  # labels that a branch needs to be merged or rejected
    prior: float = 0.1  # blocked share expected without labels
    weight: float = 4.0  # labels that the expectation counts for
    reject: float = 0.8


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path, both empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.translate(host, _UP, _LOW), "path": path})


def rule_of(rules: list[Rule]) -> Column:
    """The longest fitting rule's text, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: len(r.text), reverse=True):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        out = F.when(fits, F.lit(rule.text)) if out is None else out.when(fits, F.lit(rule.text))
    return out if out is not None else F.lit(None).cast("string")


def _segments() -> Column:
    """Generalised segments of a whole path."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.regexp_replace(s, "^[0-9]+", "{n}"))
                        .when(s.rlike(r"^(?=.*[0-9])[0-9A-Za-z_-]{8,}$"), F.lit("{id}")).otherwise(s))


def _smoothed(blocked: Column, labelled: Column, expected: Column, s: Settings) -> Column:
    return (blocked + s.weight * expected) / (labelled + s.weight)


def _merged_names(children: DataFrame, place: list[str], s: Settings) -> DataFrame:
    """A common name for siblings with labels whose blocked shares, in order, do not differ significantly."""
    order = Window.partitionBy(*place).orderBy("p", "segment")
    before = {c: F.lag(c).over(order) for c in ("p", "labelled")}
    rated = children.where(F.col("labelled") >= s.support).withColumn("p", F.col("blocked") / F.col("labelled"))
    near = rated.withColumns({"p0": before["p"], "n0": before["labelled"]})
    pooled = (F.col("p") * F.col("labelled") + F.col("p0") * F.col("n0")) / (F.col("labelled") + F.col("n0"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("n0")))
    apart = F.col("p0").isNull() | (F.col("p") - F.col("p0") > s.z * error)
    grouped = near.withColumn("apart", apart.cast("int")).withColumn(
        "branch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*place, "branch")
    name = F.when(F.count("*").over(whole) > 1, F.concat(F.lit("~"), F.min("segment").over(whole))).otherwise(F.col("segment"))
    return grouped.select(*place, "segment", name.alias("name"))


def templates(paths: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Template, labels (support) and smoothed purity of each distinct (_host, _segments) with rows, labelled, blocked.

    A branch is grown only while something below it is open: it needs ``support`` labels, which no branch below it
    exceeds, and rows without a label. What it leaves ungrown keeps the branch's template. Paths that end at a branch
    are judged by its purity and their own labels.
    """
    place, counts = ["_host", "template"], ["rows", "labelled", "blocked"]
    kept = [*_KEYS, "template", "purity", "rows", "labelled"]
    tree = paths.select(*_KEYS, *counts, F.lit("").alias("template"))
    sums = tree.groupBy(*place).agg(*(F.sum(c).alias("_" + c) for c in counts))
    purity = _smoothed(F.col("_blocked"), F.col("_labelled"), F.lit(s.prior), s)
    tree = materialize(tree.join(sums.withColumn("purity", purity), place), "tree")
    is_open = (F.col("_labelled") >= s.support) & (F.col("_labelled") < F.col("_rows"))
    done, level = [], 0
    while True:
        done.append(tree.where(~is_open).select(*kept, F.col("_labelled").alias("support")))
        growing = tree.where(is_open).drop(*("_" + c for c in counts)).withColumn(
            "segment", F.coalesce(F.get("_segments", F.lit(level)), F.lit("")))
        children = materialize(growing.groupBy(*place, "segment").agg(
            F.count("*").alias("paths"), *(F.sum(c).alias(c) for c in counts)), "children")
        if children.isEmpty():
            break
        ends = children.where("segment = ''").select(*place, F.col("labelled").alias("support"))
        done.append(growing.where("segment = ''").join(ends, place).select(*kept, "support"))
        inner = children.where("segment <> ''")
        width = inner.groupBy(*place).agg(F.count("*").alias("kinds"), F.sum("paths").alias("at"))
        wild = width.where((F.col("kinds") >= s.many) & (F.col("kinds") > s.share * F.col("at"))).select(
            *place, F.lit("*").alias("wild"))
        named = inner.join(wild, place, "left")
        merged = _merged_names(named.where("wild IS NULL"), place, s)
        named = materialize(named.join(merged, [*place, "segment"], "left").withColumn(
            "name", F.coalesce("wild", "name", "segment")), "named")
        both = named.groupBy(*place, "name").agg(*(F.sum(c).alias("_" + c) for c in counts))
        names = named.select(*place, "segment", "name").join(both, [*place, "name"])
        tree = materialize(growing.join(names, [*place, "segment"]).select(
            *_KEYS, *counts, *("_" + c for c in counts), F.concat_ws("/", "template", "name").alias("template"),
            _smoothed(F.col("_blocked"), F.col("_labelled"), F.col("purity"), s).alias("purity")), "tree")
        level += 1
    return reduce(DataFrame.unionByName, done)


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", settings: Settings = Settings()) -> DataFrame:
    """Add host, path, rule and verdict (allow or block: the rule's, else the template's)."""
    allows = [r.text for r in rules if r.allow]
    cut = with_parts(urls.drop("host", "path", "rule", "verdict", "_bad"), url).withColumn("rule", rule_of(rules))
    cut = cut.withColumns({"_host": F.col("host"), "_segments": _segments()})
    labelled = F.col("rule").isNotNull()
    blocked = labelled & ~F.col("rule").isin(allows)
    paths = cut.groupBy(*_KEYS).agg(F.count("*").alias("rows"), F.sum(labelled.cast("long")).alias("labelled"),
                                    F.sum(blocked.cast("long")).alias("blocked"))
    bad = templates(paths, settings).where((F.col("support") >= settings.support) & (F.col("purity") >= settings.reject)
                                           ).where("labelled < rows").select(*_KEYS, F.lit(True).alias("_bad"))
    out = cut.join(bad, _KEYS, "left")
    verdict = F.when(labelled, F.when(F.col("rule").isin(allows), "allow").otherwise("block")).otherwise(
        F.when(F.col("_bad"), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop(*_KEYS, "_bad")
