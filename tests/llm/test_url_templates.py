"""Template tree against a plain version in Python, on labelled hosts."""
import random
import re
from collections import defaultdict

import pytest

from tonecast.llm import url_templates as ut

RULES = [ut.Rule(False, "bad.org", "/spam/a"), ut.Rule(True, "bad.org", "/ham/x"), ut.Rule(False, "bad.org", "/u/9"),
         ut.Rule(False, "mix.net", "/p/q/r/s/t/b"), ut.Rule(True, "mix.net", "/p/q/r/s/t/g"), ut.Rule(False, "net", "/x")]


def slow(urls, rules, s):
    """Verdict of every (host, path) by one recursion over the lists of its branch."""
    table = []
    for host, path in urls:
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        parts = []
        for x in filter(None, path.split("/")):
            if re.fullmatch(r"[0-9]+(\.[A-Za-z]+)?", x):
                x = re.sub("^[0-9]+", "{n}", x)
            elif re.fullmatch(r"(?=.*[0-9])[0-9A-Za-z_-]{8,}", x):
                x = "{id}"
            parts.append(x)
        table.append((host, tuple(parts), rule))
    verdict = {}

    def smooth(rows, expected):
        labels = [r for r in rows if r[2]]
        return (sum(not r[2].allow for r in labels) + s.weight * expected) / (len(labels) + s.weight)

    def grow(rows, level, purity):
        ends = [r for r in rows if len(r[1]) == level]
        for r in ends:
            bad = sum(x[2] is not None for x in ends) >= s.support and purity >= s.reject
            verdict[r[:2]] = "block" if bad else "allow"
        groups = defaultdict(list)
        for r in rows:
            if len(r[1]) > level:
                groups[r[1][level]].append(r)
        distinct = len({r[1] for g in groups.values() for r in g})
        if len(groups) >= s.many and len(groups) > s.share * distinct:
            branches = [[r for g in groups.values() for r in g]]
        else:
            rated = []
            for segment, g in groups.items():
                n = sum(x[2] is not None for x in g)
                if n >= s.support:
                    rated.append((sum(x[2] is not None and not x[2].allow for x in g) / n, segment, n))
            rated.sort()
            chains = []
            for i, (p, segment, n) in enumerate(rated):
                if i:
                    p0, _, n0 = rated[i - 1]
                    pooled = (p * n + p0 * n0) / (n + n0)
                    apart = p - p0 > s.z * (pooled * (1 - pooled) * (1 / n + 1 / n0)) ** 0.5
                if not i or apart:
                    chains.append([])
                chains[-1].append(segment)
            single = [[x] for x in groups if x not in {y for c in chains for y in c}]
            branches = [[r for x in c for r in groups[x]] for c in chains + single]
        for b in branches:
            grow(b, level + 1, smooth(b, purity))
    hosts = defaultdict(list)
    for r in table:
        hosts[r[0]].append(r)
    for rows in hosts.values():
        grow(rows, 0, smooth(rows, s.prior))
    return [("allow" if r[2].allow else "block") if r[2] else verdict[r[:2]] for r in table]


def _urls(rng):
    out = [("bad.org", f"/spam/a{k}") for k in range(40)] + [("bad.org", f"/spam/b{k}") for k in range(4)]
    out += [("bad.org", f"/ham/{x}{k}/end") for x in "xy" for k in range(12)] + [("bad.org", "/ham")] * 3
    # under the same generalised segments below six fixed ones
    out += [("mix.net", f"/p/q/r/s/t/b{k}{'/more' * (k % 3)}") for k in range(30)]
    out += [("mix.net", f"/p/q/r/s/t/c{k}{'/more' * (k % 3)}") for k in range(9)]
    out += [("mix.net", f"/p/q/r/s/t/g{k}") for k in range(3)]
    out += [("bad.org", f"/u/{k}") for k in range(900, 960)] + [("bad.org", f"/u/{k}") for k in range(100, 108)]
    out += [("a.net", f"//x/{'/'.join(rng.choices('abc', k=rng.randrange(1, 6)))}") for _ in range(60)]
    out += [("a.net", f"/x/{'/'.join(rng.choices('abc', k=rng.randrange(1, 6)))}") for _ in range(60)]
    out += [("clean.com", f"/{'/'.join(rng.choices('de', k=4))}") for _ in range(30)] + [("clean.com", "")]
    return out


@pytest.mark.parametrize("settings", [ut.Settings(), ut.Settings(support=3, reject=0.6, many=4, z=0.5)])
def test_tree_by_brute_force(spark, settings):
    urls = _urls(random.Random(4))
    df = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in ut.judge(df, RULES, settings=settings).collect()}
    want = slow(urls, RULES, settings)
    assert [got[k] for k in range(len(urls))] == want
    free = [v for (h, p), v in zip(urls, want) if (h, p[:6]) in (("mix.net", "/p/q/r"),) and "/c" in p]
    assert "block" in free  # rejected below the fourth segment


def test_copies_do_not_hide_a_wildcard(spark):
    urls = [("bad.org", f"/spam/a{k}") for k in range(20)] + [("bad.org", f"/spam/b{k}") for k in range(3)]
    urls += [("bad.org", "/spam/a0")] * 500
    df = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(urls)], "page_id long, url string")
    assert all(r.verdict == "block" for r in ut.judge(df, RULES).collect())


def test_clashing_names_and_labels_only(spark):
    schema = "page_id long, url string, _host string, _bad int, template string, segment string, rows int, verdict string"
    df = spark.createDataFrame([(k, f"http://bad.org/spam/a{k}", "h", 1, "t", "s", 1, "v") for k in range(9)], schema)
    got = ut.judge(df, RULES).collect()
    assert len(got) == 9 and all(r.verdict == "block" and r.template == "t" and r.rows == 1 for r in got)
