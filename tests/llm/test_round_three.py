"""Fill-in-middle, conversation trie and SetSketch against plain versions; their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_edges import LONG, PLAIN, WORDS, docs, none  # noqa: F401
from tests.llm.test_queries import slow_groups
from tonecast.llm import cells, conversation_trie, fill_in_middle, setsketch
from tonecast.llm.shingles import Similarity


@pytest.mark.parametrize("bound", [0, 3, 1000, 40_000])
def test_rank_index_is_exact_and_bounded(bound):
    rng = np.random.default_rng(bound)
    for lines in (rng.integers(0, 200, 5000), np.full(3000, 80), np.zeros(10, int), rng.integers(0, 2, 40) * 30_000):
        offsets = np.concatenate(([0], np.cumsum(lines)))
        index = fill_in_middle.RankIndex(offsets, bound)
        rank = rng.permutation(len(offsets))
        assert (index.offset(rank) == offsets[rank]).all()
        assert abs(index.residual.astype(int)).max() <= bound + 1
    assert len(fill_in_middle.RankIndex(np.arange(10_000) * 80, 1000).first) == 1


def plain_fim(key, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text or ""
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(lines), "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), out


def test_fill_in_middle(spark, docs, none):  # noqa: F811
    assert fill_in_middle.transform(none).count() == 0
    more = [(k, t) for k, t in enumerate(["é\nü\r\n\nß", "\n", "\n\n\n", "a<P>b", "a<S", "x<\nS>\n<\nM>", "日本\n語", "<", LONG.replace(" ", "\n")])]
    given = docs.select("doc_id", "text", F.lit(1).alias("h1"), F.lit("f").alias("form")).union(
        spark.createDataFrame(more, "doc_id long, text string").select("*", F.lit(1), F.lit("g")))
    want = sorted(((r.doc_id, *plain_fim(r.doc_id, r.text)) for r in given.collect()), key=str)
    for bound in (0, 1000):
        made = fill_in_middle.transform(given, bound=bound)
        assert sorted((tuple(r) for r in made.collect()), key=str) == want
    texts = sorted((str(r.doc_id), r.text or "") for r in given.collect())
    again = made.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted((str(r.doc_id), r.text) for r in again.collect()) == texts
    assert {r.form for r in fill_in_middle.transform(given, rate=0).collect()} == {"plain"}


def plain_trie(rows):
    own = defaultdict(list)
    for cid, turn, role, text in rows:
        if cid is not None:
            code = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[cid].append((turn is not None, turn or 0, code, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    nodes = defaultdict(lambda: ([], []))
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(turns.get(c - c % 20, [])[:h] + x[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]][0].append(c)
        nodes[whole][1].append(c)
    out = []
    for path, (members, ends) in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        leaf = [p for p in below if not any(q[:-1] == p and q for q in nodes)]
        saved = sum((len(nodes[p][0]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        out.append((min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members),
                    sum(len(p) == len(path) + 1 for p in below), len(leaf), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, key string, words int, node string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _turns(seed, n, depth=5):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        hot = rng.random() < 0.3
        for t in range(int(rng.integers(0, depth + 1)) if not hot else 3):
            rows.append((c, t, ["user", "bot", None][int(rng.integers(0, 2)) if not hot else 0],
                         f"hot {t}" if hot else " ".join(rng.choice(["a", "bb", "c\td"], int(rng.integers(0, 3))))))
    return rows


@pytest.mark.parametrize("size, turns", [(4096, 1 << 16), (7, 1 << 16), (1, 1), (3, 8)])
def test_conversation_trie(spark, monkeypatch, size, turns):
    """Shards of any size give the nodes of the whole trie, hot turns and equal conversations included."""
    monkeypatch.setattr(conversation_trie, "CONVERSATIONS", size)
    monkeypatch.setattr(conversation_trie, "TURNS", turns)
    rows = _turns(size, 150) + [
        (None, 0, "user", "nobody"), (500, None, "user", "first"), (500, 0, None, None), (500, 0, None, None), (501, 1, "", ""),
        (502, 3, "x", "tie"), (502, 3, "x", "tie two"), (503, 0, "1", "1a"), (504, 0, "11", "a"), (505, 9, "user", LONG)]
    rows += [(600, k, "user", f"turn {k // 2}") for k in range(60)]
    df = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], TURNS).repartition(5)
    got = conversation_trie.build(df)
    assert got.columns == NAMES
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_conversation_trie_edges(spark, monkeypatch):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie.build(empty).count() == 0
    one = spark.createDataFrame([(7, 0, "user", "hi", "k", 1, "n")], TURNS)
    h = zlib.crc32(b"7") % 4
    assert conversation_trie.build(one).count() == (2 if h == 0 else 1)
    monkeypatch.setattr(conversation_trie, "_BROADCAST_ROWS", 0)
    rows = _turns(3, 60)
    df = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], TURNS)
    assert sorted((tuple(r) for r in conversation_trie.build(df).collect()), key=str) == plain_trie(rows)


def test_sketches_merge_and_agree_like_jaccard():
    rng = np.random.default_rng(2)
    whole = rng.integers(1, 1 << 63, 4000).astype(np.uint64)
    a, b = np.unique(whole[:3000]), np.unique(whole[1000:])
    one, two, both = setsketch.registers([a, b, np.unique(whole)], 2048)
    assert (setsketch.merged(one, two) == both).all()
    up, down, equal = ((one > two).sum(), (one < two).sum(), (one == two).sum())
    assert abs(equal / 2048 - 0.5) < 0.05
    best = setsketch.estimate(np.array([up]), np.array([down]), np.array([equal]), np.array([3000]), np.array([3000]))
    assert abs(best[0] - 0.5) < 0.04
    assert (setsketch.registers([np.zeros(0, np.uint64)])[0] == 0).all()


def test_likelihood_never_hides_a_link():
    sim, rng, sets = Similarity(3, 85, 100), np.random.default_rng(4), []
    for _ in range(40):
        base = rng.integers(1, 1 << 62, rng.integers(2, 400)).astype(np.uint64)
        for _ in range(4):
            sets.append(np.unique(np.concatenate((base[rng.random(len(base)) > 0.1 * rng.random()], base[:1]))))
    sets.sort(key=len)
    sketch = setsketch.registers(sets)
    test = setsketch.Sketches(np.array([len(s) for s in sets]), [x.tobytes() for x in sketch], sim)
    passed, n = 0, 0
    for i, a in enumerate(sets[:-1]):
        js = np.arange(i + 1, len(sets))
        ok = test(i, js)
        passed, n = passed + int(ok.sum()), n + len(js)
        for j in js:
            both = len(np.intersect1d(a, sets[j]))
            if sim.linked(len(a), len(sets[j]), both):
                assert ok[j - i - 1]
    assert passed < n / 10


@pytest.mark.parametrize("members", [4096, 9])
def test_near_duplicates(spark, monkeypatch, docs, none, members):  # noqa: F811
    monkeypatch.setattr(cells, "MEMBERS", members)
    assert setsketch.near_duplicates(none).count() == 0
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(90)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(100):
        w = list(base)
        for i in rng.choice(90, rng.integers(0, 5), replace=False):
            w[i] = f"v{k}_{i}" if rng.random() < 0.7 else f"u{i}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, " ".join(WORDS[:7 + k % 2])) for k in range(6)] + [(None, PLAIN.upper())]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, size int, mark string")
    for words, part in ((3, 85), (5, 80)):
        got = [(r.doc_id, r.size, r.component_id) for r in setsketch.near_duplicates(df, sim=Similarity(words, part, 100)).collect()]
        want = [(k, n, c if n else k) for k, n, c in slow_groups(rows, words, part, 100)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_chains_join_what_shares_a_key_over_tasks(spark):
    sim, rng = Similarity(3, 85, 100), np.random.default_rng(8)
    rows = [(int(k), int(n), u) for u, (k, n) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(1, 60, 400)))]
    edges = setsketch.chained(spark.createDataFrame(rows, "key long, size long, uid long"), sim).collect()
    root = list(range(400))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for e in edges:
        root[top(e.a)] = top(e.b)
    for k, n, u in rows:
        for k2, m, v in rows[:u]:
            if k == k2 and min(n, m) * 100 >= 85 * max(n, m):
                assert top(u) == top(v)
