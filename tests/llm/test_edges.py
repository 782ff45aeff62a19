"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_queries import slow_groups
from tonecast.llm import (cells, decontaminate, jaccard_join, langid, licenses, packing, pii_crf, quality_rules, suffix_dedup,
                          url_templates, warc)
from tonecast.llm.queries import tokenizer_file

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
LONG = " ".join(WORDS[i * i % len(WORDS)] + WORDS[i * 7 % 149] for i in range(30_000))
PLAIN = " ".join(WORDS[:60])
SCHEMA = ("doc_id long, text string, lang string, n_words string, pii_spans int, licenses int, component_id string, "
          "word_spans string, score string, task string, uid string")
CLASH = ("x", 1, 2, "c", "s", "3", "t", "u")


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, PLAIN), (1, PLAIN), (2, None), (3, ""), (None, PLAIN), (4, LONG), (5, LONG + " end"), (6, "  \n\t "),
             (7, "one"), (8, "one"), (9, "One two"), (3, PLAIN + " tail")]
    return spark.createDataFrame([(k, t, "en", *CLASH) for k, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    assert quality_rules.judge(none).count() == 0
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == 12
    for r in rows:
        assert r.n_words == len((r.text or "").split())
        if not r.text or r.n_words < 10:
            assert r.base_failed and not r.kept


def test_quality_repeated_words(spark):
    texts = ["a b c d e f a b c d e", "a b c d e a b c d e a", "x x x x x x x", "a b c d e", "q a b c d e z a b c d e y"]
    rows = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [10, 11, 7, 0, 10]


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(WORDS[10:30])), (2, "one"), (3, None), (4, "!"), (None, PLAIN), (5, "one")],
                                  "item_id long, text string")
    assert decontaminate.contaminated(none, bench).count() == 0
    assert not any(r.n_hit for r in decontaminate.contaminated(docs, bench.where("false")).collect())
    for limit in (1 << 20, 50):  # one block and several
        rows = decontaminate.contaminated(docs, bench, block_chars=limit).collect()
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.hit_items), r.contaminated) for r in rows)
        assert [x for x in got if x[0] == "1"] == [("1", 60, 60, (1,), True)] * 2
        # the words of the item without an id are hit, but the item is not named
        assert [x for x in got if x[0] == "None"] == [("None", 60, 60, (1,), True)]
        assert ("7", 1, 1, (2, 5), True) in got and ("9", 2, 1, (2, 5), True) in got and ("6", 0, 0, (), False) in got
        assert ("2", 0, 0, (), False) in got and len(got) == 12


def test_fm_index_counts_and_places():
    from tonecast.llm.fmindex import FMIndex
    rng = np.random.default_rng(3)
    for n, top in ((1, 3), (40, 2), (700, 5)):
        text = np.append(rng.integers(0, top + 1, n), 0)
        index = FMIndex(text, top)
        for size in (1, 2, 5):
            patterns = rng.integers(1, top + 1, (30, size))
            low, high = index.find(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(len(text) - size + 1) if (text[i:i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_licenses(spark, docs, none):
    assert licenses.scan(none).count() == 0
    assert all(r.licenses == [] for r in licenses.scan(docs).collect())
    text = "Some words.\nReleased under the MIT License.\n\nPermission is hereby granted,\n" + licenses.TEMPLATES["MIT"][2][30:]
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.name, text[x.start:x.start + 8]) for x in r.licenses][0] == ("MIT", "Released")
    assert any(x.name == "MIT" and x.start > 40 for x in r.licenses)


def test_personal_data(docs, none):
    assert pii_crf.find(none, with_masked=True).count() == 0
    rows = pii_crf.find(docs, with_masked=True).collect()
    assert len(rows) == 12 and all(r.pii_spans == [] and r.masked == r.text for r in rows)


def test_field_spreads_labels_to_similar_words():
    texts = [f"write to user{i}@mail{i % 7}.example.com today or call +1 ({200 + i}) 555-{1000 + i} item {i} of {i * 3}" for i in range(300)]
    graph = pii_crf.build_graph(texts, [pii_crf.base_spans(t) for t in texts])
    model = pii_crf.fit(graph)
    text = "ask ann@corp.example.org first and later ann@corp again"
    spans = pii_crf.find_spans([text], model, 0.9)[0]
    assert [(k, text[a:b]) for k, a, b, _ in spans] == [("email", "ann@corp.example.org"), ("email", "ann@corp")]
    alone = pii_crf.marginals(model, pii_crf.build_graph(["later ann@corp again"], [[]]))
    tied = pii_crf.marginals(model, pii_crf.build_graph([text], [pii_crf.base_spans(text)]))
    assert tied[1, 1] >= alone[0, 1]


def test_a_label_reaches_every_repeat():
    """One match and fifty equal words: all get its label, whatever their number, with fitted weights and the prior's alone."""
    texts = [f"write to user{i}@mail{i % 7}.example.com today or call +1 ({200 + i}) 555-{1000 + i} item {i} of {i * 3}" for i in range(300)]
    fitted = pii_crf.fit(pii_crf.build_graph(texts, [pii_crf.base_spans(t) for t in texts]))
    flat = pii_crf.Model(np.zeros((pii_crf.DIM, 5)), np.zeros((5, 5)), pii_crf.AGREE * np.eye(5))
    for model in (fitted, flat):
        for n in (1, 50, 400):
            text = "ask ann@corp.example.org first" + " and later ann@corp again" * n
            spans = pii_crf.find_spans([text], model, 0.9)[0]
            assert [(k, text[a:b]) for k, a, b, _ in spans] == [("email", "ann@corp.example.org")] + [("email", "ann@corp")] * n


def test_messages_come_to_rest():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{rng.integers(0, 9)}@{rng.integers(0, 5)}" for _ in range(300))
    graph = pii_crf.build_graph([text], [[]])
    model = pii_crf.Model(rng.normal(0, 3, (pii_crf.DIM, 5)), rng.normal(0, 3, (5, 5)), rng.normal(0, 3, (5, 5)))
    model.chain, model.skip = model.chain + model.chain.T, model.skip + model.skip.T
    chance = pii_crf.marginals(model, graph)
    assert np.isfinite(chance).all() and np.allclose(chance.sum(axis=1), 1)


def test_long_numbers():
    text = "a " + "0" * 4400 + "1.1.1.1 b " + "9" * 5000 + ".1.1.1"
    assert pii_crf.base_spans(text) == [("ip", 2, 4409)]


def test_masks_overlaps():
    assert pii_crf.masked("ab cd ef", [("ip", 3, 5, True), ("card", 4, 7, True)]) == "ab [IP]f"


def test_suffixes(docs, none):
    assert suffix_dedup.repeated_passages(none).count() == 0
    rows = {(r.doc_id, r.n_words): (r.n_copies, [tuple(s) for s in r.spans]) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert rows == {(1, 60): (3, [(0, 60)]), (None, 60): (3, [(0, 60)]), (3, 61): (1, [(0, 60)]),
                    (4, 30_000): (1, [(0, 30_000)]), (5, 30_001): (1, [(0, 30_000)])}


def test_suffixes_of_rows_without_ids(spark):
    """Rows that share an id or have none are not paired with each other."""
    rng = np.random.default_rng(12)
    shared = " ".join(rng.choice(WORDS, 60))
    texts = [" ".join([*rng.choice(WORDS, 79), f"u{k}", *([shared] if k % 3 == 0 else [])]) for k in range(900)]
    rows = [(None if k % 2 else 5, t) for k, t in enumerate(texts)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 300 and all([tuple(s) for s in r.spans] == [(80, 140)] for r in got)


def test_suffixes_against_all_windows(spark):
    rng = np.random.default_rng(11)
    shared = [" ".join(rng.choice(WORDS, n)) for n in (49, 50, 51, 80)]
    texts = [" ".join([*rng.choice(WORDS, rng.integers(0, 40)), shared[k % 4], *rng.choice(WORDS, rng.integers(0, 40))]) for k in range(40)]
    seen = {}
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i:i + 50]), set()).add(k)
    want = {}
    for k, t in enumerate(texts):
        w = t.split()
        covered = sorted({j for i in range(len(w) - 49) if len(seen[tuple(w[i:i + 50])]) > 1 for j in range(i, i + 50)})
        if covered:
            want[k] = covered
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [j for s in r.spans for j in range(s.start, s.end)] for r in suffix_dedup.repeated_passages(df).collect()}
    assert got == want


PAGES = "page_id long, url string, html string, host string, sha string, rule string"


def _pages(spark):
    return spark.createDataFrame([
        (1, "http://A.example.com/x?q#f", "same", "h", "s", "r"), (2, "http://b.example.com", "same", "h", "s", "r"),
        (2, "http://b.example.com", "same", "h", "s", "r"), (3, None, None, "h", "s", "r"), (4, "no scheme", "", "h", "s", "r"),
        (5, "ftp://c.net/a\r\nb", "é" * 200_000, "h", "s", "r"), (None, "http://d.org/", "same", "h", "s", "r")], PAGES)


def test_warc(spark):
    pages = _pages(spark)
    assert warc.round_trip(spark, pages.where("false")).count() == 0
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect())
    assert got == sorted([("1", 4, "revisit", 2), ("2", 4, "response", None), ("2", 4, "response", None),
                          ("3", 0, "revisit", 4), ("4", 0, "response", None), ("5", 400_000, "response", None),
                          ("None", 4, "revisit", 2)])
    few = warc.round_trip(spark, pages, least_revisit=1).collect()
    assert {r.record_type for r in few if r.payload_bytes == 0} == {"response"}


def test_url_templates(spark):
    rules = [url_templates.Rule(False, "net"), url_templates.Rule(False, "bad.org", "/spam/a")]
    pages = _pages(spark)
    assert url_templates.judge(pages.where("false"), rules).count() == 0
    got = {str(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(pages, rules).collect()}
    assert got["1"] == ("a.example.com", "/x", None, "allow") and got["3"] == ("", "", None, "allow")
    assert got["5"][2:] == ("net/", "block") and got["4"] == ("", "", None, "allow")
    # labelled siblings make a template that rejects what no rule names, and leaves other branches alone
    more = [(k, f"http://bad.org/spam/a{k}", "", "", "", "") for k in range(40)]
    more += [(100 + k, f"http://bad.org/spam/b{k}", "", "", "", "") for k in range(3)]
    more += [(200 + k, f"http://bad.org/ham/{k}", "", "", "", "") for k in range(20)]
    verdict = {r.page_id: r.verdict for r in url_templates.judge(spark.createDataFrame(more, PAGES), rules).collect()}
    assert all(verdict[100 + k] == "block" for k in range(3)) and all(verdict[200 + k] == "allow" for k in range(20))


def test_jaccard_edges(docs, none):
    assert jaccard_join.linked_groups(none).count() == 0
    got = [(r.doc_id, r.size, r.component_id) for r in jaccard_join.linked_groups(docs).collect()]
    want = [(k, n, c if n else k) for k, n, c in slow_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_jaccard_near_copies_in_long_lists(spark, monkeypatch):
    """A group of near copies around the threshold, with lists cut into small blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(cells, "MEMBERS", 16)
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(90)]
    rows = []
    for k in range(120):
        w = list(base)
        for i in rng.choice(90, rng.integers(0, 5), replace=False):
            w[i] = f"v{k}_{i}" if rng.random() < 0.7 else f"u{i}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, part in ((3, 90), (5, 80)):
        got = sorted(((r.doc_id, r.size, r.component_id) for r in jaccard_join.linked_groups(
            df, sim=jaccard_join.Similarity(words, part, 100)).collect()), key=str)
        assert got == slow_groups(rows, words, part, 100)


def test_bitmap_never_hides_a_link():
    sim, rng = jaccard_join.Similarity(3, 90, 100), np.random.default_rng(9)
    base = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(400) > rng.random() * 0.2], rng.integers(1, 1 << 62, rng.integers(0, 40)).astype(np.uint64)))) for _ in range(60)]
    sets.sort(key=len)
    test = jaccard_join.Bitmaps(np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets], sim)
    passed = {(i, i + 1 + int(j)) for i in range(59) for j in np.flatnonzero(test(i, np.arange(i + 1, 60)))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert (j, i) in passed


def test_language(docs, none):
    assert langid.predict(none, langid.train(none)).count() == 0
    rows = langid.predict(docs, langid.train(docs)).collect()
    assert len(rows) == 12
    assert all((r.lang_pred == "und") == (not (r.text or "").strip()) and 0 <= r.score <= 1 for r in rows)


def test_packing_edges(docs, none):
    assert packing.pack(none, tokenizer_file()).count() == 0
    rows = packing.pack(docs, tokenizer_file(), with_ids=True).collect()
    assert sum(1 for r in rows if r.piece == 0) == 12 and max(r.length for r in rows) == 2048
    assert sorted(r.length for r in rows if r.doc_id == 2) == [1]
    assert all(len(r.ids) == r.length for r in rows)
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, a, n), (t, b, _) in zip(spans, spans[1:]):
        assert b == (a + n if s == t else 0)


def test_plan_uses_exact_complements():
    counts = {1000: 5, 600: 5, 448: 5, 2048: 3, 1024: 4}
    patterns = packing.plan(counts)
    assert sum(n for _, n in patterns) == -(-sum(k * v for k, v in counts.items()) // 2048)


def _fewest(lengths, capacity):
    """The least number of sequences, by trying all ways to place one length after another."""
    best = len(lengths)

    def place(rest, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if not rest:
            best = len(gaps)
            return
        for g in sorted(set(gaps)):
            if g >= rest[0]:
                at = gaps.index(g)
                place(rest[1:], gaps[:at] + [g - rest[0]] + gaps[at + 1:])
        place(rest[1:], [*gaps, capacity - rest[0]])
    place(sorted(lengths, reverse=True), [])
    return best


def test_plan_against_the_optimum():
    """On small counts the plan uses all pieces, and at most one sequence more than the fewest."""
    rng, over = np.random.default_rng(6), 0
    for _ in range(120):
        lengths = rng.integers(1, 21, rng.integers(1, 10)).tolist()
        patterns = packing.plan(Counter(lengths), 20)
        assert Counter(x for p, n in patterns for x in list(p) * n) == Counter(lengths) and all(sum(p) <= 20 for p, _ in patterns)
        extra = sum(n for _, n in patterns) - _fewest(lengths, 20)
        assert 0 <= extra <= 1
        over += extra
    assert over <= 12


def test_tokens_of_whole_buffers():
    """Words in any script, marks, digits and spaces get the ids the tokenizer gives their text."""
    import random
    import pyarrow as pa
    from tokenizers import Tokenizer
    from tonecast.llm import tokens
    rng = random.Random(1)
    signs = "abZÀéßÿ×÷ªº9 0²\t\n\x0b\x0c\r'<>s.,!?|-_é́日本 \xa0İ'll't<s>|@Þþ\x00\x1f\x7f\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", ""]
    want = [e.ids for e in Tokenizer.from_file(tokenizer_file()).encode_batch(texts, add_special_tokens=False)]
    coder = tokens.Coder(tokenizer_file())
    coder.pieces.limit = 500  # emptied again and again
    for some in (slice(0, 1500), slice(1500, None), slice(0, 0)):
        ids, counts = coder.encode(pa.array(texts[some], pa.large_string()))
        assert counts.tolist() == list(map(len, want[some])) and ids.tolist() == [i for x in want[some] for i in x]


def test_extra_columns_stay(docs):
    assert docs.count() == quality_rules.judge(docs.withColumn("keep", F.lit(1))).where("keep = 1").count()
