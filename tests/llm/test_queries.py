"""Registered queries against their SQL, brute force, round trips and held-out accuracy on the smallest tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from checks.compare import _rows, connect
from tonecast.llm.queries import ORACLES, QUERIES, tokenizer_file


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, sf_dir):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def slow_groups(rows, words, part, whole):
    """Component per row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and whole * len(a & b) >= part * len(a | b):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)].append(key)
    return sorted(((key, len(s), min(least[top(i)], default=None)) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def test_jaccard_join_is_exact(spark, sf_dir, documents):
    got = QUERIES["op8_jaccard_join"](spark, sf_dir).collect()
    want = slow_groups([d[:2] for d in documents], 3, 90, 100)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def naive_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_personal_data_base(spark, sf_dir, documents):
    import hashlib
    texts = defaultdict(list)
    for key, text, _ in documents:
        texts[key].append(",".join(f"{k}:{a}:{b}" for k, a, b in naive_spans(text or "")))
    for r in QUERIES["op5_pii"](spark, sf_dir).collect():
        base = texts[r.doc_id][0]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(k + ":") for k in ("email", "ip", "card", "phone"))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_packing_round_trip(spark, sf_dir, documents):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file())
    ids = {k: [*e.ids, 0] for (k, _, _), e in zip(documents, tokenizer.encode_batch(
        [t or "" for _, t, _ in documents], add_special_tokens=False))}
    rows, sequences = QUERIES["op10_packing"](spark, sf_dir).collect(), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.03 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_language_held_out_accuracy(spark, sf_dir, documents):
    lang = {k: x for k, _, x in documents}
    rows = [r for r in QUERIES["op9_language_id"](spark, sf_dir).collect() if r.held_out and lang[r.doc_id]]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.95


def test_url_verdicts(spark, sf_dir):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in QUERIES["op7_url_filters"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect():
        rest = (r.url or "").partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        fit = [x for x in rules if ("." + host.lower()).endswith("." + x.split("/")[0]) and path.startswith(x[x.index("/"):])]
        rule = max(fit, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host.lower(), path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")


def test_pipeline(spark, sf_dir):
    """Each stage does on its own input what a plain version does."""
    import corpus_pipeline
    from tonecast.session import materialize
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append((name, docs))
        docs = materialize(stage(spark, docs, sf_dir), "test")
        if name != "packing":
            assert docs.columns == names
    rows = {name: [(r.doc_id, r.text) for r in d.collect()] for name, d in seen}
    ids = {name: {k for k, _ in x} for name, x in rows.items()}
    judged = {r.doc_id: r.kept for r in QUERIES["op3_quality_rules"](spark, sf_dir).collect()}
    assert ids["near_duplicates"] == {k for k, ok in judged.items() if ok}
    groups = slow_groups(rows["near_duplicates"], 5, 80, 100)
    assert ids["decontamination"] == {c if n else k for k, n, c in groups}
    dirty = {r.doc_id for r in QUERIES["op1_decontamination"](spark, sf_dir).collect() if r.contaminated}
    assert ids["personal_data"] == ids["decontamination"] - dirty
    for key, text in rows["packing"]:
        assert not naive_spans(text) or all("[" in text for _ in [0])
    assert ids["packing"] == ids["personal_data"] == {r.doc_id for r in docs.collect()}
