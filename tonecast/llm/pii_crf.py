"""Personal data by fixed patterns and a skip-chain conditional random field.

Nodes are the words with a digit or an at sign, all other words are outside by definition. Neighbouring nodes share a
chain potential; nodes of one document with an equal or similar form (same shape and head, or the same part before an
at sign) share a skip potential, so that evidence at one place reaches the others. Weights are fitted here by
pseudo-likelihood: the pattern matches of a bounded sample of documents are the labels. Loopy sum-product messages then
give the marginals of every document; a word of a kind with probability ``certain`` or more becomes a span beside the
pattern matches, which always stay.

Edge cases: a null or empty text has no spans; without a sample to learn from (an empty table, or no matches) only
patterns speak; repeated rows are treated row by row; extra columns pass through, but a column named ``pii_spans`` or
``masked`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.llm import arrowtext

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_CHARS = 20_000, 50_000  # bounds of the training sample: documents, characters of each
DIM, AGREE = 512, 4.0
TOLERANCE, SETTLE = 1e-3, 100  # messages are damped more and more after SETTLE rounds, so they always come to rest
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
SPAN_SQL = "array<struct<kind: string, start: int, end: int, base: boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: a start there leads to what the start of the run has led to
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]")
Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, odd)) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind, then start; code points, end exclusive. Linear in the text."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@dataclass
class Graph:
    """Nodes of some documents: places, features, labels of the patterns, and edges of both sorts."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray  # nodes x features, indices into the weights
    label: np.ndarray
    chain: np.ndarray  # edges x 2
    tie: np.ndarray  # (node, hub) x 2

    @property
    def hubs(self) -> int:
        return int(self.tie[:, 1].max()) + 1 if len(self.tie) else 0


_SHAPE = str.maketrans({**{str(d): "0" for d in range(10)},
                        **{chr(c): "a" for c in [*range(65, 91), *range(97, 123)]}})


def _features(word: str, before: str, after: str) -> list[int]:
    """Hashed indicators of a word and its surroundings; always the same number of them."""
    digits = sum(c.isdigit() for c in word)
    shape = re.sub(r"(.)\1+", r"\1", word.translate(_SHAPE))[:12]
    marks = (f"d{min(digits, 20)}", f"l{min(len(word), 24)}", f"s{shape}", f"n{word.count('.')}{'@' in word}",
             f"p{'+' in word}{'(' in word}{'-' in word}", f"b{before.translate(_SHAPE)[-3:]}",
             f"a{after.translate(_SHAPE)[:3]}")
    return [0, *(1 + int(x) % (DIM - 1) for x in arrowtext.word_hashes(pa.array(marks)).tolist())]


def _keys(word: str) -> list[str]:
    """Forms that tie a word to similar ones."""
    bare = word.strip(".,;:!?()[]{}<>\"'|&#*$%").lower()
    keys = [f"={bare}"]
    if "@" in bare:
        keys.append(f"@{bare.split('@')[0]}")
    if len(bare) >= 6:
        keys.append(f"~{bare.translate(_SHAPE)}:{bare[:4]}")
    return keys


def build_graph(texts: list[str], bases: list[list[Span]]) -> Graph:
    row, start, end, features, label, chain, tie, hubs = [], [], [], [], [], [], [], 0
    for r, text in enumerate(texts):
        if not _HINT.search(text):
            continue
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        spans, forms, at = sorted((s, e, KINDS.index(k) + 1) for k, s, e in bases[r]), {}, 0
        previous = -2
        for i, (s, e, word) in enumerate(words):
            if not _HINT.search(word):
                continue
            node = len(row)
            while at < len(spans) and spans[at][1] <= s:
                at += 1
            label.append(next((k for a, b, k in spans[at:at + 4] if a < e and b > s), 0))
            row.append(r), start.append(s), end.append(e)
            features.append(_features(word, words[i - 1][2] if i else "", words[i + 1][2] if i + 1 < len(words) else ""))
            if previous == i - 1:
                chain.append((node - 1, node))
            previous = i
            for key in _keys(word):
                forms.setdefault(key, []).append(node)
        # forms of the same nodes have one hub
        for nodes in {tuple(x) for x in forms.values() if len(x) > 1}:
            tie += [(node, hubs) for node in nodes]
            hubs += 1
    whole = lambda x, shape: np.array(x, np.int64).reshape(shape)
    return Graph(whole(row, -1), whole(start, -1), whole(end, -1), whole(features, (len(row), -1)) if row else
                 np.zeros((0, 8), np.int64), whole(label, -1), whole(chain, (-1, 2)),
                 whole(tie, (-1, 2)))


@dataclass
class Model:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, symmetric
    skip: np.ndarray


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _around(edges: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of each node's neighbours, counted."""
    out = np.zeros((len(label), len(KINDS) + 1))
    for a, b in ((0, 1), (1, 0)):
        np.add.at(out, (edges[:, a], label[edges[:, b]]), 1.0)
    return out


def _tied(graph: Graph) -> np.ndarray:
    """For each node the mean labels of the other nodes of each of its hubs, added up."""
    node, hub = graph.tie.T
    truth = np.eye(len(KINDS) + 1)[graph.label]
    counts = np.zeros((graph.hubs, truth.shape[1]))
    np.add.at(counts, hub, truth[node])
    out = np.zeros_like(truth)
    np.add.at(out, node, (counts[hub] - truth[node]) / (counts[hub].sum(axis=1, keepdims=True) - 1))
    return out


def fit(graph: Graph, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model | None:
    """Maximise the pseudo-likelihood by gradient steps with per-weight rates."""
    n, labels = len(graph.label), len(KINDS) + 1
    if n == 0 or not graph.label.any():
        return None
    near, far = _around(graph.chain, graph.label), _tied(graph)
    # where the sample says nothing, tied words agree
    prior = [np.zeros((DIM, labels)), np.zeros((labels, labels)), AGREE * np.eye(labels)]
    w = [x.copy() for x in prior]
    seen = [np.full_like(x, 1e-8) for x in w]
    truth = np.eye(labels)[graph.label]
    for _ in range(steps):
        error = _softmax(w[0][graph.features].sum(axis=1) + near @ w[1] + far @ w[2]) - truth
        grad = [np.zeros_like(w[0]), near.T @ error, far.T @ error]
        for k in range(graph.features.shape[1]):
            np.add.at(grad[0], graph.features[:, k], error)
        grad[1:] = [(g + g.T) / 2 for g in grad[1:]]
        for x, g, s, rest in zip(w, grad, seen, prior, strict=True):
            g = g / n + decay * (x - rest)
            s += g * g
            x -= rate * g / np.sqrt(s)
    return Model(*w)


def marginals(model: Model, graph: Graph, tolerance: float = TOLERANCE) -> np.ndarray:
    """Label probabilities of every node by damped loopy sum-product; pattern matches are evidence."""
    n = len(graph.label)
    unary = np.concatenate((model.unary[graph.features].sum(axis=1), np.zeros((graph.hubs, model.unary.shape[1]))))
    # repeats of a form say the same again, so together they say it once; a pattern match is told in full
    repeats = np.ones(len(unary))
    np.maximum.at(repeats, graph.tie[:, 0], np.bincount(graph.tie[:, 1], minlength=graph.hubs)[graph.tie[:, 1]])
    unary /= repeats[:, None]
    matched = np.flatnonzero(graph.label)
    unary[matched, graph.label[matched]] += 10.0
    both = lambda e: np.concatenate((e, e[:, ::-1]))
    source, target = np.concatenate((both(graph.chain), both(graph.tie + [0, n]))).T
    c, s = len(graph.chain), len(graph.tie)
    back = np.concatenate((np.arange(c) + c, np.arange(c), 2 * c + s + np.arange(s), 2 * c + np.arange(s)))
    # over a hub two potentials follow each other and lose a factor of two; with it a tie passes on what an edge would
    tied = model.skip + np.log(2) * np.eye(len(model.skip))
    pair = np.concatenate((np.repeat(model.chain[None], 2 * c, 0), np.repeat(tied[None], 2 * s, 0)))
    message, step, change, rounds = np.zeros((len(source), unary.shape[1])), 0.5, np.inf, 0
    while len(source) and step * change > tolerance:
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + pair
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        change, rounds = float(np.abs(new - message).max()), rounds + 1
        step *= 1.0 if rounds < SETTLE else 0.9
        message += step * (new - message)
    belief = unary
    np.add.at(belief, target, message)
    return _softmax(belief[:n]) if n else belief[:n]


_EDGE = re.compile(r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9]+$")


def find_spans(texts: list[str], model: Model | None, certain: float) -> list[list[tuple[str, int, int, bool]]]:
    """All spans per text by kind, then start; the last item says whether a pattern found it."""
    bases = [base_spans(t) if _HINT.search(t) else [] for t in texts]
    out = [[(*s, True) for s in b] for b in bases]
    if model is not None:
        graph = build_graph(texts, bases)
        chance = marginals(model, graph)
        best = chance.argmax(axis=1) if len(chance) else np.zeros(0, int)
        linked, held, digits = set(map(tuple, graph.chain.tolist())), -2, 0
        for node in np.flatnonzero((best > 0) & (graph.label == 0)
                                   & (chance.max(axis=1, initial=0) >= certain)).tolist():
            r, s, e = int(graph.row[node]), int(graph.start[node]), int(graph.end[node])
            bare, kind = _EDGE.sub("", texts[r][s:e]), KINDS[best[node] - 1]
            if not bare:
                continue
            s += texts[r][s:e].index(bare)
            own = sum(c.isdigit() for c in bare)
            # a number written in several words is one span
            if held == node - 1 and (held, node) in linked and out[r][-1][0] == kind and kind in ("card", "phone") \
                    and digits + own <= (19 if kind == "card" else 15):
                out[r][-1] = (kind, out[r][-1][1], s + len(bare), False)
                digits += own
            else:
                out[r].append((kind, s, s + len(bare), False))
                digits = own
            held = node
    return [sorted(x, key=lambda y: (KINDS.index(y[0]), y[1], y[2])) for x in out]


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span, or each union of overlapping spans, replaced by its first kind in brackets."""
    out, at, done = [], 0, 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[at:start], f"[{kind.upper()}]"]
        done = max(done, end)
        at = done
    return "".join(out) + text[at:]


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on documents picked by a hash of their text, at most ``sample_docs`` of the table in expectation, each text once."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    hashed = F.xxhash64(F.lit(17), F.col(text))
    picked = docs.select(text, hashed.alias("_hash")).where(
        (F.pmod("_hash", F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & F.col(text).rlike("[0-9@]")
        & (F.length(text) <= sample_chars)).dropDuplicates(["_hash"]).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in arrowtext.text_slices(batches, text):
            found = texts.to_pylist()
            g = build_graph(found, [base_spans(t) for t in found])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (g.features, g.label, g.chain, g.tie)],
                                             ["features", "label", "chain", "tie"])
    parts = picked.mapInArrow(run, "features binary, label binary, chain binary, tie binary").collect()
    read = lambda b, shape: np.frombuffer(bytes(b), np.int64).reshape(shape)
    parts = sorted((bytes(p.features), bytes(p.label), bytes(p.chain), bytes(p.tie)) for p in parts if p.label)
    if not parts:
        return None
    graphs, node, hub = [], 0, 0
    for features, label, chain, tie in parts:
        own = Graph(*[np.zeros(0)] * 3, read(features, (len(label) // 8, -1)), read(label, -1), read(chain, (-1, 2)) + node,
                    read(tie, (-1, 2)) + [node, hub])
        graphs.append(own)
        node += len(own.label)
        hub = max(hub, own.hubs)
    joined = [np.concatenate([getattr(g, name) for g in graphs]) for name in ("features", "label", "chain", "tie")]
    return fit(Graph(*[np.zeros(0)] * 3, *joined))


def find(docs: DataFrame, text: str = "text", model: Model | None = None, certain: float = 0.9,
         with_masked: bool = False) -> DataFrame:
    """Add ``pii_spans`` and, if asked for, ``masked``: the text with spans replaced (null stays null)."""
    model = model or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("pii_spans", "masked")
    names = plain.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields]
                       + [f"pii_spans {SPAN_SQL}"] + ["masked string"] * with_masked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in arrowtext.text_slices(batches, text):
            found = texts.to_pylist()
            spans = find_spans(found, shared.value, certain)
            there = rows.column(rows.schema.get_field_index(text)).is_valid().to_pylist()
            new = [pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in spans], SPAN_TYPE)]
            if with_masked:
                new.append(pa.array([masked(t, s) if ok else None for t, s, ok in zip(found, spans, there, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*names, "pii_spans", *["masked"] * with_masked])
    return plain.mapInArrow(run, schema)
