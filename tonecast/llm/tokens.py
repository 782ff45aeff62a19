"""Token ids of whole batches of texts by a public tokenizer file, with equal words encoded once."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tonecast.llm import arrowtext

# fixed values: the normaliser and splitting of the tokenizers whose words can be encoded one by one
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
#: Class of an ASCII byte. Words of letters (A-Z, Latin-1 ones too), digits and marks split into runs of letters, single
#: digits and runs of marks whatever stands around them; words with another character are encoded whole.
_CLASS = np.full(256, _OTHER, np.uint8)
for _c in range(128):
    if chr(_c) in " \t\n\v\f\r":
        _CLASS[_c] = _SPACE
    elif chr(_c).isalpha():
        _CLASS[_c] = _LETTER
    elif chr(_c).isdigit():
        _CLASS[_c] = _DIGIT
    elif 33 <= _c < 127 and chr(_c) not in "'<":
        _CLASS[_c] = _MARK
_CACHED = 250_000
_coders: dict[str, "Coder"] = {}


class Ids:
    """Ids of strings met so far, in one flat array; emptied when it holds ``limit`` strings."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = _CACHED):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, strings: list[bytes]) -> np.ndarray:
        """Where each of the distinct ``strings`` stands in ``start`` and ``size``."""
        new = [s for s in strings if s not in self.place]
        if len(self.place) + len(new) > self.limit and self.place:
            self.clear()
            new = strings
        if new:
            ids = self.encode([s.decode() for s in new])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            start = len(self.flat) + np.cumsum(size) - size
            self.place.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
            self.flat = np.concatenate((self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))))
            self.start, self.size = np.concatenate((self.start, start)), np.concatenate((self.size, size))
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))


class Coder:
    """A tokenizer and the ids of pieces and words met so far (bounded caches)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.wordwise = all(config[k] == v for k, v in _WORDWISE.items())
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        bytewise = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(33, 127), *range(0xC0, 0x100)]}
        model = self.tokenizer.model
        self.pieces = Ids(lambda pieces: [[t.id for t in model.tokenize(p if p.isascii() else p.translate(bytewise))] for p in pieces])
        self.words = Ids(self._encode)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and their number per text."""
        if not self.wordwise:
            ids = self._encode(text.to_pylist())
            return (np.fromiter((i for x in ids for i in x), np.uint32),
                    np.fromiter(map(len, ids), np.int64, len(ids)))
        at, data = arrowtext.raw_bytes(text)
        plain, whole = _split(at, np.frombuffer(data, np.uint8))
        starts, ids, counts = [], [], np.zeros(len(text), np.int64)
        for (start, strings), cache in ((plain, self.pieces), (whole, self.words)):
            if not len(start):
                continue
            coded = strings.dictionary_encode()
            place = cache.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            size = cache.size[place]
            ends = np.concatenate(([0], np.cumsum(size)))
            ids.append(cache.flat[np.repeat(cache.start[place] - ends[:-1], size) + np.arange(ends[-1])])
            counts += np.diff(ends[np.searchsorted(start, at)])
            starts.append(np.repeat(start, size) if len(whole[0]) else start)
        if len(ids) < 2:
            return (ids[0] if ids else np.zeros(0, np.uint32)), counts
        return np.concatenate(ids)[np.argsort(np.concatenate(starts), kind="stable")], counts


def _strings(data: np.ndarray, inside: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The strings of the bytes ``inside``, each from ``start`` to ``stop``."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start),
                                            [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())])


def _split(at: np.ndarray, data: np.ndarray) -> tuple[tuple[np.ndarray, pa.Array], tuple[np.ndarray, pa.Array]]:
    """Starts and strings of the lower-cased pieces of plain words, and of the other words."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = _LETTER
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    full = kind != _SPACE
    begins = first[:-1].copy()
    begins[1:] |= ~full[:-1]
    begins &= full
    word = np.flatnonzero(begins)
    stops = first[1:].copy()
    stops[-1:] = True
    stops[:-1] |= ~full[1:]
    stop = np.flatnonzero(stops & full) + 1
    other, plain = kind == _OTHER, full
    odd = np.zeros(len(word), bool)
    if other.any():
        odd[np.searchsorted(word, np.flatnonzero(other), side="right") - 1] = True
        mine = np.zeros(len(data) + 1, np.int8)
        mine[word[odd]] += 1
        mine[stop[odd]] -= 1
        mine = np.cumsum(mine[:-1], dtype=np.int8).astype(bool)
        plain = full & ~mine
    starts = begins
    starts[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    ends = stops
    ends[:-1] |= starts[1:]
    starts &= plain
    ends &= plain
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    capital = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E)] + 1
    low[capital] += 32
    piece = np.flatnonzero(starts)
    pieces = _strings(low, plain, piece, np.flatnonzero(ends) + 1)
    if not odd.any():
        return (piece, pieces), (piece[:0], pieces[:0])
    return (piece, pieces), (word[odd], _strings(data, mine, word[odd], stop[odd]))


def coder(path: str) -> Coder:
    """The task's tokenizer of a file; a Python worker loads it once."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]
