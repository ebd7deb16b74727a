"""Encoding a corpus with a public byte-level BPE (problem 7).

Text is cut by the tokenizer's pattern. A piece's merges run on a segment tree over the ranks of its adjacent pairs: the root is the
lowest rank, leftmost among equals; a merge updates at most three leaves, each in logarithmic time, until the root has no rank. So a
piece of n bytes costs O(n log n) however long it is. Pieces repeat, so their ids are kept in a cache of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from procmill.session import ship, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the pattern of the tokenizer, with its white space written out (Unicode's White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the tokenizer's file: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, iter(range(256, 512))
    return [out[b] if b in out else chr(next(free)) for b in range(256)]


def unlike(whole: dict) -> str | None:
    """What in a tokenizer's file differs from byte-level pairs over PATTERN without any normalisation; None if nothing does."""
    pre, model = whole.get("pre_tokenizer") or {}, whole.get("model") or {}
    steps = pre.get("pretokenizers", [pre])
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        return "its model"
    if whole.get("normalizer"):
        return "a normalizer"
    if [s.get("type") for s in steps] != ["ByteLevel"] or steps[0].get("add_prefix_space") or not steps[0].get("use_regex", True):
        return "its pre-tokenizer"
    return "added tokens that are no special ones" if any(not t.get("special") for t in whole.get("added_tokens") or []) else None


class Encoder:
    """Encodes texts to ids; the caches hold at most `most` pieces."""

    def __init__(self, path: str = TOKENIZER, most: int = 500_000, longest: int = 200):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        if (said := unlike(whole)) is not None:
            raise ValueError(f"{path} is no tokenizer of the kind that is built here: {said}")
        vocab = model["vocab"]
        self.letters = byte_letters()
        self.first = [vocab[c] for c in self.letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a] << 20) | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        self.vocab, self.most, self.longest = vocab, most, longest
        self.pattern = regex.compile(PATTERN)
        encoder = self

        class Cache(dict):
            def __missing__(self, piece: str):
                ids = encoder.merge(piece.encode("utf-8"))
                if len(piece) <= encoder.longest:
                    if len(self) >= encoder.most:
                        self.clear()
                    self[piece] = ids
                return ids

        class Sizes(dict):
            def __missing__(self, piece: str):
                n = len(encoder.merge(piece.encode("utf-8")))
                if len(piece) <= encoder.longest:
                    if len(self) >= encoder.most:
                        self.clear()
                    self[piece] = n
                return n

        self.ids, self.sizes = Cache(), Sizes()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece, by merges in order of rank, leftmost first among equals."""
        ids = [self.first[b] for b in piece]
        m = len(ids) - 1  # pairs
        if m < 1:
            return tuple(ids)
        get, made = self.ranks.get, self.made
        n = m + 1
        tree = [_NONE] * (2 * m)  # leaf m + i: rank * n + i of the pair that begins at i
        for i in range(m):
            r = get((ids[i] << 20) | ids[i + 1])
            if r is not None:
                tree[m + i] = r * n + i
        for k in range(m - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def put(i: int, value: int) -> None:
            k = m + i
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        root = 1
        while (top := tree[root]) != _NONE:
            r, i = divmod(top, n)
            j = after[i]
            k = after[j]
            ids[i] = made[r]
            ids[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
            if j < m:
                put(j, _NONE)
            r = get((ids[i] << 20) | ids[k]) if k < n else None
            put(i, _NONE if r is None else r * n + i)
            h = before[i]
            if h >= 0:
                r = get((ids[h] << 20) | ids[i])
                put(h, _NONE if r is None else r * n + h)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, no special tokens; an empty or a null text has none, and strings of special tokens are plain text."""
        return list(chain.from_iterable(map(self.ids.__getitem__, self.pattern.findall(text)))) if text else []

    def size(self, text: str | None) -> int:
        return sum(map(self.sizes.__getitem__, self.pattern.findall(text))) if text else 0

    def decode(self, ids: list[int]) -> str:
        names = getattr(self, "_names", None)
        if names is None:
            names = self._names = {i: t for t, i in self.vocab.items()}
            self._bytes = {c: b for b, c in enumerate(self.letters)}
        return bytes(self._bytes[c] for i in ids for c in names[i]).decode("utf-8")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _ids(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            lists = [e.encode(t) for t in b["_text"].to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b[key], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    return run


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(key, ids): one row for each row of df, without any shuffle. Null and empty texts have the empty list."""
    ship(df.sparkSession)
    src = df.select(key, F.col(text).alias("_text"))
    return spread(src).mapInArrow(_ids(path, key), f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def _sizes(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[key], pa.array([e.size(t) for t in b["_text"].to_pylist()], pa.int64())], [key, "n_tokens"])

    return run


def token_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens): 0 for null and empty texts."""
    ship(df.sparkSession)
    src = df.select(key, F.col(text).alias("_text"))
    return spread(src).mapInArrow(_sizes(path, key), f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")


def token_counts(df: DataFrame) -> DataFrame:
    """Rows, tokens and longest text per language as it stands."""
    return token_sizes(df).join(df.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("max_tokens"))
