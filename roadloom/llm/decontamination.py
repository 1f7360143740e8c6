"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a span of tokens; tokens at its ignored positions may differ. Each benchmark item gives a
hash for each seed of its window and each position; a document's positions whose kept tokens all occur in the benchmark
are hashed the same way and joined with them. Around each hit the item is laid on the document along the diagonal, and
the overlap counts if some ``STRETCH`` tokens in a row agree in at least ``AGREE`` of them (the whole item if it is
shorter). Substituted tokens are thus tolerated. Items of fewer than ``LEAST`` tokens must agree in all.

No overlap that counts is missed: a window is ``STRETCH`` tokens or the shorter item, and the seeds of each window leave
none of the substitutions that it may have without a hit. Documents are looked at only around places where enough tokens
and pairs of tokens of a window occur in the benchmark, which each overlap needs.

The benchmark is sent to the executors in parts of at most ``PART_TOKENS`` tokens, one scan of the documents for each
part, so what is broadcast is bounded whatever the size of the benchmark; the documents are never shuffled.

Defined cases: null and empty texts match nothing; items without a token are left out; equal documents or
items give a row each; an empty table on either side gives an empty result; extra columns are left out by the report and
kept by the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from roadloom.staging import python_ready

# The seeds of each window, found by search; a shorter window has itself as its seed.
SEEDS_OF = {
    8: ("111011", "11111"),
    9: ("111011",),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("111011", "11111"),
    13: ("11101011", "11001111"),
}
SEEDS = tuple(sorted({s for seeds in SEEDS_OF.values() for s in seeds}))
STRETCH = 13
AGREE = 0.8
LEAST = 8
PART_TOKENS = 2_000_000


def needed(window: int) -> int:
    """How many tokens of a window must agree."""
    return window if window < LEAST else int(np.ceil(AGREE * window - 1e-9))


def seeds_of(window: int) -> tuple[str, ...]:
    return SEEDS_OF.get(window) or ("1" * window,)

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MEMO = 300_000


def tokens(text: str | None) -> list[str]:
    """Lower-case words between white space, without marks at their ends; words of marks only are left out."""
    return [w for w in (_EDGES.sub("", x) for x in text.lower().split()) if w] if text else []


class _Codes(dict):
    """The number of each word between white space, -1 if its token is unknown, -2 if it has none; filled as words come."""

    def __init__(self, words: dict[str, int]):
        self.words = words

    def __missing__(self, raw: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        token = _EDGES.sub("", raw)
        self[raw] = code = self.words.get(token, -1) if token else -2
        return code


class Index:
    """Seeds of benchmark items [(item_id, tokens)], sorted by hash."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        items = [(k, t) for k, t in items if t]
        self.ids = [k for k, _ in items]
        self.words = {w: i for i, w in enumerate(sorted({w for _, t in items for w in t}))}
        self.numbers = _Codes(self.words)
        self.items = [np.array([self.words[w] for w in t], np.int32) for _, t in items]
        self.codes = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7) for w in self.words], np.uint64)
        self.windows = sorted({min(STRETCH, len(t)) for t in self.items})
        n = len(self.words)
        self.pairs = np.unique(np.concatenate([t[:-1].astype(np.int64) * n + t[1:] for t in self.items])) if self.items else np.zeros(1, np.int64)
        self.tables = {w: [self._table(w, np.flatnonzero(np.array(list(x)) == "1")) for x in seeds_of(w)] for w in self.windows}

    def _table(self, window: int, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The offsets of a seed; hash, item and position of the items with that window, sorted by hash."""
        h, item, at = [], [], []
        for k, t in enumerate(self.items):
            if min(STRETCH, len(t)) == window:
                n = len(t) - o[-1]
                h.append(self.hashes(t, np.arange(n), o))
                item.append(np.full(n, k))
                at.append(np.arange(n))
        h, item, at = map(np.concatenate, (h, item, at))
        order = np.argsort(h, kind="stable")
        return o, h[order].astype(np.uint64), item[order], at[order]

    @staticmethod
    def _dense(good: np.ndarray, window: int, least: int) -> np.ndarray:
        """The first places of the windows that hold at least ``least`` good places."""
        upto = np.r_[0, np.cumsum(good)]
        return np.flatnonzero(upto[window:] - upto[:-window] >= least) if len(good) >= window else np.zeros(0, np.int64)

    def _places(self, known: np.ndarray, paired: np.ndarray, window: int) -> np.ndarray | None:
        """Which tokens lie in windows with enough known tokens and pairs; None if there are none."""
        starts = self._dense(known, window, needed(window))
        if len(starts) and window > 1:
            broken = 2 * (window - needed(window))  # a token that differs breaks two pairs
            starts = np.intersect1d(starts, self._dense(paired, window - 1, window - 1 - broken), assume_unique=True)
        if not len(starts):
            return None
        change = np.zeros(len(known) + 1, np.int64)
        change[starts] += 1
        change[starts + window] -= 1
        return np.cumsum(change[:-1]) > 0

    def hashes(self, ids: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for o in offsets:
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.codes[ids[at + o]]
        return h

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, first token, end, agreeing tokens) of the best overlap with each item that counts."""
        ids = np.array(list(map(self.numbers.__getitem__, text.lower().split())), np.int32) if text else np.zeros(0, np.int32)
        ids = ids[ids != -2]
        if not len(ids) or not self.ids:
            return []
        known = ids >= 0
        windows = [w for w in self.windows if len(self._dense(known, w, needed(w)))]
        if not windows:
            return []
        paired = np.zeros(len(ids) - 1, bool)
        if len(self.pairs):
            pairs = np.where(known[:-1] & known[1:], ids[:-1].astype(np.int64) * len(self.words) + ids[1:], -1)
            paired = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] == pairs
        hits = []
        for w in windows:
            inside = self._places(known, paired, w)
            if inside is None:
                continue
            inside &= known
            for o, table, item, at in self.tables[w]:
                n = len(ids) - o[-1]
                if n <= 0:
                    continue
                ok = inside[:n].copy()
                for k in o[1:]:
                    ok &= inside[k : k + n]
                pos = np.flatnonzero(ok)
                if not len(pos):
                    continue
                h = self.hashes(ids, pos, o)
                lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
                count = hi - lo
                if count.any():
                    rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    hits.append(np.stack([item[rows], np.repeat(pos, count) - at[rows]], 1))
        best: dict[int, tuple[int, int, int]] = {}
        for k, diagonal in np.unique(np.concatenate(hits), axis=0).tolist() if hits else []:
            t = self.items[k]
            a, b = max(0, diagonal), min(len(ids), diagonal + len(t))
            long = min(STRETCH, len(t))
            if b - a < long:
                continue
            same = np.r_[0, np.cumsum(ids[a:b] == t[a - diagonal : b - diagonal])]
            good = np.flatnonzero(same[long:] - same[:-long] >= needed(long))
            if len(good):
                first, end = int(good[0]), int(good[-1]) + long
                agree = int(same[end] - same[first])
                if k not in best or agree > best[k][2]:
                    best[k] = (a + first, a + end, agree)
        return [(k, *v) for k, v in sorted(best.items())]


def parts(benchmark: DataFrame, most: int = PART_TOKENS) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in parts of at most ``most`` tokens (an item with more is a part of its own); no more than a partition is held at once."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        t = tokens(r["text"])
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append((r["item_id"], t))
        size += len(t)
    if part:
        yield part


_index: dict[str, Index] = {}


def _of(key: str, items) -> Index:
    if key not in _index:
        _index.clear()
        _index[key] = Index(items)
    return _index[key]


def find_leaks(docs: DataFrame, benchmark: DataFrame, most: int = PART_TOKENS) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, first_token, end_token, agreeing, item_tokens."""
    spark = docs.sparkSession
    python_ready(spark)
    schema = "doc_id long, item_id long, first_token long, end_token long, agreeing long, item_tokens long"

    def scan(part):
        shared = spark.sparkContext.broadcast(part)
        key = uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _of(key, shared.value)
            for b in batches:
                rows = [(d, index.ids[k], first, end, agree, len(index.items[k])) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for k, first, end, agree in index.overlaps(t)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "first_token", "end_token", "agreeing", "item_tokens"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    found = [scan(p) for p in parts(benchmark, most)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, most: int = PART_TOKENS) -> DataFrame:
    """``docs`` without the rows that overlap with an item."""
    spark = docs.sparkSession
    python_ready(spark)
    for part in parts(benchmark, most):
        shared = spark.sparkContext.broadcast(part)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _of(key, shared.value)
            for b in batches:
                yield b.filter(pa.array([not index.overlaps(t) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
