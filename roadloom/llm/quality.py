"""Quality by ordinal cumulative-link regression on graded ratings.

A grade 0, 1, ... K-1 has P(grade <= k) = sigmoid(threshold k - w . x), with one weight vector w for all grades and
ordered thresholds. x holds hashed words, their written shapes, and a few traits of the whole text. The expected grade
and the probability of the highest grade serve selection.

Fitted on a bounded sample: the first ``SAMPLE`` rated documents of at most ``LONGEST`` characters in order of a hash of
their id, then id, a hash of the text and grade, without the rows whose crc32(id as text) mod 5 is 0. Every whole text is scored; since w . x is a sum over
words, a text of any length costs time in proportion and a bounded memory.

Defined cases: a null or empty text has no words and gets the score of the intercepts; a null rating is no rating;
without ratings, or with one grade only, all documents get the same score; rows with equal texts score alike; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.langid import fold
from roadloom.staging import python_ready

FOLDS, HELD_OUT = 5, 0
SAMPLE = 6_000
LONGEST = 20_000
BUCKETS = 1 << 16
GRADES = 3
KEEP = 0.5  # least probability of the highest grade of a selected document
_MEMO = 300_000

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def shape(word: str) -> str:
    """Letters as a, A or Aa, digits as 9, marks as they are but each run of one mark once."""
    def kind(m: re.Match) -> str:
        w = m[0]
        return "a" if w.islower() else "A" if w.isupper() else "Aa" if w[0].isupper() else "aA"

    s = _DIGITS.sub("9", _LETTERS.sub(kind, word))
    return re.sub(r"([^\w\s])\1+", r"\1", s)[:12]


def _bucket(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) % BUCKETS


class Hasher:
    """Buckets of words and shapes; a memo of bounded size holds those of frequent words."""

    def __init__(self):
        self.memo: dict[str, tuple[int, int]] = {}

    def __call__(self, word: str) -> tuple[int, int]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            got = self.memo[word] = (_bucket("w:" + word.lower()), _bucket("s:" + shape(word)))
        return got

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values: shares of words and shapes, and binned traits of the text."""
        words = text.split() if text else []
        n = len(words)
        if not n:
            return np.array([_bucket("t:empty")]), np.array([1.0])
        pairs = np.array([*map(self, words)], np.int64)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        distinct = len(set(words)) / n
        traits = [_bucket(f"t:size{int(np.log2(n))}"), _bucket(f"t:again{int(again * 20)}"), _bucket(f"t:distinct{int(distinct * 20)}")]
        idx, inverse = np.unique(np.concatenate([pairs.T.ravel(), traits]), return_inverse=True)
        values = np.bincount(inverse, np.r_[np.full(n, 3.0 / n), np.full(n, 3.0 / n), np.full(3, 0.5)])
        return idx, values


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int = GRADES, rounds: int = 150, rate: float = 0.3, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(w, thresholds) by Adagrad on the likelihood; thresholds are a first one plus positive steps, so they stay ordered."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    idx, val = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    used, idx = np.unique(idx, return_inverse=True)
    w, gw = np.zeros(len(used)), np.full(len(used), 1e-8)
    share = np.clip([(grade <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    raw = np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    graw = np.full(grades - 1, 1e-8)
    for _ in range(rounds):
        theta = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
        z = np.bincount(at, val * w[idx], n)
        upper = np.c_[sigmoid(theta[None, :] - z[:, None]), np.ones(n)]
        lower = np.c_[np.zeros(n), upper[:, :-1]]
        hi, lo = upper[np.arange(n), grade], lower[np.arange(n), grade]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of the log likelihood, by the thresholds above and below
        dz = dlo - dhi
        dtheta = np.array([(dhi[grade == k].sum() - dlo[grade == k + 1].sum()) / n for k in range(grades - 1)])
        draw = np.array([dtheta.sum(), *(dtheta[k:].sum() * np.exp(raw[k]) for k in range(1, grades - 1))])
        g = np.bincount(idx, val * dz[at], len(used)) / n - penalty * w / n
        gw += g * g
        graw += draw * draw
        w += rate * g / np.sqrt(gw)
        raw += rate * 0.3 * draw / np.sqrt(graw)
    full = np.zeros(BUCKETS)
    full[used] = w
    return full, np.cumsum(np.r_[raw[0], np.exp(raw[1:])])


def predict(z: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, probability of the highest grade)."""
    above = 1 - sigmoid(thresholds[None, :] - np.asarray(z)[:, None])
    return above.sum(1), above[:, -1]


def grade_of(quality: Column, toxic: Column) -> Column:
    """The rating of a labelled document: 0 if poor and toxic, 2 if good and not toxic, else 1."""
    return F.when(quality.isNotNull() & toxic.isNotNull(), (quality > 0).cast("int") + (toxic <= 0).cast("int"))


def learn(docs: DataFrame, ratings: DataFrame, grades: int = GRADES, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """From ratings (doc_id, grade): weights and thresholds."""
    python_ready(docs.sparkSession)
    known = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("grade"))
    chosen = known.select(F.col("doc_id").alias("rated"), F.col("grade").cast("int").alias("grade"), draw.alias("draw")).orderBy("draw", "rated", "grade").limit(sample)
    rows = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), F.col("doc_id") == F.col("rated"))
    rows = rows.select("draw", "doc_id", "grade", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, names = Hasher(), ["draw", "doc_id", "h", "grade"]
        for b in batches:
            f = [hasher.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([i.astype(np.int32) for i, _ in f], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in f], pa.list_(pa.float32()))], [*names, "idx", "val"])

    found = rows.mapInArrow(run, "draw long, doc_id long, h long, grade int, idx array<int>, val array<float>")
    got = found.orderBy("draw", "doc_id", "h", "grade").limit(sample).toArrow().to_pylist()
    if len({r["grade"] for r in got}) < 2:
        return np.zeros(BUCKETS), np.arange(grades - 1.0) - (grades - 2) / 2
    return fit([(np.array(r["idx"]), np.array(r["val"], float)) for r in got], np.array([r["grade"] for r in got]), grades)


_hasher: list[Hasher] = []


def score(docs: DataFrame, ratings: DataFrame, grades: int = GRADES, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, expected_grade, p_top, selected."""
    python_ready(docs.sparkSession)
    w, thresholds = learn(docs, ratings, grades)
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, theta = shared.value
        if not _hasher:
            _hasher.append(Hasher())
        for b in batches:
            z = []
            for t in b.column("text").to_pylist():
                i, v = _hasher[0].features(t)
                z.append(float(weights[i].astype(float) @ v))
            expected, top = predict(np.array(z, float), theta)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(expected), pa.array(top), pa.array(top >= keep)], ["doc_id", "held_out", "expected_grade", "p_top", "selected"])

    rows = docs.select("doc_id", (fold(docs["doc_id"], FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, p_top double, selected boolean")
