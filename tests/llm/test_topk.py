"""Top-k against every pair: large components, ties, repeated ids, empty and unequal vectors, blocks that part."""

import math
import random

import pytest

from roadloom.llm import topk

SHAPE = "vec_id long, embedding array<double>, label int, v string, cell int"


def plainly(rows, k=20, every=20):
    """Python's integers, all pairs."""
    known = [(d, [math.floor(64 * c) for c in e]) for d, e, *_ in rows if d is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    for n, (q, a) in enumerate(known):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), d) for m, (d, b) in enumerate(known) if m != n)
            out += [(q, r, d, -s) for r, (s, d) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows_of(vectors):
    return [(d, e, 0, "", 1) for d, e in vectors]


def test_odd_vectors(spark):
    rng = random.Random(7)
    vectors = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [-3.0, 0.5]), (40, []), (60, None), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (120, [float("inf")]), (None, [9.0, 9.0]), (140, [2.0**40]), (1, [0.5, -1.5, 4.0])]
    vectors += [(200 + d, [rng.choice([-1.0, 0.0, 0.015625, 1.0]) for _ in range(rng.randint(0, 4))]) for d in range(60)]
    rows = rows_of(vectors)
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, SHAPE)).collect()))
    assert got == plainly(rows) and len({r[0] for r in got}) > 4
    assert topk.top_k(spark.createDataFrame([], SHAPE)).count() == 0
    assert topk.top_k(spark.createDataFrame(rows_of([(1, [1.0])]), SHAPE)).count() == 0
    assert topk.top_k(spark.createDataFrame(rows_of([(20, [1.0])]), SHAPE)).count() == 0


def test_products_beyond_floats_and_longs(spark):
    large = [(20, [2.0**45, 0.015625]), (40, [2.0**45, -0.5]), (1, [16.5, 0.015625]), (2, [16.5, 0.03125]), (3, [-(2.0**45), 1.0])]
    rows = rows_of([v for v in large if v[0] in (20, 1, 2)])
    want = plainly(rows)
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, SHAPE)).collect())) == want and want[0][3] - want[1][3] == 1 and want[0][3] > 2**60
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame(rows_of(large[1:]), SHAPE)).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame(rows_of([(20, [1e200]), (1, [1.0])]), SHAPE)).collect()


def test_blocks_of_repeated_and_clustered_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "BATCH", 8)
    rng = random.Random(8)
    centers = [[rng.gauss(0, 4) for _ in range(6)] for _ in range(9)]
    vectors = [(d, [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]) for d in range(500)] + [(60, [1.0] * 6)] * 70
    rows = rows_of(vectors)
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, SHAPE), pivots=(12, 40)).collect()))
    assert got == plainly(rows)
