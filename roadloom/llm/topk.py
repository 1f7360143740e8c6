"""Exact top-k inner products by a dual-tree search with cover trees.

Vectors become integers, so scores are exact. A cover tree over a bounded sample of pivots, more of them for more rows
(twice the square root of the rows, from ``PIVOTS[0]`` to ``PIVOTS[1]``), splits the space into cells; every row belongs
to the cell of its nearest pivot, and each cell keeps its covering radius over all its rows. Queries and data are indexed
by the same tree. A pair of nodes with centers a, b and radii r, s can hold no score above a.b + |a| s + |b| r + r s; it
is pruned when that is below the worst k-th score of the query node, which a first round over each query block's home
data sets. The descent runs in tasks, one for each of some subtrees of queries, and gives pairs of a query block and a
data block as rows; both have a bounded size. Queries and data are joined with the pairs, and each pair is searched cell
against cell under the same bound. It gives k rows a query at most, and the best k over all pairs are kept.

What the driver holds is a row a pivot. Rows are dealt to blocks by a number of their own, so rows of one id part too.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id; an
empty vector scores 0 with all others, and missing trailing components count as 0; ties in score go to the smaller id;
rows with equal ids are rows of their own, as queries and as candidates; components of any size are multiplied exactly,
and a component or a score among the best that does not fit a long is an error; an empty table gives an empty result;
extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from roadloom.staging import python_ready, staged, within_bound

K = 20
EVERY = 20
SCALE = 64
PIVOTS = (128, 4096)
DATA_BLOCK = 4096
QUERY_BLOCK = 2048
BATCH = 1024  # candidates scored at once
SUBTREES = 64
NEVER = -(2**63)  # below any score
OUT = "q_row long, query_id long, vec_id long, score long"


class CoverTree:
    """Levels of centers over distinct points: the children of a center lie apart and cover its points within half its radius."""

    def __init__(self, points: np.ndarray):
        x = points.astype(np.float64)
        self.centers: list[int] = []  # of each node, parents first
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.parents: list[int] = []
        todo = [(0, np.arange(len(x)), -1)] if len(x) else []
        while todo:
            center, members, parent = todo.pop()
            me = len(self.centers)
            self.centers.append(int(center))
            self.members.append(members)
            self.children.append([])
            self.parents.append(parent)
            if parent >= 0:
                self.children[parent].append(me)
            if len(members) == 1:
                continue
            radius = np.linalg.norm(x[members] - x[center], axis=1).max()
            rest, picks = members, []
            while len(rest):
                c = center if not picks else rest[0]
                near = (np.linalg.norm(x[rest] - x[c], axis=1) <= radius / 2) | (rest == c)
                picks.append((c, rest[near], me))
                rest = rest[~near]
            if len(picks) == 1:  # points that floating point cannot tell apart
                picks = [(m, np.array([m]), me) for m in members]
            todo += reversed(picks)

    def leaves(self) -> list[int]:
        """Points in the order of the tree: near ones stand together."""
        return [c for c, m in zip(self.centers, self.members, strict=True) if len(m) == 1]

    def subtrees(self, least: int = SUBTREES) -> list[int]:
        """Nodes that hold all points together without overlap, ``least`` or more where there are so many."""
        nodes = [0]
        while len(nodes) < least and any(self.children[n] for n in nodes):
            nodes = [m for n in nodes for m in self.children[n] or [n]]
        return nodes


def _matrix(column, dim: int) -> np.ndarray:
    rows = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    if rows and all(len(v) == dim for v in rows):
        return np.array(rows, np.float64).reshape(len(rows), dim)
    out = np.zeros((len(rows), dim))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by floats or longs where these hold every partial sum, else by Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**52:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)
    return whole(a) @ whole(b).T


def bound(a: np.ndarray, r: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Most a point within r of a can score with one within s of b, for all pairs of rows; with room for rounding."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    spread = na[:, None] * s[None, :] + r[:, None] * nb[None, :] + r[:, None] * s[None, :]
    return a @ b.T + spread + 1e-9 * (na[:, None] * nb[None, :] + spread) + 1e-6


def below(score: float) -> float:
    """A little less, as a long may be rounded up to a float."""
    return score - 1e-9 * abs(score) if np.isfinite(score) else score


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score, then id."""
    if scores.dtype == object:
        order = np.array([sorted(range(len(s)), key=lambda j, s=s, i=i: (-s[j], i[j]))[:k] for s, i in zip(scores, ids, strict=True)])
    else:
        order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search_block(queries: pd.DataFrame, data: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """The best k of ``data`` for each of ``queries`` (row, vec_id, cell, v; queries also floor): cells as nodes, pruned by bounds."""
    q, d = _matrix(queries["v"], dim), _matrix(data["v"], dim)
    qrow, drow = queries["row"].to_numpy(np.int64), data["row"].to_numpy(np.int64)
    qid, did = queries["vec_id"].to_numpy(np.int64), data["vec_id"].to_numpy(np.int64)

    def nodes(x: np.ndarray, cell: np.ndarray):
        out = []
        for c in np.unique(cell):
            rows = np.flatnonzero(cell == c)
            center = x[rows].mean(0)
            out.append((rows, center, np.linalg.norm(x[rows] - center, axis=1).max()))
        return out

    qs, ds = nodes(q, queries["cell"].to_numpy()), nodes(d, data["cell"].to_numpy())
    side = lambda ns: (np.array([c for _, c, _ in ns]).reshape(len(ns), dim), np.array([r for _, _, r in ns]))
    tops = bound(*side(qs), *side(ds))
    floors = queries["floor"].to_numpy(np.int64)
    out = []
    for (rows, _, _), top in zip(qs, tops, strict=True):
        floor = floors[rows]
        worst = np.where(floor == NEVER, -np.inf, floor.astype(np.float64))
        scores, ids = np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0), np.int64)
        order, at = np.argsort(-top, kind="stable"), 0
        while at < len(order) and top[order[at]] >= below(worst.min()):
            cand = []
            while at < len(order) and sum(map(len, cand)) < BATCH and top[order[at]] >= below(worst.min()):
                cand.append(ds[order[at]][0])
                at += 1
            cand = np.concatenate(cand)
            s = _dot(q[rows], d[cand])
            s[qrow[rows][:, None] == drow[cand][None, :]] = NEVER  # the query's own row
            s, i = _best(s, np.broadcast_to(did[cand], s.shape), k)
            scores, ids = _best(np.concatenate([scores, s], 1), np.concatenate([ids, i], 1), k)
            if scores.shape[1] == k:
                worst = np.maximum(worst, scores[:, -1].astype(np.float64))
        if scores.dtype == object:
            if any(not -(2**63) <= s < 2**63 for s in scores.ravel()):
                raise OverflowError("an inner product among the best does not fit a long")
            scores = scores.astype(np.int64)
        row, col = np.nonzero((scores > NEVER) & (scores >= floor[:, None]))
        out.append(pd.DataFrame({"q_row": qrow[rows][row], "query_id": qid[rows][row], "vec_id": ids[row, col], "score": scores[row, col]}))
    return pd.concat(out)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v array<double> of whole numbers) of the vectors that take part."""
    e = F.col("embedding")
    ok = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    y = lambda x: x.cast("double") * float(scale)
    large = F.raise_error(F.lit("a component does not fit a long")).cast("double")
    whole = lambda x: F.when(F.abs(y(x)) < 2.0**52, F.floor(y(x)).cast("double")).when(F.abs(y(x)) < 2.0**63, y(x)).otherwise(large)
    return vectors.where(F.col("vec_id").isNotNull() & ok).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(e, whole).alias("v"))


def _blocks(counts: dict[int, int], order: list[int], most: int) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of each cell: small cells that are near share one, large ones are split."""
    out, block, filled = {}, 0, 0
    for c in order:
        n = counts.get(c, 0)
        if not n:
            continue
        if n > most:
            block += filled > 0
            parts = -(-n // most)
            out[c], block, filled = (block, parts), block + parts, 0
            continue
        if filled + n > most:
            block, filled = block + 1, 0
        out[c] = (block, 1)
        filled += n
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, pivots: tuple[int, int] = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    python_ready(spark)
    x = staged(integers(vectors, scale), "vectors")
    shape = "query_id long, rank int, vec_id long, score long"
    size = x.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], shape)
    dim = max(1, size["dim"])
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(int(min(max(2 * size["n"] ** 0.5, pivots[0]), pivots[1]))).collect()
    centers = np.unique(_matrix([r["v"] for r in sample], dim), axis=0)
    tree = CoverTree(centers)
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        square = (c**2).sum(1)[None, :]
        for b in batches:
            v = _matrix(b.column("v"), dim)
            cell = (square - 2 * v @ c.T).argmin(1)
            far = np.linalg.norm(v - c[cell], axis=1) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], ["row", "vec_id", "v", "cell", "far"])

    x = staged(x.mapInArrow(assign, "row long, vec_id long, v array<double>, cell int, far double"), "cells")
    is_query = F.col("vec_id") % every == 0
    per_cell = x.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("nq"), F.max("far").alias("r"), F.max(F.when(is_query, F.col("far"))).alias("rq"))
    cells = {r["cell"]: r for r in per_cell.collect()}  # at most one row a pivot
    of_data = _blocks({c: r["n"] for c, r in cells.items()}, tree.leaves(), DATA_BLOCK)
    of_query = _blocks({c: r["nq"] for c, r in cells.items()}, tree.leaves(), QUERY_BLOCK)
    if not of_query:
        return spark.createDataFrame([], shape)

    def in_blocks(rows: DataFrame, of: dict[int, tuple[int, int]], name: str) -> DataFrame:
        table = F.broadcast(spark.createDataFrame([(c, a, n) for c, (a, n) in of.items()], "at int, first int, blocks int"))  # a row a pivot
        block = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).cast("int").alias(name)
        return rows.join(table, rows["cell"] == table["at"]).select("row", "vec_id", "v", "cell", block)

    data = in_blocks(x, of_data, "db")
    queries = staged(in_blocks(x.where(is_query), of_query, "qb"), "queries")
    span = lambda of, c: range(of[c][0], sum(of[c])) if c in of else ()
    home = spark.createDataFrame(sorted({(qb, of_data[c][0]) for c in of_query for qb in span(of_query, c)}), "qb int, db int")  # a pivot has few

    def evaluate(pairs: DataFrame, qs: DataFrame) -> DataFrame:
        hint = F.broadcast if within_bound(pairs) else (lambda t: t)
        qs = qs.join(hint(pairs), "qb").select("row", "vec_id", "v", "cell", "floor", "qb", "db")
        ds = data.join(hint(pairs), "db").select("row", "vec_id", "v", "cell", "qb", "db")
        return qs.groupBy("qb", "db").cogroup(ds.groupBy("qb", "db")).applyInPandas(lambda a, b: search_block(a, b, dim, k) if len(a) and len(b) else pd.DataFrame(columns=["q_row", "query_id", "vec_id", "score"], dtype="int64"), OUT)

    first = staged(evaluate(home, queries.withColumn("floor", F.lit(NEVER).cast("long"))), "first")
    kth = first.groupBy("q_row").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("q_row", F.get("s", F.lit(k - 1)).alias("kth"))
    floors = staged(queries.join(kth, queries["row"] == kth["q_row"], "left").select("row", "vec_id", "v", "cell", "qb", F.coalesce("kth", F.lit(NEVER).cast("long")).alias("floor")), "floors")
    worst = {r["cell"]: below(float(r["w"]) if r["w"] > NEVER else -np.inf) for r in floors.groupBy("cell").agg(F.min("floor").alias("w")).collect()}

    nodes = range(len(tree.centers))
    radius = lambda key: np.array([max((float(np.linalg.norm(centers[m] - centers[tree.centers[n]])) * (1 + 1e-9) + (cells[m][key] or 0.0) for m in tree.members[n] if m in cells), default=0.0) for n in nodes])
    lowest = np.array([min((worst[m] for m in tree.members[n] if m in worst), default=np.inf) for n in nodes])
    known = spark.sparkContext.broadcast((tree, centers[tree.centers], radius("rq"), radius("r"), lowest, of_query, of_data))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks below the query nodes that no bound rules out."""
        tree, c, rq, rd, least, of_query, of_data = known.value
        for b in batches:
            for start in b.column("node").to_pylist():
                todo, pairs = [(start, np.array([0]))], set()
                while todo:
                    a, others = todo.pop()
                    if least[a] == np.inf:
                        continue
                    others = others[bound(c[[a]], rq[[a]], c[others], rd[others])[0] >= least[a]]
                    if not len(others):
                        continue
                    below = np.array([j for n in others for j in tree.children[n] or [n]])
                    if tree.children[a]:
                        todo += [(i, below) for i in tree.children[a]]
                    elif any(tree.children[n] for n in others):
                        todo.append((a, below))
                    else:
                        dbs = {db for n in others for db in span(of_data, tree.centers[n])}
                        pairs |= {(qb, db) for qb in span(of_query, tree.centers[a]) for db in dbs}
                qb, db = zip(*sorted(pairs), strict=True) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(qb, pa.int32()), pa.array(db, pa.int32())], ["qb", "db"])

    roots = tree.subtrees()
    starts = spark.createDataFrame([(n,) for n in roots], "node int").repartition(min(len(roots), SUBTREES))
    pairs = staged(starts.mapInArrow(descend, "qb int, db int").distinct().join(F.broadcast(home), ["qb", "db"], "left_anti"), "pairs")
    found = first if pairs.isEmpty() else first.unionByName(evaluate(pairs, floors))
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH x AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, d.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(d.v)) + 1), lambda i: q.v[i] * d.v[i])), 0)::BIGINT AS score
  FROM x q JOIN x d ON q.vec_id % {EVERY} = 0 AND q.row <> d.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
