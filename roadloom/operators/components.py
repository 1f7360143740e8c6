"""Connected components by alternating star steps, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.staging import BROADCAST_ROWS, grown, python_ready, staged, within_bound

MOST_ROUNDS = 60
#: Edges that are joined to trees at once in a task's memory, at random or by ranges of ids.
BLOCK, RANGE = 1 << 16, 1 << 18


def trees(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Each node's smallest connected node, for nodes other than those."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        end = x
        while end in up:
            end = up[end]
        while x != end:
            up[x], x = end, up[x]
        return end

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def _contracted(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The edges of a task, block by block, as stars."""

    def stars(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        found = trees(edges)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["u", "v"])

    held: list[tuple[int, int]] = []
    for b in batches:
        held.extend(zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True))
        if len(held) >= block:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def _all_stars(e: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node at most, and none if a larger one has an edge to it."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or ups > 0 and n > ups").isEmpty()


def components(edges: DataFrame, local: bool = False) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b; long); the root is the smallest node of the component.

    First each block of edges becomes stars in its task. Then a large-star step links a node's larger neighbours to its
    smallest one, a small-star step its smaller ones; rounds grow with the logarithm of the longest path, and end once
    all is stars. Where neighbours mostly have ids that are near each other (``local``), blocks are ranges of ids; few
    components lie in several of them, and rounds are made on the links between their stars only. Minima are partial aggregates, so a hub's edges are not gathered in a task.
    They are broadcast if the edges are few, by their count, and else written, so that a join that shuffles can split a hub.
    """
    python_ready(edges.sparkSession)
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "star")
    block = RANGE if local else BLOCK
    n = e.count() // block + 1
    blocks = e.repartitionByRange(n, "u", "v") if local else e.repartition(n)  # u, as virtual nodes have the smallest ids
    e = staged(blocks.mapInArrow(partial(_contracted, block=2 * block if local else block), "u long, v long").distinct(), "star")
    if local:
        return _joined(e)
    for _ in range(MOST_ROUNDS):
        if _all_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        few = within_bound(e, BROADCAST_ROWS // 2)  # an edge has two nodes
        kept = (lambda df, _: df) if few else staged
        held = F.broadcast if few else grown
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = kept(both.where("v > u").join(held(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(held(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
    raise RuntimeError(f"components did not settle within {MOST_ROUNDS} rounds")


def _joined(e: DataFrame) -> DataFrame:
    """(node, root) from stars of blocks (u, v): centres that share a node, or are one of another star, are components of their own."""
    least = staged(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    share = e.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    centres = staged(e.select("v").distinct(), "centres")
    below = centres.join(least, centres["v"] == least["u"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    links = components(share.unionByName(below).distinct())
    top = centres.join(least, centres["v"] == least["u"], "left_anti").select(F.col("v").alias("u"), F.col("v").alias("m"))
    stars = least.unionByName(top)
    return stars.join(links, stars["m"] == links["node"], "left").select(F.col("u").alias("node"), F.coalesce("root", "m").alias("root"))
