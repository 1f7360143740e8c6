"""Measures of a network: summaries, street statistics, orientation, components, reach, checks and differences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from roadloom.functions.geo import bearing, haversine
from roadloom.operators.components import components
from roadloom.staging import grown, python_ready, staged, within_bound


def summary(edges: DataFrame, by: str = "highway") -> DataFrame:
    return edges.groupBy(by).agg(F.count("*").alias("n_edges"), F.round(F.sum(F.col("length_m").cast("double")) / 1000, 3).alias("km"), F.count_if("oneway").alias("n_oneway"))


def streets(edges: DataFrame) -> DataFrame:
    """a, b, n, length_m: an undirected street for each pair of nodes, as often as its busier direction has edges."""
    pair = edges.groupBy("source", "target").agg(F.count("*").alias("n"), F.min("length_m").alias("length_m"))
    return pair.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("n").alias("n"), F.min("length_m").alias("length_m"))


def streets_per_node(edges: DataFrame) -> DataFrame:
    """node_id, streets: a loop counts twice."""
    return streets(edges).select(F.explode(F.array("a", "b")).alias("node_id"), "n").groupBy("node_id").agg(F.sum("n").alias("streets"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return streets_per_node(edges).groupBy("streets").agg(F.count("*").alias("n_nodes"))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge for each street: of edges between the same nodes, of the same way and along the same nodes in either order, that of the smallest id."""
    text = lambda r: F.array_join(r.cast("array<string>"), ",")
    shape = F.least(text(F.col("refs")), text(F.reverse("refs")))
    key = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("osm_id"), shape.alias("shape")]
    kept = edges.groupBy(*key).agg(F.min("edge_id").alias("edge_id")).select("edge_id")
    return edges.join(kept, "edge_id", "left_semi")


def stats(edges: DataFrame) -> DataFrame:
    """One row of basic measures: nodes, edges, streets, intersections, lengths, circuity, share of loops."""
    per = streets_per_node(edges).agg(F.count("*").alias("n_nodes"), F.count_if(F.expr("streets > 1")).alias("n_intersections"), F.round(F.avg("streets"), 6).alias("streets_per_node"))
    length = lambda: F.col("length_m").cast("double")
    a, b = F.get("geometry", F.lit(0)), F.element_at("geometry", -1)
    straight = haversine(a["lon"], a["lat"], b["lon"], b["lat"])
    m = edges.agg(F.count("*").alias("n_edges"), F.round(F.sum(length()), 1).alias("length_m"), F.round(F.avg(length()), 3).alias("mean_m"))
    u = undirected(edges).agg(
        F.count("*").alias("n_streets"), F.round(F.sum(length()), 1).alias("street_length_m"), F.round(F.avg(length()), 3).alias("street_mean_m"),
        F.round(F.sum(length()) / F.sum(straight), 4).alias("circuity"), F.round(F.avg((F.col("source") == F.col("target")).cast("int")), 6).alias("loops"),
    )
    one = [x.withColumn("one", F.lit(1)) for x in (per, m, u)]
    return reduce(lambda x, y: x.join(y, "one"), one).drop("one").withColumn("k_avg", F.round(2 * F.col("n_edges") / F.col("n_nodes"), 6))


def with_bearing(edges: DataFrame) -> DataFrame:
    a, b = F.get("geometry", F.lit(0)), F.element_at("geometry", -1)
    return edges.withColumn("bearing", bearing(a["lon"], a["lat"], b["lon"], b["lat"]))


def orientation(edges: DataFrame, bins: int = 36) -> DataFrame:
    """bin, n, entropy: both directions of each street by compass direction, in bins centered on multiples of their width.

    Counted in half bins; a bin joins the half before its middle and the half after it.
    """
    half = 180.0 / bins
    at = lambda b: F.floor(F.pmod(F.round(b, 6), F.lit(360.0)) / half).cast("int")
    both = F.explode(F.array(at(F.col("bearing")), at(F.col("bearing") + 180)))
    b = with_bearing(undirected(edges)).select(both.alias("half")).select(((F.col("half") + 1) % (2 * bins) / 2).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())  # a row for each bin
    return b.withColumn("p", share).withColumn("entropy", F.round(F.sum(-F.col("p") * F.log("p")).over(W.partitionBy()), 6)).drop("p")


def weak_components(edges: DataFrame) -> DataFrame:
    """node_id, component: the smallest node that is connected, whatever the direction."""
    return components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), True).select(F.col("node").alias("node_id"), F.col("root").alias("component"))


#: Arcs of a weak component up to which one task finds its strong components.
TASK_ARCS = 1_000_000


#: Arcs of whole components that a task takes at once, at least.
CHUNK = 1 << 16


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = CHUNK) -> Iterator[pa.Table]:
    """Rows in order of ``root`` in pieces of whole roots, so that many small ones cost one step."""
    held, n, enough = [], 0, least
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < enough:
            continue
        t = pa.Table.from_batches(held)
        root = t.column("root").to_numpy()
        cut = int(np.flatnonzero(root != root[-1])[-1]) + 1 if root[0] != root[-1] else 0
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).combine_chunks().to_batches(), n - cut
        enough = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def in_whole_groups(rows: DataFrame, find: Callable[[pa.Table], list[list]], schema: str) -> DataFrame:
    """The columns that ``find`` gives for pieces of ``rows`` (root, ...) with all rows of their roots."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in find(t)], names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "root").sortWithinPartitions("root").mapInArrow(run, schema)


def strong_groups(out: dict[int, list[int]]) -> list[list[int]]:
    """The strong components, each after all that it reaches: depth first without recursion, the lowest number reachable on the stack."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_: list[int] = []
    on: set[int] = set()
    groups: list[list[int]] = []
    for root in out:
        if root in number:
            continue
        todo = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        on.add(root)
        while todo:
            u, after = todo[-1]
            for v in after:
                if v not in number:
                    number[v] = low[v] = len(number)
                    open_.append(v)
                    on.add(v)
                    todo.append((v, iter(out[v])))
                    break
                if v in on:
                    low[u] = min(low[u], number[v])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[u])
                if low[u] == number[u]:
                    group = [open_.pop()]
                    while group[-1] != u:
                        group.append(open_.pop())
                    on.difference_update(group)
                    groups.append(group)
    return groups


def lists_of_arcs(source: list[int], target: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for u, v in zip(source, target, strict=True):
        out.setdefault(u, []).append(v)
        out.setdefault(v, [])
    return out


def _strong(t: pa.Table) -> list[list]:
    groups = strong_groups(lists_of_arcs(t.column("source").to_pylist(), t.column("target").to_pylist()))
    return [[x for g in groups for x in g], [c for g, c in zip(groups, map(min, groups), strict=True) for _ in g]]


def strong_components(edges: DataFrame, most: int = TASK_ARCS) -> DataFrame:
    """node_id, component: the smallest node that reaches this one and is reached by it.

    A weak component of at most ``most`` arcs is searched in one task, many small ones at once. Larger ones go through rounds of colouring: each
    node takes the smallest node that reaches it; the nodes of that colour that reach the colour's own node are a
    component and leave.
    """
    python_ready(edges.sparkSession)
    arcs = staged(edges.select("source", "target").distinct(), "arcs")
    nodes = arcs.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    weak = components(arcs.select(F.col("source").alias("a"), F.col("target").alias("b")), True).select(F.col("node").alias("source"), "root")
    x = staged(arcs.where("source <> target").join(weak, "source"), "arcs")
    large = staged(x.groupBy("root").count().where(F.col("count") > most).select("root"), "large")
    small = x.join(F.broadcast(large) if within_bound(large) else large, "root", "left_anti")
    found = [staged(in_whole_groups(small, _strong, "node_id long, component long"), "strong")]
    if not large.isEmpty():
        found.append(_by_colours(x.join(large, "root", "left_semi").select("source", "target")))
    found = reduce(DataFrame.unionByName, found)
    alone = nodes.join(found, nodes["node"] == found["node_id"], "left_anti").select(F.col("node").alias("node_id"), F.col("node").alias("component"))
    return found.unionByName(alone)


def _by_colours(arcs: DataFrame) -> DataFrame:
    arcs = staged(arcs, "arcs")
    nodes = staged(arcs.select(F.explode(F.array("source", "target")).alias("node")).distinct(), "nodes")
    found = []
    while not nodes.isEmpty():
        color = _spread_least(nodes.select("node", F.col("node").alias("c")), arcs)
        same = color.select(F.col("node").alias("source"), F.col("c").alias("cs"))
        within = arcs.join(same, "source").join(color.select(F.col("node").alias("target"), F.col("c").alias("ct")), "target").where("cs = ct")
        back = _reaching(color.where("node = c").select("node"), staged(within.select("source", "target"), "within"))
        found.append(staged(back.join(color, "node").select(F.col("node").alias("node_id"), F.col("c").alias("component")), "done"))
        gone = found[-1].select(F.col("node_id").alias("node"))
        nodes = staged(nodes.join(gone, "node", "left_anti"), "nodes")
        for side in ("source", "target"):
            arcs = arcs.join(gone.withColumnRenamed("node", side), side, "left_anti")
        arcs = staged(arcs, "arcs")
    return reduce(DataFrame.unionByName, found)


def _spread_least(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, c): the smallest label of the nodes that reach a node; only improved labels go on."""
    best = new = staged(labels, "labels")
    while not new.isEmpty():
        offered = new.join(arcs, new["node"] == arcs["source"]).groupBy("target").agg(F.min("c").alias("o"))
        x = staged(best.join(offered, best["node"] == offered["target"], "left").select("node", F.least("c", "o").alias("c"), F.coalesce(F.col("o") < F.col("c"), F.lit(False)).alias("fresh")), "labels")
        best, new = x.drop("fresh"), x.where("fresh").drop("fresh")
    return best


def _reaching(ends: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node): the nodes that reach one of ``ends``."""
    known = new = staged(ends, "reaching")
    while not new.isEmpty():
        new = staged(arcs.join(new.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node")).distinct().join(known, "node", "left_anti"), "reaching")
        known = known.unionByName(new)
    return known


def by_size(components_: DataFrame) -> DataFrame:
    """node_id, component, label: 0 for the component of most nodes, ties to the smaller component."""
    sizes = components_.groupBy("component").agg(F.count("*").alias("size"))
    ranked = sizes.withColumn("label", F.row_number().over(W.orderBy(F.desc("size"), "component")) - 1)  # a row a component
    return components_.join(ranked.select("component", "label"), "component").select("node_id", "component", "label")


def largest_component(edges: DataFrame, strong: bool = False) -> DataFrame:
    """The edges within the component of most nodes."""
    of = strong_components(edges) if strong else weak_components(edges)
    first = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    keep = of.join(first, "component", "left_semi")
    for side in ("source", "target"):
        edges = edges.join(keep.select(F.col("node_id").alias(side)), side, "left_semi")
    return edges


def reach(edges: DataFrame, origins: DataFrame, limit_s: float, several: int = 8) -> DataFrame:
    """origin, node_id, cost_s of the cheapest path within the limit: relaxation from a frontier until nothing gets cheaper.

    Costs are not negative, so it ends, however many arcs the paths have. The first ``several`` staged rounds relax once;
    paths longer than that take ``several`` relaxations a round, in which each node also keeps its own cost.
    """
    arcs = staged(edges.groupBy("source", "target").agg(F.min(F.col("cost_s").cast("double")).alias("c")), "arcs")
    stay = arcs.select(F.explode(F.array("source", "target")).alias("source")).distinct().select("source", F.col("source").alias("target"), F.lit(0.0).alias("c"))
    or_stay = None
    best = staged(origins.select(F.col("node_id").alias("origin"), "node_id", F.lit(0.0).alias("cost_s")).distinct(), "reach")
    new, done = best, 0
    while not new.isEmpty():
        if done == several:
            or_stay = staged(arcs.unionByName(stay), "arcs")
        for _ in range(1 if or_stay is None else several):
            by = arcs if or_stay is None else or_stay
            new = new.join(by, new["node_id"] == by["source"]).select("origin", F.col("target").alias("node_id"), (F.col("cost_s") + F.col("c")).alias("cost_s")).where(F.col("cost_s") <= limit_s)
            new = new.groupBy("origin", "node_id").agg(F.min("cost_s").alias("cost_s"))
        known = best.join(new.withColumnRenamed("cost_s", "new_s"), ["origin", "node_id"], "full")
        known = staged(known.select("origin", "node_id", F.least("cost_s", "new_s").alias("cost_s"), F.coalesce(F.col("new_s") < F.col("cost_s"), F.col("cost_s").isNull()).alias("fresh")), "reach")
        best, new = known.drop("fresh"), known.where("fresh").drop("fresh")
        done += 1
    return best


def accessibility(edges: DataFrame, origins: DataFrame, limit_s: float, digits: int = 3) -> DataFrame:
    """origin, n_reached, farthest_s; the seconds are rounded once, as a value rounded again may end on the other side of a half."""
    return reach(edges, origins, limit_s).groupBy("origin").agg((F.count("*") - 1).alias("n_reached"), F.round(F.max("cost_s"), digits).alias("farthest_s"))


def missing_runs(keys: DataFrame) -> DataFrame:
    """owner, first, last: runs of consecutive numbers (gaps and islands) of (owner, k)."""
    island = F.col("k") - F.row_number().over(W.partitionBy("owner").orderBy("k"))
    return keys.distinct().withColumn("island", island).groupBy("owner", "island").agg(F.min("k").alias("first"), F.max("k").alias("last")).drop("island")


def difference(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change, columns: rows added, removed, or changed, with the names of the columns that differ."""
    a, b = old.select(key, F.struct(*columns).alias("o")), new.select(key, F.struct(*columns).alias("n"))
    x = a.join(b, key, "full")
    names = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), c) for c in columns])), ",")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return x.select(key, change.alias("change"), F.when(change == "changed", names).otherwise("").alias("columns")).where((F.col("change") != "changed") | (F.col("columns") != ""))


def checks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, bad, total: ids are unique, ends exist, costs are positive."""
    ids = edges.groupBy("edge_id").count().agg(F.lit("unique_edge_id").alias("name"), F.count_if(F.expr("count > 1")).alias("bad"), F.count("*").alias("total"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("osm_id")).distinct()
    known = ends.join(grown(nodes.select("osm_id", F.lit(True).alias("ok")).distinct()), "osm_id", "left").agg(F.lit("ends_exist").alias("name"), F.count_if(F.expr("ok is null")).alias("bad"), F.count("*").alias("total"))
    costs = edges.agg(F.lit("positive_cost").alias("name"), F.count_if(F.expr("cost_s <= 0")).alias("bad"), F.count("*").alias("total"))
    return ids.unionByName(known).unionByName(costs)


def nearest(points: DataFrame, nodes: DataFrame, cell: float = 0.002) -> DataFrame:
    """point_id, node_id, distance_m: the nearest node of each point, ties to the smaller id.

    Equi-joins on grid cells: a point looks into the four cells whose common corner is nearest to it. A node in another
    cell is at least half a cell away, so points whose best node is nearer than that are done; the others are joined again
    with cells of twice the size, from half of ``cell`` on. Only points without coordinates, or a table without nodes,
    leave points out.
    """
    from roadloom.functions.geo import haversine

    real = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in cs])
    n = nodes.where(real("lon", "lat")).select(F.col("osm_id").alias("node_id"), F.explode(F.when(F.abs("lon") > 90, F.array("lon", F.col("lon") - 360 * F.signum("lon"))).otherwise(F.array("lon"))).alias("lon"), "lat")
    left = points.where(real("x", "y")).select("point_id", "x", "y")
    around = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (0, 1) for j in (0, 1)])
    d = F.round(haversine(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")), 3)
    found, cell = [], cell / 2
    while True:
        at = lambda c, before=0.0, cell=cell: F.floor(F.col(c) / cell - before).cast("long")
        p = left.withColumn("d", F.explode(around)).select("point_id", "x", "y", (at("x", 0.5) + F.col("d.i")).alias("cx"), (at("y", 0.5) + F.col("d.j")).alias("cy"))
        x = grown(p).join(n.withColumn("cx", at("lon")).withColumn("cy", at("lat")), ["cx", "cy"], "left")
        x = x.groupBy("point_id", "x", "y").agg(F.min(F.when(F.col("node_id").isNotNull(), F.struct(d.alias("d"), F.col("node_id")))).alias("best"))
        half_cell = 6371000.0 * F.asin(F.cos(F.radians("y")) * F.sin(F.radians(F.lit(min(cell / 2, 90.0)))))
        done = F.lit(True) if cell > 720 else F.coalesce(F.col("best.d") < half_cell - 0.001, F.lit(False))
        x = staged(x.withColumn("done", done), "nearest")
        found.append(x.where("done and best is not null"))
        left = x.where("not done").select("point_id", "x", "y")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found).select("point_id", F.col("best.node_id").alias("node_id"), F.col("best.d").alias("distance_m"))
        cell *= 2


def time_bins(rows: DataFrame, every: str = "1 hour", value: Column | None = None) -> DataFrame:
    """edge_id, bin, n, mean: counts and means by edge and time bin."""
    return rows.groupBy("edge_id", F.window("time", every)["start"].alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
