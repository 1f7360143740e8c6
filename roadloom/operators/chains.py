"""Chains of arcs that are the same road become one arc.

A node inside a chain has two arcs that agree in every attribute and, on one-way roads, one that comes and one that
goes. Arcs that share such a node are linked; the components of the links are the chains, each of which is put together
in one task: a chain is as long as a road without a junction.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import line_length
from roadloom.functions.hashing import with_edge_id
from roadloom.operators.components import components
from roadloom.staging import python_ready, staged

SAME = ("highway", "name", "oneway", "maxspeed", "lanes_fwd", "surface", "access", "junction", "layer", "bridge", "tunnel", "service")


def inner_nodes(arcs: DataFrame) -> DataFrame:
    """node, of the nodes inside chains. One aggregate: two arcs, and the smallest and largest of their attributes are equal."""
    same = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")).alias(c) for c in SAME])
    ends = F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("out")), F.struct(F.col("target").alias("node"), F.lit(0).alias("out")))
    x = arcs.select(F.explode(ends).alias("e"), same.alias("same"), "oneway")
    x = x.groupBy("e.node").agg(F.count("*").alias("n"), F.sum("e.out").alias("out"), F.min("same").alias("low"), F.max("same").alias("high"), F.bool_or("oneway").alias("oneway"))
    return x.where("n = 2 and node > 0 and low = high and (not oneway or out = 1)").select("node")


def _stitched(group: pd.DataFrame) -> pd.DataFrame:
    """The arcs of a chain (arc, source, target, oneway, inner nodes at its ends) in order: nothing for rings and chains that end where they start."""
    empty = pd.DataFrame({"chain": [], "nth": [], "arc": [], "along": []}).astype({"chain": "int64", "nth": "int32", "arc": "int64", "along": "bool"})
    at: dict[int, list[int]] = {}
    rows = list(group[["arc", "source", "target", "source_in", "target_in"]].itertuples(index=False, name=None))
    for k, (_, s, t, _, _) in enumerate(rows):
        at.setdefault(s, []).append(k)
        at.setdefault(t, []).append(k)
    outer = [(k, s if not si else t) for k, (_, s, t, si, ti) in enumerate(rows) if si != ti]
    if len(outer) != 2 or outer[0][1] == outer[1][1]:
        return empty
    oneway = bool(group["oneway"].iloc[0])
    # one-way roads start where the first arc is left along its direction, others at the smaller node
    start = next((o for o in outer if rows[o[0]][1] == o[1]), outer[0]) if oneway else min(outer, key=lambda o: o[1])
    out, (k, node), seen = [], start, set()
    while True:
        seen.add(k)
        arc, s, t, _, _ = rows[k]
        along = s == node
        out.append((rows[start[0]][0], len(out), arc, along))
        node = t if along else s
        more = [j for j in at[node] if j not in seen]
        if not more or len(out) == len(rows):
            break
        k = more[0]
    return pd.DataFrame(out, columns=["chain", "nth", "arc", "along"]).astype({"chain": "int64", "nth": "int32", "arc": "int64", "along": "bool"}) if len(out) > 1 else empty


def contract(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs with chains merged, edge_id_map of old_edge_id, new_edge_id, seq, is_reverse, osm_id).

    A merged arc keeps the way and attributes of its first member; its line and length are put together again.
    """
    python_ready(arcs.sparkSession)
    x = staged(arcs.withColumn("arc", F.xxhash64("osm_id", "source", "target", F.array_join(F.col("refs").cast("array<string>"), ","))), "arcs")
    inner = staged(inner_nodes(x), "inner")
    ends = x.select("arc", F.explode(F.array("source", "target")).alias("node")).join(inner, "node")
    links = ends.groupBy("node").agg(F.min("arc").alias("a"), F.max("arc").alias("b")).where("a <> b")
    of = components(links.select("a", "b")).select(F.col("node").alias("arc"), F.col("root").alias("component"))
    inside = lambda side: inner.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_in"))
    members = x.select("arc", "source", "target", "oneway").join(of, "arc").join(inside("source"), "source", "left").join(inside("target"), "target", "left")
    members = members.select("component", "arc", "source", "target", "oneway", F.coalesce("source_in", F.lit(False)).alias("source_in"), F.coalesce("target_in", F.lit(False)).alias("target_in"))
    chains = staged(members.groupBy("component").applyInPandas(_stitched, "chain long, nth int, arc long, along boolean"), "chains")
    turn = lambda c: F.when(F.col("along"), F.col(c)).otherwise(F.reverse(c))
    parts = chains.join(x.select("arc", "osm_id", "source", "target", "refs", "geometry", "oneway"), "arc")
    part = F.struct("nth", turn("refs").alias("refs"), turn("geometry").alias("geometry"))
    lines = parts.groupBy("chain").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = lambda c: F.aggregate(F.slice("parts", F.lit(2), F.size("parts") - 1), F.get("parts", F.lit(0))[c], lambda s, p: F.concat(s, F.slice(p[c], F.lit(2), F.size(p[c]) - 1)))
    lines = lines.select("chain", joined("refs").alias("new_refs"), joined("geometry").alias("new_geometry"))
    merged = x.join(lines, F.col("arc") == F.col("chain")).withColumns({"refs": F.col("new_refs"), "geometry": F.col("new_geometry")})
    merged = merged.withColumns({"source": F.element_at("refs", 1), "target": F.element_at("refs", -1), "length_m": line_length(F.col("geometry")).cast("float")}).drop("chain", "new_refs", "new_geometry")
    out = x.join(chains.select("arc"), "arc", "left_anti").unionByName(merged.select(*x.columns)).drop("arc")
    ends = lambda a, b: {"source": F.when(F.col("along"), F.col(a)).otherwise(F.col(b)), "target": F.when(F.col("along"), F.col(b)).otherwise(F.col(a))}
    old = parts.select("chain", (F.col("nth") + 1).alias("seq"), "along", "oneway", "osm_id", *[c.alias(k) for k, c in ends("source", "target").items()])
    new = merged.select(F.col("arc").alias("chain"), F.col("osm_id").alias("new_osm"), F.col("source").alias("a"), F.col("target").alias("b"))
    both = F.explode(F.when(F.col("oneway"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    m = old.join(new, "chain").withColumn("back", both)
    flip = lambda a, b: F.when(F.col("back"), F.col(b)).otherwise(F.col(a))
    m = m.withColumns({"s": flip("source", "target"), "t": flip("target", "source"), "na": flip("a", "b"), "nb": flip("b", "a")})
    m = with_edge_id(m.select("seq", (F.col("along") == F.col("back")).alias("is_reverse"), "osm_id", F.col("s").alias("source"), F.col("t").alias("target"), "new_osm", "na", "nb"), "old_edge_id")
    m = with_edge_id(m.select("old_edge_id", "seq", "is_reverse", F.col("osm_id").alias("way"), F.col("new_osm").alias("osm_id"), F.col("na").alias("source"), F.col("nb").alias("target")), "new_edge_id")
    return out, m.select("old_edge_id", "new_edge_id", "seq", "is_reverse", F.col("way").alias("osm_id"))
