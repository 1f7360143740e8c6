"""Parts of a network or of raw data inside a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]  # west, south, east, north


def inside(lon: Column, lat: Column, box: Box) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def clip_edges(edges: DataFrame, box: Box, rule: str = "within") -> DataFrame:
    """Edges whose points are all inside (``within``), some are (``touches``), or whose mean point is (``centroid``)."""
    point = lambda p: inside(p["lon"], p["lat"], box)
    mean = lambda c: F.aggregate(F.transform("geometry", lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / F.size("geometry")
    return edges.where({"within": F.forall("geometry", point), "touches": F.exists("geometry", point), "centroid": inside(mean("lon"), mean("lat"), box)}[rule])


def clip_turns(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """Turns whose edges are both still there."""
    for side in ("from_edge", "to_edge"):
        turns = turns.join(edges.select(F.col("edge_id").alias(side)), side, "left_semi")
    return turns


def cut_raw(nodes: DataFrame, ways: DataFrame, box: Box, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of a box. Ways with a node inside stay whole (``complete``), or keep their inside nodes only."""
    in_box = nodes.where(inside(F.col("lon"), F.col("lat"), box))
    at = ways.select("osm_id", F.posexplode("refs").alias("pos", "node"))
    at = at.join(in_box.select(F.col("osm_id").alias("node")), "node", "left_semi")
    if complete:
        kept = ways.join(at.select("osm_id").distinct(), "osm_id", "left_semi")
        needed = kept.select(F.explode("refs").alias("osm_id")).union(in_box.select("osm_id")).distinct()
        return nodes.join(needed, "osm_id", "left_semi"), kept
    refs = at.groupBy("osm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"]).alias("refs")).where(F.size("refs") > 1)
    return in_box, ways.drop("refs").join(refs, "osm_id").select(*ways.columns)
