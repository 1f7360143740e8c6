"""What kind of walking and cycling an edge offers, where a bicycle is pushed, and connectors of loose path ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from roadloom.functions.hashing import with_edge_id
from roadloom.functions.tags import is_in, tag
from roadloom.operators.network import cost_seconds, node_table
from roadloom.operators.ways import ALLOWED
from roadloom.staging import staged

# Classes that share the road with cars, rough ways, ways that dangle.
SHARED_ROADS = (
    "residential", "service", "unclassified", "road", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary",
    "primary_link", "trunk", "trunk_link",
)
ROUGH = ("path", "track", "bridleway")
LOOSE = ("cycleway", "footway", "path", "steps", "pedestrian", "track")
TYPE_TAGS = ("footway", "conveying", "area", "indoor", "cycleway:left", "cycleway:right", "cycleway:both", "segregated")
SNAP_M = 10.0
METRES = 111_320.0  # of a degree


def walk_type() -> Column:
    """The kind of walking, from an edge's class and its way's tags (null where an edge has no way)."""
    road, extra = F.col("highway"), tag("footway")
    beside = ~F.coalesce(tag("sidewalk"), F.lit("no")).isin("no", "none", "separate") & ~is_in(road, (*ROUGH, "corridor", "platform"))
    return (
        F.when((road == "steps") & tag("conveying").isNotNull(), "escalator").when(road == "steps", "steps")
        .when((road == "footway") & (extra == "sidewalk"), "sidewalk").when((road == "footway") & (extra == "crossing"), "crossing").when(road == "footway", "footpath")
        .when((road == "pedestrian") & (tag("area") == "yes"), "plaza").when(road == "pedestrian", "pedestrian_street").when(road == "living_street", "shared_street")
        .when(beside, "sidewalk").when(is_in(road, SHARED_ROADS), "shared_road").when((road == "corridor") | is_in(tag("indoor"), ("yes",)), "corridor")
        .when(road == "platform", "platform").when(is_in(road, ROUGH), "path").otherwise("footpath")
    )


def cycle_type() -> Column:
    """The kind of cycling, by the cycleway on the side of travel."""
    road = F.col("highway")
    side = F.coalesce(F.when(F.col("is_reverse"), tag("cycleway:left")).otherwise(tag("cycleway:right")), tag("cycleway:both"), tag("cycleway"))
    return (
        F.when(F.col("dismount"), "dismount").when(road == "cycleway", "cycleway").when(side == "track", "cycle_track").when(side == "lane", "cycle_lane")
        .when(side == "shared_lane", "shared_lane").when(side == "share_busway", "bus_cycle_lane")
        .when(is_in(road, ROUGH) & (tag("segregated") == "yes"), "segregated_path").when(is_in(road, ROUGH), "shared_path").otherwise("mixed_traffic")
    )


def pushed() -> Column:
    """Whether a bicycle is pushed on an edge: a footway or pedestrian street that does not admit it. Needs the way's tags."""
    return is_in(F.col("highway"), ("footway", "pedestrian")) & ~is_in(tag("bicycle"), ALLOWED) & F.col("osm_id").isNotNull()


def with_types(edges: DataFrame, tags: DataFrame, mode: str) -> DataFrame:
    """``edges`` with walk_type, or with dismount and cycle_type, and the speed and cost of pushing. ``tags``: the ways' tag columns."""
    x = edges.join(tags.select(F.col("osm_id").alias("way"), *[f"`{c}`" for c in tags.columns if c.startswith("tag:")]), F.col("osm_id") == F.col("way"), "left")
    if mode == "walking":
        x = x.withColumn("walk_type", walk_type())
    else:
        paths = x.where(is_in(F.col("highway"), ("footway", "pedestrian"))).withColumn("p", pushed() & F.col("way").isNotNull())
        paths = staged(paths.select("edge_id", "osm_id", "highway", "source", "target", "p"), "paths")
        ends = paths.where("p").select(F.col("highway").alias("like"), F.explode(F.array("source", "target")).alias("end")).distinct()
        stubs = paths.where("osm_id < 0").select("edge_id", "highway", F.explode(F.array("source", "target")).alias("end"))
        beside = stubs.join(ends, (stubs["end"] == ends["end"]) & (stubs["highway"] == ends["like"]), "left_semi").select("edge_id")
        walked = paths.where("p").select("edge_id").union(beside).distinct().select(F.col("edge_id").alias("walked"))
        x = x.join(walked, F.col("edge_id") == F.col("walked"), "left").withColumn("dismount", F.col("walked").isNotNull()).drop("walked")
        x = x.withColumn("maxspeed_kmh", F.when(F.col("dismount"), F.lit(5.0).cast("float")).otherwise(F.col("maxspeed_kmh"))).withColumn("cost_s", cost_seconds())
        x = x.withColumn("cycle_type", cycle_type())
    return x.drop("way", *[c for c in x.columns if c.startswith("tag:")])


def connectors(edges: DataFrame, snap_m: float = SNAP_M) -> DataFrame:
    """Edges both ways between a loose end of a path and the nearest node within ``snap_m``, other than its own.

    Points meet in an equi-join on cells a little wider than the radius.
    """
    pair = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min("osm_id").alias("way"), F.min("highway").alias("class"))
    ends = pair.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"), "way", "class")
    per = ends.groupBy("e.node").agg(F.count("*").alias("n"), F.min("e.other").alias("other"), F.min("way").alias("way"), F.min("class").alias("class"))
    nodes = per.join(node_table(edges).withColumnRenamed("node_id", "node"), "node")
    wide = snap_m / METRES * 1.01
    cell = lambda c, size: F.floor(c / size).cast("long")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    loose = nodes.where((F.col("n") == 1) & F.col("class").isin(*LOOSE)).withColumn("dy", around).withColumn("cy", cell(F.col("lat"), wide) + F.col("dy"))
    near = nodes.select(F.col("node").alias("to"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("way").alias("to_way"), cell(F.col("lat"), wide).alias("cy"))
    # degrees of longitude are narrower towards the poles: the cell is that of the band's latitude nearest to the pole, in both tables alike
    widest = lambda: wide / F.greatest(F.cos(F.radians(F.least(F.lit(89.9), F.abs(F.col("cy") * wide) + 2 * wide))), F.lit(1e-6))
    loose = loose.withColumn("dx", around).withColumn("cx", cell(F.col("lon"), widest()) + F.col("dx"))
    x = loose.join(near.withColumn("cx", cell(F.col("x"), widest())), ["cx", "cy"]).where("to <> node and to <> other")
    metres = F.hypot((F.col("x") - F.col("lon")) * METRES * F.cos(F.radians("lat")), (F.col("y") - F.col("lat")) * METRES)
    x = x.withColumn("d", metres).where(F.col("d") <= snap_m).groupBy("node").agg(F.min(F.struct("d", "to", "to_way", "lon", "lat", "x", "y", "way", "class")).alias("m")).select("node", "m.*")
    first = W.partitionBy(F.least("node", "to"), F.greatest("node", "to")).orderBy("node")
    x = x.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    point = lambda lon, lat: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    x = x.select((-F.least("way", "to_way")).alias("osm_id"), F.col("node").alias("source"), F.col("to").alias("target"), F.col("class").alias("highway"), F.array("node", "to").alias("refs"),
                 F.array(point("lon", "lat"), point("x", "y")).alias("geometry"), F.round("d", 2).cast("float").alias("length_m"))
    x = x.withColumn("is_reverse", F.explode(F.array(F.lit(False), F.lit(True))))
    pick = lambda a, b: F.when(F.col("is_reverse"), b).otherwise(a)
    x = x.withColumns({"source": pick(F.col("source"), F.col("target")), "target": pick(F.col("target"), F.col("source")), "refs": pick(F.col("refs"), F.reverse("refs")), "geometry": pick(F.col("geometry"), F.reverse("geometry"))})
    ref = F.concat(F.col("osm_id").cast("string"), F.lit("#1"), F.when(F.col("is_reverse"), "r").otherwise("f"))
    return with_edge_id(x.withColumns({"edge_ref": ref, "oneway": F.lit(False)}))
