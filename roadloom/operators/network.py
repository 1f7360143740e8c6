"""From ways to a directed network: junctions, segments, arcs, edges with ids, lengths, speeds and costs, and legal turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from roadloom.functions.geo import line_length
from roadloom.functions.hashing import with_edge_id
from roadloom.functions.tags import is_in, spread, tag
from roadloom.operators.splits import split_all, split_antiparallel, split_loops, split_parallel
from roadloom.operators.ways import CARRIED, PATHS, TAGS, shared_street
from roadloom.staging import grown, staged

# km/h by class.
SPEEDS = {
    "motorway": 110, "motorway_link": 110, "trunk": 90, "trunk_link": 90, "primary": 70, "primary_link": 70, "secondary": 60, "secondary_link": 60,
    "tertiary": 50, "tertiary_link": 50, "residential": 30, "living_street": 20, "service": 20, "unclassified": 40, "road": 40,
}
USUAL_SPEED = {"driving": 50.0, "walking": 5.0, "cycling": 15.0}
MPH = 1.60934
UNBUILT = ("proposed", "construction", "abandoned", "razed", "disused")
EDGE = ("osm_id", "highway", "name", "maxspeed", "oneway", "access", *CARRIED)


def global_junctions(raw_ways: DataFrame) -> DataFrame:
    """node_id, is_road_junction: nodes where built ways of any mode meet, and the ends of roads."""
    road = ~is_in(tag("highway"), PATHS) | shared_street()
    built = spread(raw_ways, TAGS).where(tag("highway").isNotNull() & ~is_in(tag("highway"), UNBUILT))
    at = built.select(road.alias("road"), F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node_id"))
    ends = F.col("road") & ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1))
    uses = at.groupBy("node_id").agg(F.count("*").alias("ways"), F.count_if("road").alias("roads"), F.count_if(ends).alias("ends"))
    return uses.where("ways > 1 or ends > 0").select("node_id", (F.col("roads") > 0).alias("is_road_junction"))


def local_junctions(ways: DataFrame) -> DataFrame:
    """node_id, is_road_junction of the nodes that a mode's ways share or end at, without regard to other modes."""
    at = ways.select((~is_in(F.col("highway"), PATHS)).alias("road"), F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node_id"))
    end = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    uses = at.groupBy("node_id").agg(F.count("*").alias("uses"), F.count_if(end).alias("ends"), F.count_if(end & F.col("road")).alias("road_ends"))
    return uses.where("uses > 1 or ends > 0").select("node_id", F.expr("uses > 1 or road_ends > 0").alias("is_road_junction"))


def segments(ways: DataFrame, nodes: DataFrame, junctions: DataFrame | None = None) -> DataFrame:
    """osm_id, seq, source, target, refs, geometry, place, nth, tangled and the ways' attributes: each way cut at junctions.

    Roads are cut at road junctions, paths wherever ways meet; without ``junctions`` at those of the mode itself.
    References meet the junctions and coordinates once, by node; all else is done inside each way's row: the cut, the
    segment's number in order of travel, and whether some segments are loops or join the same nodes (``tangled``).
    """
    road = ~is_in(F.col("highway"), PATHS)
    place = nodes.select(F.col("osm_id").alias("node_id"), "lon", "lat")
    if junctions is None:
        junctions = local_junctions(ways)
    place = grown(place).join(junctions.select("node_id", "is_road_junction"), "node_id", "left")
    at = ways.select("osm_id", road.alias("road"), F.posexplode("refs").alias("pos", "node_id"))
    at = grown(at).join(place, "node_id")
    shared = F.count("*").over(W.partitionBy("node_id")) > 1
    cut = F.when(F.col("road"), F.coalesce("is_road_junction", F.lit(False))).otherwise(F.col("is_road_junction").isNotNull() | shared)
    at = at.select("osm_id", F.struct("pos", "node_id", "lon", "lat", cut.alias("cut")).alias("p"))
    rows = at.groupBy("osm_id").agg(F.sort_array(F.collect_list("p")).alias("points")).where(F.size("points") > 1)
    rows = grown(rows).join(ways.drop("refs"), "osm_id")
    last = F.size("points") - 1
    rows = rows.withColumn("cuts", F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (i == last) | F.get("points", i)["cut"]))
    drawn = F.col("points.node_id")
    rows = rows.withColumn("drawn", F.when(F.col("against"), F.reverse(drawn)).otherwise(drawn))
    node = lambda k: F.get("points", F.get("cuts", k))["node_id"]
    ends = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.struct(F.array_position("drawn", node(k - 1)).cast("int").alias("place"), node(k - 1).alias("source"), node(k).alias("target"), k.alias("k")))
    rows = rows.withColumn("ends", ends)
    pairs = F.transform("ends", lambda e: F.struct(F.least(e["source"], e["target"]), F.greatest(e["source"], e["target"])))
    tangled = F.exists("ends", lambda e: e["source"] == e["target"]) | (F.size(F.array_distinct(pairs)) < F.size("ends"))
    order = F.sort_array(F.transform("ends", lambda e: F.struct(e["place"], e["source"], e["target"])))
    rows = rows.withColumns({"tangled": tangled, "order": order})
    x = rows.select("*", F.explode("ends").alias("e")).drop("ends")
    part = F.slice("points", F.get("cuts", F.col("e.k") - 1) + 1, F.get("cuts", F.col("e.k")) - F.get("cuts", F.col("e.k") - 1) + 1)
    nth = F.array_position("order", F.struct("e.place", "e.source", "e.target")).cast("int")
    x = x.select("*", part.alias("part"), nth.alias("nth"))
    return x.select(
        "osm_id", (F.col("e.k") - 1).alias("seq"), "e.source", "e.target", "e.place", "nth", "tangled", F.col("part.node_id").alias("refs"),
        F.arrays_zip("part.lon", "part.lat").alias("geometry"), *[c for c in ways.columns if c not in ("osm_id", "refs", "against")],
    )


def speed(mode: str) -> Column:
    """km/h from maxspeed (a number, or miles an hour), else by class; fixed for walking and cycling, and on foot where a bicycle is pushed."""
    if mode != "driving":
        return F.lit(USUAL_SPEED[mode]).cast("float")
    by_class = F.coalesce(F.create_map(*[F.lit(v) for k, kmh in SPEEDS.items() for v in (k, float(kmh))])[F.col("highway")], F.lit(USUAL_SPEED[mode]))
    miles = F.when(F.col("maxspeed").contains("mph"), F.nullif(F.regexp_extract("maxspeed", r"(\d+)", 1), F.lit("")).try_cast("double") * MPH)
    number = F.regexp_replace(F.trim("maxspeed"), "(?<=[0-9])_(?=[0-9])", "").try_cast("double")
    return F.coalesce(number, miles, by_class).cast("float")


def cost_seconds() -> Column:
    """Seconds in single precision, each step rounded to it."""
    kmh = F.when(F.col("maxspeed_kmh") <= 0, F.lit(USUAL_SPEED["driving"])).otherwise(F.col("maxspeed_kmh")).cast("float")
    km = (F.col("length_m") / F.lit(1000).cast("float")).cast("float")
    return ((km / kmh).cast("float") * F.lit(3600).cast("float")).cast("float")


def forward_arcs(segs: DataFrame) -> DataFrame:
    """Segments with their length and whether they have an edge back (``twin``); an arc without extent is none."""
    x = segs.withColumns({"length_m": line_length(F.col("geometry")).cast("float"), "twin": ~F.col("oneway") | F.col("bus_back")})
    return x.where((F.col("source") != F.col("target")) | (F.size(F.array_distinct("geometry")) > 1)).drop("seq", "bus_back")


def directed_edges(arcs: DataFrame, mode: str) -> DataFrame:
    """An edge for each arc, and one back where it has a twin, with ids, speed and cost."""
    own = line_length(F.col("geometry"))
    off = F.abs(F.col("length_m").cast("double") / own.cast("float").cast("double") - 1) > 0.001
    cut = (F.col("source") < 0) | (F.col("target") < 0)
    x = arcs.withColumn("length_m", F.when(cut & (own > 0) & off, own.cast("float")).otherwise(F.col("length_m")))
    x = x.withColumn("maxspeed_kmh", speed(mode)).withColumn("cost_s", cost_seconds())
    x = x.withColumn("is_reverse", F.explode(F.when(F.col("twin"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    pick = lambda a, b: F.when(F.col("is_reverse"), F.col(b)).otherwise(F.col(a))
    ref = F.concat(F.col("osm_id").cast("string"), F.lit("#"), F.col("nth").cast("string"), F.when(F.col("is_reverse"), "r").otherwise("f"))
    x = x.select(
        ref.alias("edge_ref"), pick("source", "target").alias("source"), pick("target", "source").alias("target"), *[c for c in EDGE if c != "access"],
        F.when(F.col("is_reverse") & F.col("oneway"), "bus").otherwise(F.col("access")).alias("access"), pick("lanes_fwd", "lanes_bwd").alias("lanes"),
        F.when(F.col("is_reverse"), F.reverse("refs")).otherwise(F.col("refs")).alias("refs"), F.when(F.col("is_reverse"), F.reverse("geometry")).otherwise(F.col("geometry")).alias("geometry"),
        "is_reverse", "length_m", "maxspeed_kmh", "cost_s",
    )
    return with_edge_id(x)


def checked_ids(edges: DataFrame) -> DataFrame:
    """``edges``, staged; an error if two share an id."""
    again = edges.groupBy("edge_id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"edge id {again[0]['edge_id']} is not unique: parallel arcs were left whole")
    return edges


RESTRICTED = ("private", "bus", "pedestrian", "delivery")


def open_edges(edges: DataFrame) -> DataFrame:
    return edges.where(~is_in(F.col("access"), RESTRICTED))


def private_split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges open to all, and those with a restricted label."""
    return open_edges(edges), edges.where(is_in(F.col("access"), RESTRICTED))


def node_table(edges: DataFrame) -> DataFrame:
    """node_id, lon, lat of the ends of edges, virtual ones included: an edge's line starts at its source."""
    first = F.get("geometry", F.lit(0))
    last = F.element_at("geometry", -1)
    ends = F.array(F.struct(F.col("source").alias("node_id"), first.alias("p")), F.struct(F.col("target").alias("node_id"), last.alias("p")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.node_id").agg(F.min("e.p").alias("p")).select("node_id", "p.lon", "p.lat")


def edge_graph(edges: DataFrame, uses: str = "car") -> DataFrame:
    """The line graph: from_edge, to_edge, via_edge, cost, uses. Turns with a restricted edge carry its label; two labels must agree."""
    label = F.when(is_in(F.col("access"), RESTRICTED), F.col("access"))
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("target").alias("at"), F.col("cost_s").alias("cost"), label.alias("la"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("source").alias("at"), label.alias("lb"))
    x = a.join(b, "at").where((F.col("from_edge") != F.col("to_edge")) & (F.col("la").isNull() | F.col("lb").isNull() | (F.col("la") == F.col("lb"))))
    return x.select("from_edge", "to_edge", F.col("to_edge").alias("via_edge"), "cost", F.coalesce("la", "lb", F.lit(uses)).alias("uses"))


def in_order(arcs: DataFrame) -> DataFrame:
    """``arcs`` with ``nth``: their number in order of travel in their way, virtual sources last."""
    return arcs.withColumn("nth", F.dense_rank().over(W.partitionBy("osm_id").orderBy("place", "source", "target")))


def build_arcs(raw_nodes: DataFrame, ways: DataFrame, junctions: DataFrame | None) -> DataFrame:
    """Forward arcs of a mode's ways, loops and parallel arcs cut. Only tangled ways, few of all, go through the cuts."""
    arcs = staged(forward_arcs(segments(ways, raw_nodes, junctions)), "arcs")
    tangled = in_order(split_all(arcs.where("tangled").drop("nth")))
    return arcs.where("not tangled").unionByName(tangled).drop("tangled")


def plain_arcs(raw_nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Arcs cut at the mode's own junctions, loops cut: what chains are made of."""
    return split_loops(forward_arcs(segments(ways, raw_nodes)).drop("nth", "tangled"))


def split_parallels(arcs: DataFrame) -> DataFrame:
    return split_antiparallel(split_parallel(arcs))


def build(raw_nodes: DataFrame, ways: DataFrame, junctions: DataFrame | None, mode: str) -> DataFrame:
    """The edges of a mode's ways, restricted ones included (``access`` private, bus, pedestrian, delivery), staged."""
    return checked_ids(staged(directed_edges(build_arcs(raw_nodes, ways, junctions), mode), f"{mode}_edges"))
