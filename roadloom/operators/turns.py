"""Turn rules: from restriction relations to bans on edges, paths of edges, and permissions of some vehicles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import turn_angle
from roadloom.staging import staged

RULE = ("restriction_id", "restriction_type", "except_vehicles", "applies_to", "condition")
MOST_VIA_EDGES = 6
BRIDGE_TURN = 90.0


def raw_rules(relations: DataFrame) -> DataFrame:
    """A row for each rule that a relation carries: for all, for one class of vehicles (``applies_to``) or under a condition, and its members."""
    kind, value = F.col("key"), F.col("value")
    conditional = kind == "restriction:conditional"
    x = relations.where(F.element_at("tags", F.lit("type")) == "restriction")
    members = F.arrays_zip("refs", "ref_roles", "ref_types").alias("members")
    x = x.select(F.col("osm_id").alias("restriction_id"), F.element_at("tags", F.lit("except")).alias("except_vehicles"), members, F.explode("tags"))
    x = x.where(((kind == "restriction") | (kind.startswith("restriction:") & ~kind.substr(13, 1000).contains(":"))) & value.isNotNull())
    when = F.regexp_replace(F.trim(F.split_part(value, F.lit("@"), F.lit(2))), r"^\(|\)$", "")
    return x.select(
        "restriction_id", F.trim(F.when(conditional, F.split_part(value, F.lit("@"), F.lit(1))).otherwise(value)).alias("restriction_type"), "except_vehicles",
        F.when(kind.startswith("restriction:") & ~conditional, kind.substr(13, 1000)).alias("applies_to"), F.when(conditional, F.trim(when)).alias("condition"), "members",
    )


def member(role: str, kind: str) -> Column:
    """The ids of a rule's members of a role and type, in order."""
    return F.transform(F.filter("members", lambda m: (m["ref_roles"] == role) & (m["ref_types"] == kind)), lambda m: m["refs"])


def end_ways(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """edge_id, source, target, way, side: the ways along an edge's first and last pair of references. A merged edge has several."""
    at = F.sequence(F.lit(1), F.size("refs") - 1)
    steps = ways.where(F.size("refs") > 1).select(F.col("osm_id").alias("way"), F.explode(F.transform(at, lambda i: F.struct(F.get("refs", i - 1).alias("a"), F.get("refs", i).alias("b")))).alias("p"))
    steps = steps.select("way", F.least("p.a", "p.b").alias("low"), F.greatest("p.a", "p.b").alias("high")).distinct()
    pair = lambda side, a, b: F.struct(F.lit(side).alias("side"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    first = pair("source", F.element_at("refs", 1), F.element_at("refs", 2))
    last = pair("target", F.element_at("refs", -2), F.element_at("refs", -1))
    x = edges.where(F.size("refs") > 1).select("edge_id", "source", "target", F.inline(F.array(first, last)))
    return x.join(steps, ["low", "high"]).select("edge_id", "source", "target", "way", "side")


def turn_restrictions(rules: DataFrame, ends: DataFrame) -> DataFrame:
    """Rules at a node, on edges: from_edge_id ends at via_node along the from way, to_edge_id starts there along the to way."""
    one = lambda role, kind: F.array_max(member(role, kind))
    r = rules.select(*RULE, one("from", "way").alias("from_way"), one("via", "node").alias("via_node"), one("to", "way").alias("to_way"))
    into = ends.where("side = 'target'").select(F.col("edge_id").alias("from_edge_id"), F.col("target").alias("via_node"), F.col("way").alias("from_way"))
    out = ends.where("side = 'source'").select(F.col("edge_id").alias("to_edge_id"), F.col("source").alias("via_node"), F.col("way").alias("to_way"))
    return r.join(into, ["via_node", "from_way"]).join(out, ["via_node", "to_way"]).select(*RULE, "via_node", "from_edge_id", "to_edge_id").distinct()


def path_restrictions(rules: DataFrame, ends: DataFrame, most: int = MOST_VIA_EDGES) -> DataFrame:
    """Rules by way, on edges: from_edge, via_edges, to_edge. The path follows edges of the via ways, never through a node twice."""
    r = rules.withColumns({"from_way": F.get(member("from", "way"), F.lit(0)), "via_ways": member("via", "way"), "to_ways": member("to", "way")})
    r = r.where(F.size("via_ways") > 0).drop("members").withColumn("rule", F.xxhash64(*RULE))
    into = ends.where("side = 'target'").select(F.col("edge_id").alias("from_edge"), F.col("target").alias("at"), F.col("way").alias("from_way"))
    start = r.select("rule", "from_way", "via_ways", "to_ways").join(into, "from_way")
    walk = start.select("rule", "via_ways", "to_ways", "from_edge", "at", F.array("at").alias("seen"), F.array().cast("array<bigint>").alias("path"))
    by_edge = ends.groupBy("edge_id", "source", "target").agg(F.collect_set("way").alias("ways"), F.collect_set(F.when(F.col("side") == "source", F.col("way"))).alias("first_ways"))
    step = staged(by_edge.select(F.col("edge_id").alias("next"), F.col("source").alias("at"), F.col("target").alias("then"), "ways", "first_ways"), "steps")
    found = []
    for n in range(most + 1):
        x = walk.join(step, "at")
        if n:
            done = x.where(F.arrays_overlap("first_ways", "to_ways"))
            found.append(done.select("rule", "from_edge", F.col("path").alias("via_edges"), F.col("next").alias("to_edge")))
        if n < most:
            x = x.where(F.arrays_overlap("ways", "via_ways") & ~F.array_contains("seen", F.col("then")))
            walk = staged(x.select("rule", "via_ways", "to_ways", "from_edge", F.col("then").alias("at"), F.array_append("seen", F.col("then")).alias("seen"), F.array_append("path", F.col("next")).alias("path")), "walk")
            if walk.isEmpty():
                break
    if not found:
        found = [walk.where("false").select("rule", "from_edge", F.col("path").alias("via_edges"), F.col("at").alias("to_edge"))]
    return reduce(DataFrame.unionByName, found).join(r.select("rule", *RULE), "rule").select(*RULE, "from_edge", "via_edges", "to_edge").distinct()


def banned(graph: DataFrame, restrictions: DataFrame) -> DataFrame:
    """The turns that each rule bans, with the rule: no_ the named one, only_ every other one from the same edge."""
    x = graph.select("from_edge", "to_edge").join(restrictions.drop("via_node"), F.col("from_edge") == F.col("from_edge_id"))
    no, only = F.col("restriction_type").like("no_%"), F.col("restriction_type").like("only_%")
    return x.where((no & (F.col("to_edge") == F.col("to_edge_id"))) | (only & (F.col("to_edge") != F.col("to_edge_id"))))


def turn_permission(bans: DataFrame) -> DataFrame:
    """What the graph does not say: banned turns that some vehicles may take, and open ones closed to some or at times."""
    for_all = F.col("applies_to").isNull() & F.col("condition").isNull()
    x = bans.where(~for_all | F.col("except_vehicles").isNotNull()).withColumn("allowed", for_all)
    return x.select(
        "from_edge", "to_edge", "allowed", F.when(for_all, F.col("except_vehicles")).otherwise(F.col("applies_to")).alias("vehicles"),
        F.when(~for_all, F.col("except_vehicles")).alias("except_vehicles"), F.when(~for_all, F.col("condition")).alias("condition"), "restriction_id",
    )


def without_banned(graph: DataFrame, bans: DataFrame) -> DataFrame:
    """The turns that no rule for all vehicles at all times bans."""
    return graph.join(bans.where("applies_to is null and condition is null").select("from_edge", "to_edge").distinct(), ["from_edge", "to_edge"], "left_anti")


def headings(edges: DataFrame) -> DataFrame:
    """edge_id, arriving, leaving: mathematical degrees of an edge's last and first segment, in metres at its latitude."""
    p = lambda i: F.element_at("geometry", i)
    angle = lambda a, b, at: F.degrees(F.atan2(b["lat"] - a["lat"], (b["lon"] - a["lon"]) * F.cos(F.radians(at["lat"]))))
    return edges.where(F.size("geometry") > 1).select("edge_id", angle(p(-2), p(-1), p(-1)).alias("arriving"), angle(p(1), p(2), p(1)).alias("leaving"))


def without_bridge_turnbacks(graph: DataFrame, edges: DataFrame, most: float = BRIDGE_TURN) -> DataFrame:
    """The turns without those between two bridge edges that turn by more than ``most`` degrees: a median stands there."""
    on_bridge = edges.where(~F.coalesce("bridge", F.lit("no")).isin("no", ""))
    h = headings(on_bridge)
    a = h.select(F.col("edge_id").alias("from_edge"), "arriving")
    b = h.select(F.col("edge_id").alias("to_edge"), "leaving")
    back = graph.select("from_edge", "to_edge").join(a, "from_edge").join(b, "to_edge").where(F.abs(turn_angle(F.col("leaving"), F.col("arriving"))) > most)
    return graph.join(back.select("from_edge", "to_edge"), ["from_edge", "to_edge"], "left_anti")
