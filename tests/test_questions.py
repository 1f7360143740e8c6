"""Paths, components, chains, rules and snapping on small tables, against plain searches."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from roadloom.api import Network
from roadloom.operators import analysis, chains, routing, snap, turns

ARCS = "source long, target long, cost_s double"


def test_ties_and_several_paths(spark):
    tie = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0), (4, 5, 1.0)], ARCS)
    pairs = spark.createDataFrame([(1, 4), (5, 1), (1, 1)], "origin long, destination long")
    assert {(r.origin, r.cost, tuple(r.path)) for r in routing.paths(tie, pairs, 99.0).collect()} == {(1, 2.0, (1, 2, 4)), (1, 0.0, (1,))}
    several = spark.createDataFrame([(1, 2, 1.0), (2, 4, 1.0), (1, 3, 1.0), (3, 4, 2.0), (1, 4, 5.0)], ARCS)
    got = routing.paths(several, pairs.where("destination = 4"), 99.0, 5).orderBy("rank").collect()
    assert [(r.rank, r.cost) for r in got] == [(1, 2.0), (2, 3.0), (3, 5.0)]
    assert {(r.destination, r.reached) for r in routing.has_path(tie, pairs).collect()} == {(4, True), (1, False), (1, True)}


def test_paths_against_all_paths():
    rng = random.Random(3)
    for _ in range(30):
        arcs = {}
        for u, v in permutations(range(6), 2):
            if rng.random() < 0.45:
                arcs.setdefault(u, []).append((v, float(rng.randint(1, 4))))
        cost = {(u, v): c for u, vs in arcs.items() for v, c in vs}
        every = sorted((sum(cost[a, b] for a, b in zip(p, p[1:], strict=False)), p) for n in range(5) for mid in permutations(range(1, 5), n) for p in [(0, *mid, 5)] if all((a, b) in cost for a, b in zip(p, p[1:], strict=False)))
        got = routing.k_paths(arcs, 0, 5, 4)
        assert [c for c, _ in got] == [c for c, _ in every[:4]] and all(g in every for g in got)


def test_components_against_reach(spark):
    rng = random.Random(5)
    arcs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    reach = {u: {u} for u in {x for a in arcs for x in a}}
    for _ in range(30):
        for u, v in arcs:
            for seen in reach.values():
                if u in seen:
                    seen.add(v)
    want = {u: min(v for v in reach[u] if u in reach[v]) for u in reach}
    edges = spark.createDataFrame(sorted(arcs), "source long, target long")
    for most in (1_000_000, 3):
        assert {r.node_id: r.component for r in analysis.strong_components(edges, most).collect()} == want
    assert analysis.strong_components(edges.where("false")).count() == 0
    labels = analysis.by_size(analysis.weak_components(edges))
    assert labels.where("label = 0").count() == labels.groupBy("component").count().agg(F.max("count")).first()[0]


def test_chains_merge(spark):
    names = "osm_id long, place int, source long, target long, twin boolean, refs array<long>, geometry array<struct<lon:double,lat:double>>, length_m float, oneway boolean, " + ", ".join(f"{c} string" for c in chains.SAME if c != "oneway") + ", lanes_bwd int"
    p = {k: (0.001 * k, 0.0) for k in range(60)}

    def arc(way, refs, oneway=False, speed="50"):
        same = ["residential", "a", speed, "1", *[None] * 7]
        return (way, 1, refs[0], refs[-1], not oneway, refs, [p[k] for k in refs], 1.0, oneway, *same, 1)

    rows = [arc(100, [1, 2]), arc(101, [3, 2]), arc(20, [10, 11]), arc(21, [11, 12], speed="30"), arc(30, [22, 21], True), arc(31, [21, 20], True), arc(40, [30, 31]), arc(41, [31, 30])]
    out, mapped = chains.contract(spark.createDataFrame(rows, names))
    got = {(r.osm_id, tuple(r.refs)) for r in out.collect()}
    assert got == {(100, (1, 2, 3)), (20, (10, 11)), (21, (11, 12)), (30, (22, 21, 20)), (40, (30, 31)), (41, (31, 30))}
    assert {(r.osm_id, r.seq, r.is_reverse) for r in mapped.collect()} == {(100, 1, False), (101, 2, True), (100, 1, True), (101, 2, False), (30, 1, False), (31, 2, False)}


def test_rules_of_relations(spark):
    shape = "osm_id long, tags map<string,string>, refs array<long>, ref_roles array<string>, ref_types array<string>"
    tags = {"type": "restriction", "restriction": "no_u_turn", "restriction:conditional": "no_left_turn @ (Mo-Fr 07:00-09:00)", "restriction:hgv": "only_straight_on", "restriction:hgv:conditional": "x", "except": "bus"}
    rows = [(1, tags, [5, 6, 7], ["from", "via", "to"], ["way", "node", "way"]), (2, {"type": "route"}, [1], ["x"], ["way"])]
    got = {tuple(r)[1:5] for r in turns.raw_rules(spark.createDataFrame(rows, shape)).collect()}
    assert got == {("no_u_turn", "bus", None, None), ("no_left_turn", "bus", None, "Mo-Fr 07:00-09:00"), ("only_straight_on", "bus", "hgv", None)}


def test_a_network_end_to_end(spark):
    """A cross of two roads with a rule, a footway, and a second road that loops."""
    nodes = [(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 0.002, 0.0), (4, 0.001, 0.001), (5, 0.001, -0.001), (6, 0.003, 0.001), (7, 0.003, -0.001)]
    ways = [(10, {"highway": "primary"}, [1, 2, 3]), (11, {"highway": "residential"}, [4, 2, 5]), (12, {"highway": "service"}, [3, 6, 7, 3]), (13, {"highway": "footway"}, [5, 1])]
    rules = [(1, {"type": "restriction", "restriction": "no_left_turn"}, [10, 2, 11], ["from", "via", "to"], ["way", "node", "way"])]
    n = Network(
        spark.createDataFrame([(*x, {}) for x in nodes], "osm_id long, lon double, lat double, tags map<string,string>"),
        spark.createDataFrame(ways, "osm_id long, tags map<string,string>, refs array<long>"),
        spark.createDataFrame(rules, "osm_id long, tags map<string,string>, refs array<long>, ref_roles array<string>, ref_types array<string>"),
    )
    e = n.edges("driving").collect()
    assert len(e) == 14 and sum(r.source < 0 for r in e) == 4 and len({r.edge_ref for r in e}) == 14
    assert {r.osm_id for r in n.edges("walking").collect()} == {10, 11, 12, 13}
    legal = {(r.from_edge, r.to_edge) for r in n.edge_graph().collect()}
    by = {(r.source, r.target, r.osm_id): r.edge_id for r in e}
    assert (by[1, 2, 10], by[2, 4, 11]) not in legal and (by[1, 2, 10], by[2, 3, 10]) in legal and (by[4, 2, 11], by[2, 3, 10]) in legal
    assert {r.cycle_type for r in n.typed_edges("cycling").collect()} == {"mixed_traffic", "dismount"}
    assert n.merged("driving")[0].count() > 0


def test_snap_against_every_segment(spark):
    rng = random.Random(9)
    at = lambda: (7 + rng.random() * 0.02, 43 + rng.random() * 0.02)
    lines = [(k, [at() for _ in range(rng.randint(2, 4))]) for k in range(25)] + [(90, [(7.0, 43.0), (7.0, 43.02)]), (91, [(7.01, 43.01), (7.01, 43.01)])]
    points = [(k, *at()) for k in range(60)]
    got = {r.point_id: (r.edge_id, r.distance_m) for r in snap.snap(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(lines, "edge_id long, geometry array<struct<lon:double,lat:double>>"), 200.0).collect()}
    from math import cos, hypot, radians

    want = {}
    for k, x, y in points:
        best = []
        for e, line in lines:
            for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
                east = 111320.0 * cos(radians(y))
                px, py, dx, dy = (ax - x) * east, (ay - y) * 110540.0, (bx - ax) * east, (by - ay) * 110540.0
                t = min(1, max(0, -(px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0
                best.append((hypot(px + dx * t, py + dy * t), e))
        if min(best)[0] <= 200:
            want[k] = (min(best)[1], min(best)[0])
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 0.01 for k in want)
