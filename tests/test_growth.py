"""Tables that grow within a plan, and the searches that hold at size."""

import random
import time
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from roadloom import staging
from roadloom.llm import simhash
from roadloom.operators import analysis, components, network, routing, snap
from roadloom.api import Network
from roadloom.plans import catalog, fixture, wider


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_not_broadcast(spark):
    """Each fingerprint has dozens of keys, which the planner does not see."""
    found = plan(simhash.near_pairs(spark.range(100).select(F.col("id").alias("fp"))))
    assert "SortMergeJoin" in found and "Broadcast" not in found


def test_links_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    """Nothing that grows with the fingerprints, links or names goes through the driver, whatever the planner takes it for."""
    docs = [(k, f"{w} {k // 3} two three") for k, w in enumerate(["one", "one", "1"] * 3)] + [(None, "one 0 two three"), (0, "one 0 two three")]
    fps, names = [simhash.fingerprint(t) for _, t in docs], [k for k, _ in docs]
    for _ in docs:
        names = [min(n for n, g in zip(names, fps, strict=True) if n is not None and (f ^ g).bit_count() <= 3) for f in fps]
    seen, keep = [], staging.staged
    monkeypatch.setattr(staging, "within_bound", lambda *_: False)
    monkeypatch.setattr(components, "within_bound", lambda *_: False, raising=False)
    for module in (simhash, components):
        monkeypatch.setattr(module, "staged", lambda df, name: seen.append(plan(df)) or keep(df, name))
    rows = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in rows.collect()))) == sorted(map(str, zip((k for k, _ in docs), names, strict=True)))
    links = spark.createDataFrame([(k, k + 1) for k in range(30) if k % 8], "a long, b long")
    monkeypatch.setattr(components, "BLOCK", 7)
    found = components.components(links)
    assert {tuple(r) for r in found.collect()} == {(k, max(1, (k - 1) // 8 * 8 + 1)) for k in range(1, 31)}
    seen += [plan(rows), plan(found)]
    assert sum("SortMergeJoin" in p for p in seen) > 5 and not any("Broadcast" in p for p in seen)


def test_farthest_is_rounded_once(spark, monkeypatch):
    class Net:
        def open_edges(self, mode):
            return spark.createDataFrame([(100, 1, 10.4996), (1, 2, 0.0), (200, 1, 10.5)], "source long, target long, cost_s double")

    monkeypatch.setattr(wider, "net", lambda *_: Net())
    assert {tuple(r) for r in wider.g8_accessibility(spark, "").collect()} == {(100, 2, 10.0), (200, 2, 11.0)}


def test_nodes_and_references_are_not_broadcast(spark, tmp_path):
    """A part gives twelve nodes, a way as many references as it has."""
    spark.range(50).select(F.col("id").alias("p_partkey"), F.lit("SMALL TIN").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    nodes = fixture.raw_nodes(spark, str(tmp_path))
    edges = spark.createDataFrame([(k, 16 * k, 16 * k + 17, 1.0) for k in range(40)], "edge_id long, source long, target long, cost_s double")
    checks = analysis.checks(edges, nodes)
    assert "Broadcast" not in plan(checks) and {tuple(r) for r in checks.collect()} == {("unique_edge_id", 0, 40), ("ends_exist", 0, 80), ("positive_cost", 0, 40)}
    ways = spark.createDataFrame([(1, "primary", False, [16, 32, 48])], "osm_id long, highway string, against boolean, refs array<long>")
    line = next(x for x in plan(network.segments(ways, nodes)).splitlines() if "Join" in x and "node_id" in x)
    assert "SortMergeJoin" in line


def test_nearest_does_not_broadcast_nodes(spark, tmp_path, monkeypatch):
    """All points on nodes at random, in cells of any size, and no broadcast of nodes that parts have been exploded to."""
    seen, keep = [], analysis.staged
    monkeypatch.setattr(analysis, "staged", lambda df, name: seen.append(plan(df)) or keep(df, name))
    spark.range(30).select(F.col("id").alias("p_partkey"), F.lit("SMALL TIN").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    nodes = fixture.raw_nodes(spark, str(tmp_path))
    rng = random.Random(8)
    points = [(k, 7 + rng.random() * 0.04 * 40 ** (k % 3), 43 + rng.random() * 0.004 * 40 ** (k % 3)) for k in range(40)]
    got = {r.point_id: (r.node_id, r.distance_m) for r in analysis.nearest(spark.createDataFrame(points, "point_id long, x double, y double"), nodes).collect()}
    assert seen and not any("Broadcast" in p for p in seen)
    at = [(r.osm_id, r.lon, r.lat) for r in nodes.collect()]
    for k, x, y in points:
        away = {n: 12742000.0 * asin(sqrt(sin(radians(b - y) / 2) ** 2 + cos(radians(y)) * cos(radians(b)) * sin(radians(a - x) / 2) ** 2)) for n, a, b in at}
        assert abs(away[got[k][0]] - min(away.values())) < 0.002 and abs(got[k][1] - min(away.values())) < 0.002


def arcs_at_random(rng, ends, n):
    arcs = {(rng.randrange(ends), rng.randrange(ends)) for _ in range(n)}
    reach = {u: {u} for u in {x for a in arcs for x in a}}
    for _ in range(ends):
        for u, v in arcs:
            for seen in reach.values():
                if u in seen:
                    seen.add(v)
    return sorted(arcs), reach


def test_components_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(components, "RANGE", 5)
    rng = random.Random(4)
    for n in (40, 60):
        arcs, _ = arcs_at_random(rng, 60, n)
        edges = spark.createDataFrame(arcs, "a long, b long")
        assert {tuple(r) for r in components.components(edges, True).collect()} == {tuple(r) for r in components.components(edges).collect()}


def test_small_components_are_searched_together(spark, monkeypatch):
    """Many components in one step of a task, none cut, and no walk along the stack for each."""
    t = pa.table({"root": [1, 1, 2, 2, 2, 3, 4], "source": range(7)})
    assert [x.column("root").to_pylist() for x in analysis.whole_groups(iter(t.to_batches(2)), 3)] == [[1, 1], [2, 2, 2], [3, 4]]
    n = 200_000
    began = time.process_time()
    assert analysis.strong_groups({k: [k + 1] for k in range(n)} | {n: []}) == [[k] for k in range(n, -1, -1)]
    assert time.process_time() - began < 20
    assert "FlatMapGroupsInPandas" not in plan(analysis.in_whole_groups(spark.createDataFrame([(1, 2, 3)], "root long, source long, target long"), analysis._strong, "node_id long, component long"))


def test_has_path_answers_pairs(spark, monkeypatch):
    """All pairs, those of loops and of unknown ends too, by tasks and by rounds; by tasks nothing is searched from each origin."""
    monkeypatch.setattr(routing, "BITS_AT_ONCE", 1)
    arcs, reach = arcs_at_random(random.Random(7), 80, 75)
    pairs = [(u, v) for u in range(0, 82) for v in range(81, -1, -1)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
    want = {(u, v, u == v or v in reach.get(u, ())) for u, v in pairs}
    assert {tuple(r) for r in routing.has_path(frame(arcs, ("source", "target")), frame(pairs, ("origin", "destination")), 4).collect()} == want
    monkeypatch.setattr(routing, "reach", None)
    assert {tuple(r) for r in routing.has_path(frame(arcs, ("source", "target")), frame(pairs, ("origin", "destination"))).collect()} == want


def test_snap_makes_no_cells_without_points(spark):
    """A segment over more cells than an array holds, nearly all outside the box of the points."""
    edges = spark.createDataFrame([(5, [(7.0, 0.0), (7.0, 60.0)])], "edge_id long, geometry array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 7.0, 43.0), (2, 8.0, 43.0)], "point_id long, x double, y double")
    assert [(r.point_id, r.edge_id, r.distance_m) for r in snap.snap(points, edges, 0.01, 1e-8).collect()] == [(1, 5, 0.0)]


def test_snap_compares_few_pairs(spark, monkeypatch):
    """Many points and segments in one cell, and cells in pieces: the same as all pairs, of which few are compared."""
    rng = np.random.default_rng(6)
    x, y = 7 + rng.random(4_000) / 1000, 43 + rng.random(4_000) / 1000
    ends = [7 + rng.random(2_000) / 1000, 43 + rng.random(2_000) / 1000, 7 + rng.random(2_000) / 1000, 43 + rng.random(2_000) / 1000]
    n, plain = [0], snap._distances
    monkeypatch.setattr(snap, "_distances", lambda x, y, s: n.append(len(x) * len(s[0])) or plain(x, y, s))
    i, j = snap.nearest_pairs(x, y, ends, 50.0)
    assert sum(n) < 4_000 * 2_000 / 4
    every = plain(x, y, ends)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(int(a), int(b)) for a, b in zip(*np.nonzero(every <= every.min(axis=1)[:, None] + snap.SLACK), strict=True)}
    monkeypatch.setattr(snap, "PIECE", 10)
    points = spark.createDataFrame([(k, float(x[k]), float(y[k])) for k in range(50)], "point_id long, x double, y double")
    lines = spark.createDataFrame([(k, [(float(ends[0][k]), float(ends[1][k])), (float(ends[2][k]), float(ends[3][k]))]) for k in range(60)], "edge_id long, geometry array<struct<lon:double,lat:double>>")
    got = {r.point_id: (r.distance_m, r.edge_id) for r in snap.snap(points, lines).collect()}
    d = every[:50, :60]
    assert got == {k: min((round(float(v), 3), e) for e, v in enumerate(d[k])) for k in range(50) if d[k].min() <= 50}


def test_parts_of_a_network_are_as_in_the_whole(spark):
    """Edges of some ways, and those around a box, with loops and parallel arcs; the questions build no more."""
    catalog._networks.clear()
    small = "/root/testdata/sf0.001"
    for name in ("g13_strong_components", "g12_has_path", "m1_snap"):
        catalog.QUERIES[name](spark, small).count()
        assert not catalog.net(spark, small).has("driving_edges")
    make = lambda: Network(fixture.raw_nodes(spark, small), fixture.tagged_ways(spark, small))
    part, whole = make(), make().edges("driving")
    some = "highway = 'residential' or size(array_distinct(refs)) < size(refs)"
    rows = lambda e, where: sorted(map(str, e.where(where).collect()))
    assert rows(part.edges_with("driving", some), "highway = 'residential' or source < 0") == rows(whole, "highway = 'residential' or source < 0") != []
    box = (7.02, 43.0, 7.03, 43.0001)
    meets = "array_min(geometry.lon) <= 7.03 and array_max(geometry.lon) >= 7.02 and array_min(geometry.lat) <= 43.0001"
    near = part.edges_around("driving", box)
    assert rows(near, meets) == rows(whole, meets) != [] and near.count() < whole.count()
    tags = {r.osm_id: {k: v for k, v in r.asDict().items() if k.startswith("tag:") and v is not None} for r in part.tagged_ways().collect()}
    assert tags == {r.osm_id: {f"tag:{k}": v for k, v in r.tags.items() if f"tag:{k}" in part.tagged_ways().columns} for r in fixture.raw_ways(spark, small).collect()}
