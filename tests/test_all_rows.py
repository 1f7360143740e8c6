from math import asin, cos, radians, sin, sqrt

from pyspark.sql import functions as F

from roadloom.operators import analysis
from roadloom.plans import catalog, fixture

SMALL = "/root/testdata/sf0.001"


def test_all_orders_are_ways(spark, tmp_path):
    spark.createDataFrame([(o, n, 10 * o + n, 1.0) for o in range(1, 24) for n in (1, 2)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o, "O", "1-URGENT") for o in range(1, 24)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    made = {r.osm_id: r.refs for r in fixture.raw_ways(spark, str(tmp_path)).collect()}
    assert made == {o: [16 * (10 * o + n) + (o + n) % 10 for n in (1, 2)] + ([16 * (10 * o + 2) + 10, 16 * (10 * o + 1) + (o + 1) % 10, 16 * (10 * o + 2) + 11, 16 * (10 * o + 2) + (o + 2) % 10] if o == 1 else []) for o in range(1, 24)}
    lines = fixture.table(spark, SMALL, "lineitem").groupBy("l_orderkey").count().where("count > 1")
    ways = fixture.raw_ways(spark, SMALL)
    more = "case when osm_id % 40 = 0 then 3 when osm_id % 40 = 1 then 4 else 0 end"
    assert ways.count() == lines.count() and ways.agg(F.sum(F.size("refs") - F.expr(more))).first()[0] == lines.agg(F.sum("count")).first()[0]


def test_reach_has_no_bound_on_arcs(spark):
    line = [(k, k + 1, 1.0) for k in range(90)]
    edges = spark.createDataFrame([*line, (0, 80, 79.5), (0, 3, 9.0), (5, 200, 0.5), (300, 0, 1.0)], "source long, target long, cost_s float")
    got = {(r.origin, r.node_id): r.cost_s for r in analysis.reach(edges, spark.createDataFrame([(0,), (300,)], "node_id long"), 88.0).collect()}
    want = {(0, k): float(k) if k < 80 else k - 0.5 for k in range(89)} | {(0, 200): 5.5, (300, 300): 0.0}
    want |= {(300, k): c + 1 for (o, k), c in want.items() if o == 0 and c + 1 <= 88}
    assert got == want


def test_nearest_has_no_window(spark):
    nodes = [(k, 7 + k * 0.001, 43.0) for k in range(3)] + [(10, 7.0, 43.0039), (11, 8.5, 60.0), (12, 179.9995, 10.0), (13, -179.9, 10.0)]
    points = [(1, 7.0001, 43.0), (2, 7.0, 43.1), (3, -120.0, -30.0), (4, 8.0, 59.0), (5, 7.0039, 43.0019), (6, 7.0, 43.00195), (8, -179.9995, 10.0), (9, 100.0, 80.0), (7, None, 43.0)]

    def away(a, b):
        x, y, lon, lat = map(radians, (*a, *b))
        return round(12742000.0 * asin(sqrt(sin((lat - y) / 2) ** 2 + cos(y) * cos(lat) * sin((lon - x) / 2) ** 2)), 3)

    got = analysis.nearest(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(nodes, "osm_id long, lon double, lat double"))
    want = {p: min((away((x, y), (lon, lat)), k) for k, lon, lat in nodes) for p, x, y in points if x is not None}
    found = {r.point_id: (r.distance_m, r.node_id) for r in got.collect()}
    assert {p: k for p, (_, k) in found.items()} == {p: k for p, (_, k) in want.items()} and all(abs(found[p][0] - want[p][0]) < 0.01 for p in want)
    assert analysis.nearest(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame([], "osm_id long, lon double, lat double")).count() == 0


def test_all_events_are_placed(spark):
    events = fixture.table(spark, SMALL, "events")
    assert catalog.j17_nearest_nodes(spark, SMALL).count() == events.count()
