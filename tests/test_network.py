import duckdb

from roadloom.functions.hashing import joined_hash, with_hash
from roadloom.operators.analysis import missing_runs
from roadloom.operators.components import components
from roadloom.operators.network import cost_seconds, edge_graph, global_junctions
from roadloom.operators.ways import mode_ways

WAYS = "osm_id long, tags map<string,string>, refs array<long>"


def lanes(spark, tags):
    row = mode_ways(spark.createDataFrame([(1, {"highway": "residential", **tags}, [1, 2])], WAYS), "driving").first()
    return row.lanes_fwd, row.lanes_bwd


def test_lanes(spark):
    assert lanes(spark, {"lanes": "3", "lanes:forward": "1", "lanes:backward": "1", "lanes:reversible": "1"}) == (2, 2)
    assert lanes(spark, {"lanes": "2"}) == (1, 1)
    assert lanes(spark, {}) == (1, 1)
    assert lanes(spark, {"highway": "motorway"}) == (2, None)
    assert lanes(spark, {"lanes": "2", "oneway": "yes"}) == (2, None)


def test_against_the_drawing(spark):
    row = mode_ways(spark.createDataFrame([(1, {"highway": "primary", "oneway": "-1"}, [1, 2, 3])], WAYS), "driving").first()
    assert row.oneway and row.refs == [3, 2, 1]


def test_hash_vectors(spark):
    x = with_hash(spark.createDataFrame([(1, 2, 3), (123456789, 987654321, -555)], "a long, b long, c long"), ("a", "b", "c"), "h")
    assert [r.h % 2**64 for r in x.collect()] == [12722334483198565868, 11030431678157071902]
    texts = ["[1, 2, 3]", "", "abcdefgh", "[-5, 123456789, 7]"]
    assert [joined_hash(7, -9, t) for t in texts] == [duckdb.sql(f"select hash(7::BIGINT, (-9)::BIGINT, '{t}')").fetchall()[0][0] for t in texts]


def test_junctions(spark):
    ways = spark.createDataFrame([(1, {"highway": "primary"}, [1, 2, 3]), (2, {"highway": "footway"}, [4, 2, 5]), (3, {"highway": "footway"}, [5, 6])], WAYS)
    assert {(r.node_id, r.is_road_junction) for r in global_junctions(ways).collect()} == {(1, True), (2, True), (3, True), (5, False)}


def test_turns(spark):
    e = spark.createDataFrame([(1, 10, 20, 1.0, None), (2, 20, 30, 2.0, None), (3, 20, 10, 1.0, "private")], "edge_id long, source long, target long, cost_s float, access string")
    assert {(r.from_edge, r.to_edge, r.uses) for r in edge_graph(e).collect()} == {(1, 2, "car"), (1, 3, "private"), (3, 1, "private")}


def test_cost_is_single_precision(spark):
    r = spark.createDataFrame([(1000.0, 36.0), (100.0, 0.0)], "length_m float, maxspeed_kmh float").select(cost_seconds().alias("c")).collect()
    assert abs(r[0].c - 100) < 1e-4 and abs(r[1].c - 7.2) < 1e-4


def test_components_and_runs(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (7, 7)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0, 50}
    runs = missing_runs(spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "owner long, k long"))
    assert {(r["first"], r["last"]) for r in runs.collect()} == {(1, 2), (4, 4)}
