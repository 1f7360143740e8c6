import json
from datetime import datetime

from pyspark.sql import functions as F

from roadloom.functions.geo import halves, turn_angle
from roadloom.operators import clip, multimodal, snap, splits, tables
from roadloom.sources import readers, writers
from roadloom.streaming.bins import time_bins

ARC = "osm_id long, place int, source long, target long, twin boolean, refs array<long>, geometry array<struct<lon:double,lat:double>>, length_m float"


def test_halves_meet_in_the_middle(spark):
    line = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (4.0, 0.0)],), ([(2.0, 2.0), (2.0, 2.0)],)], "g array<struct<lon:double,lat:double>>")
    a, b = line.select(halves(F.col("g")).alias("h")).collect()
    assert [tuple(p) for p in a.h.first] == [(0, 0), (1, 0), (2, 0)] and [tuple(p) for p in a.h.second] == [(2, 0), (4, 0)]
    assert a.h.first[-1] == a.h.second[0] and b.h.first[-1] == b.h.second[0]


def test_arcs_become_unique(spark):
    flat = lambda *xs: [(float(x), 0.0) for x in xs]
    rows = [
        (1, 1, 1, 2, True, [1, 5, 2], flat(0, 1, 2), 10.0), (1, 1, 1, 2, True, [1, 6, 2], flat(0, 3, 2), 20.0),
        (1, 1, 2, 1, True, [2, 7, 1], flat(2, 5, 0), 30.0), (1, 1, 1, 1, True, [1, 8, 9, 1], flat(0, 1, 2, 0), 40.0),
    ]
    arcs = spark.createDataFrame(rows, ARC)
    out = splits.split_all(arcs).collect()
    ends = [(r.source, r.target) for r in out] + [(r.target, r.source) for r in out]
    assert len(set(ends)) == len(ends) and all(r.source != r.target for r in out)
    assert abs(sum(r.length_m for r in out) - 100) < 1e-3
    assert {tuple(r.refs) for r in out if r.length_m == 10 and min(r.source, r.target) < 0} >= {(1, 6), (6, 2)}
    assert splits.split_all(arcs.where("false")).count() == 0


def test_transfers(spark):
    e = "edge_id long, source long, target long, cost_s float, length_m float, highway string, name string"
    modes = {"walking": spark.createDataFrame([(1, 1, 2, 1.0, 1.0, "path", None), (2, 2, 3, 1.0, 1.0, "path", None)], e), "cycling": spark.createDataFrame([(3, 2, 9, 1.0, 1.0, "path", None)], e)}
    t = multimodal.transfers(modes, 60.0, {("cycling", "walking"): 5.0})
    assert {(r.node_id, r.kind, r.cost_s) for r in t.collect()} == {(2, "bike_park", 60), (2, "bike_unpark", 5)}
    costs = spark.createDataFrame([(2, 1.0, None, None), (2, 3.0, "walking", None), (7, 9.0, None, None)], "node_id long, cost_s double, from_mode string, to_mode string")
    assert {(r.kind, r.cost_s) for r in multimodal.with_node_costs(t, costs).collect()} == {("bike_park", 3), ("bike_unpark", 1)}
    assert multimodal.with_node_costs(t, costs.where("node_id = 7"), only_listed=True).count() == 0
    assert multimodal.together(modes).count() == 3


def test_angles(spark):
    x = spark.createDataFrame([(0.0, 270.0), (350.0, 10.0), (10.0, 190.0)], "a double, b double")
    assert [r.t for r in x.select(turn_angle(F.col("a"), F.col("b")).alias("t")).collect()] == [90, -20, -180]


def test_cut_and_snap(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 0.0)], "osm_id long, lon double, lat double")
    ways = spark.createDataFrame([(10, {}, [1, 2, 3]), (11, {}, [3])], "osm_id long, tags map<string,string>, refs array<long>")
    n, w = clip.cut_raw(nodes, ways, (-1, -1, 2, 1))
    assert n.count() == 3 and [r.osm_id for r in w.collect()] == [10]
    n, w = clip.cut_raw(nodes, ways, (-1, -1, 2, 1), complete=False)
    assert n.count() == 2 and w.first().refs == [1, 2]
    edges = spark.createDataFrame([(2, [(0.0, 0.0), (0.01, 0.0)]), (1, [(0.01, 0.0), (0.0, 0.0)])], "edge_id long, geometry array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 0.005, 0.0001), (2, 0.005, 0.1)], "point_id long, x double, y double")
    (r,) = snap.snap(points, edges).collect()
    assert (r.point_id, r.edge_id) == (1, 1) and abs(r.distance_m - 11.054) < 0.01 and abs(r.snap_x - 0.005) < 1e-9


def test_tables(spark):
    x = spark.range(0, 1000, 3)
    assert [r.number for r in tables.numbered(x, "id", 7).orderBy("id").collect()] == list(range(334))
    assert tables.unequal_rows(x, x).count() == 0
    assert tables.numbered(x.where("false"), "id", 3).count() == 0


def test_readers_and_writers(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 1, "lat": 1.5, "lon": 2.5}, {"type": "way", "id": 2, "nodes": [1, 3], "tags": {"highway": "path"}}, {"type": "way", "id": 4, "nodes": [1]}, {"type": "relation", "id": 5, "members": [{"type": "way", "ref": 2, "role": "from"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    nodes, ways, relations = readers.osm_json(spark, f"{tmp_path}/a.json")
    assert nodes.first().lon == 2.5 and [r.osm_id for r in ways.collect()] == [2] and relations.first().ref_roles == ["from"]
    (tmp_path / "stops.txt").write_text("stop_id,stop_lon,stop_lat\ns1, 7.5,43.5\n")
    assert tuple(readers.gtfs(spark, str(tmp_path), "stops").first()) == ("s1", None, 43.5, 7.5)
    (tmp_path / "f.geojson").write_text(json.dumps({"features": [{"type": "Feature", "properties": {"a": "b"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    f = readers.geojson(spark, f"{tmp_path}/f.geojson").first()
    assert f.properties == {"a": "b"} and json.loads(f.coordinates) == [1, 2]
    edges = spark.createDataFrame([(1, 'A "b" & c', [7, 8], [(0.0, 1.0), (2.0, 3.0)])], "edge_id long, name string, refs array<long>, geometry array<struct<lon:double,lat:double>>")
    writers.geojson_lines(edges, f"{tmp_path}/g")
    assert json.loads(spark.read.text(f"{tmp_path}/g").first().value)["geometry"]["coordinates"] == [[0, 1], [2, 3]]
    writers.csv(edges, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True, escape="\\").first().geometry == "LINESTRING (0.0 1.0, 2.0 3.0)"
    assert writers.xml_rows(edges, "edge", {"id": "edge_id", "name": "name"}).first().value == '<edge id="1" name="A &quot;b&quot; &amp; c"/>'


def test_stream_of_time_bins(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(1, at(1, 5), 2.0), (1, at(1, 50), 4.0), (2, at(2, 0), 1.0)], "edge_id long, time timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("edge_id long, time timestamp, value double").parquet(f"{tmp_path}/in")
    q = time_bins(stream).writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.edge_id, r.n, r["mean"]) for r in spark.table("bins").collect()} == {(1, 2, 3.0), (2, 1, 1.0)}
