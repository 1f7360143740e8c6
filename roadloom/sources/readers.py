"""Readers of map and timetable files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>,members:array<struct<type:string,ref:bigint,role:string>>>"

# The columns of timetable files that are read.
GTFS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, route_short_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
}


def osm_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with a position, ways of two nodes or more, and relations of JSON documents {"elements": [...]}, a file each."""
    e = spark.read.schema(f"elements array<{ELEMENT}>").json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags")
    key = F.col("id").alias("osm_id")
    nodes = e.where("type = 'node' and lat is not null and lon is not null").select(key, "lon", "lat", tags)
    ways = e.where("type = 'way' and size(nodes) > 1").select(key, tags, F.col("nodes").alias("refs"))
    part = lambda c: F.transform("members", lambda m: m[c])
    relations = e.where("type = 'relation'").select(key, tags, part("ref").alias("refs"), part("role").alias("ref_roles"), part("type").alias("ref_types"))
    return nodes, ways, relations


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties (map), type, coordinates (JSON text) of the features of GeoJSON documents, a file each."""
    shape = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    x = spark.read.schema(f"features array<{shape}>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    return x.select("f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def gtfs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a timetable's folder of CSV files; columns are taken by name, absent ones are null."""
    raw = spark.read.csv(f"{folder}/{name}.txt", header=True, encoding="UTF-8")
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    columns = [c.split(" ") for c in GTFS[name].split(", ")]
    return raw.select(*[(F.trim(F.col(f"`{names[c]}`")) if c in names else F.lit(None)).try_cast(kind).alias(c) for c, kind in columns])
