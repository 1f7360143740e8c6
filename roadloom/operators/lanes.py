"""Lanes of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def motor_lanes(edges: DataFrame) -> DataFrame:
    """edge_id, lane_num from 1 at the left, n_lanes: the motor lanes that an edge's count gives."""
    return edges.where("lanes > 0").select("edge_id", F.explode(F.sequence(F.lit(1), "lanes")).alias("lane_num"), F.col("lanes").alias("n_lanes"))


def lane_changes(lanes: DataFrame) -> DataFrame:
    """edge_id, from_lane, to_lane of lanes side by side."""
    a = lanes.select("edge_id", F.col("lane_num").alias("from_lane"), "n_lanes")
    to = F.filter(F.array(F.col("from_lane") - 1, F.col("from_lane") + 1), lambda n: (n >= 1) & (n <= F.col("n_lanes")))
    return a.select("edge_id", "from_lane", F.explode(to).alias("to_lane"))
