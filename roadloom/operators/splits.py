"""Arcs made unique: loops and all but the shortest of parallel arcs are cut in two at a virtual node.

Virtual nodes have negative ids from a hash of the arc's content, so they are the same in every build. An arc has osm_id,
place (of its source in its way), source, target, twin (it has an edge back), refs, geometry, length_m.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from roadloom.functions.geo import halves
from roadloom.functions.hashing import virtual_node
from roadloom.staging import python_ready

#: The place of a virtual node in its way: after all others.
NO_PLACE = 2_000_000_000


def cut_in_two(arcs: DataFrame) -> DataFrame:
    """Each arc as two of half its length, joined by a virtual node in the middle of its line. The middle reference is in both."""
    python_ready(arcs.sparkSession)
    middle = F.rint(F.size("refs") / 2.0 + 1).cast("int")
    x = arcs.withColumns({"virtual": virtual_node("osm_id", "source", "target", "refs"), "two": halves(F.col("geometry")), "middle": middle})
    first = F.struct(F.col("source").alias("source"), F.col("virtual").alias("target"), F.slice("refs", F.lit(1), F.col("middle")).alias("refs"), F.col("two.first").alias("geometry"), F.col("place").alias("place"))
    rest = F.slice("refs", F.col("middle"), F.size("refs") - F.col("middle") + 1)
    second = F.struct(F.col("virtual").alias("source"), F.col("target").alias("target"), rest.alias("refs"), F.col("two.second").alias("geometry"), F.lit(NO_PLACE).alias("place"))
    x = x.withColumn("half", F.explode(F.array(first, second)))
    changed = ("source", "target", "refs", "geometry", "place")
    columns = [F.col(f"half.{c}").alias(c) if c in changed else (F.col(c) / 2).cast("float").alias(c) if c == "length_m" else F.col(c) for c in arcs.columns]
    return x.select(*columns)


def _text() -> Column:
    return F.concat(F.lit("["), F.array_join(F.col("refs").cast("array<string>"), ", "), F.lit("]"))


def split_loops(arcs: DataFrame) -> DataFrame:
    """Loops of three points or more are cut in two; shorter ones have no inside and go."""
    loop = F.col("source") == F.col("target")
    return arcs.where(~loop).unionByName(cut_in_two(arcs.where(loop & (F.size(F.array_distinct("geometry")) > 1))))


def split_parallel(arcs: DataFrame) -> DataFrame:
    """Of arcs with equal (osm_id, source, target) the shortest stays whole, the others are cut in two."""
    best = W.partitionBy("osm_id", "source", "target").orderBy("length_m", _text())
    x = arcs.withColumn("nth", F.row_number().over(best))
    return x.where("nth = 1").drop("nth").unionByName(cut_in_two(x.where("nth > 1").drop("nth")))


def split_antiparallel(arcs: DataFrame) -> DataFrame:
    """Of arcs with edges back that join the same nodes from either end the longest is cut, as its reverse edge would be equal to the other.

    Parallel arcs are apart before, so there are two to a pair at most.
    """
    pair = W.partitionBy("osm_id", F.least("source", "target"), F.greatest("source", "target"))
    x = arcs.withColumn("cut", (F.row_number().over(pair.orderBy("length_m", _text())) > 1) & F.col("twin"))
    return x.where("not cut").drop("cut").unionByName(cut_in_two(x.where("cut").drop("cut")))


def split_all(arcs: DataFrame) -> DataFrame:
    """All three in one plan: which arcs are cut is decided once, and Python sees those only.

    Loops are cut first; their halves end in virtual nodes, so they are parallel or antiparallel to each other only.
    """
    return split_antiparallel(split_parallel(split_loops(arcs)))
