"""Questions on whole tables: profiles, equality, dense numbers, one table for all modes, names and places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from roadloom.staging import staged


def way_table(modes: dict[str, DataFrame]) -> DataFrame:
    """The edges of all modes, with null where a mode lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [e.withColumn("mode", F.lit(m)) for m, e in modes.items()])


def unequal_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side`` a or b; none if the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_null, lowest, highest, mean, std, quartiles and n_distinct (about) of numeric columns, in one pass."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        stats.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.min(x).alias("lowest"), F.max(x).alias("highest"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev(x), 6).alias("std"), *[F.percentile_approx(x, q / 100).alias(f"q{q}") for q in (25, 50, 75)], F.approx_count_distinct(c).alias("n_distinct")).alias(c))
    one = df.agg(*stats)
    return one.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("s")).select("s.*")


def numbered(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """``df`` with ``number``: 0, 1, 2, … in order of a unique key, without sorting everything in one task.

    Rows are dealt by range; each range counts its rows, and starts where the ranges before it end.
    """
    x = staged(df.repartitionByRange(parts, key).withColumn("range", F.spark_partition_id()), "ranges")
    starts = x.groupBy("range").agg(F.count("*").alias("n"))
    starts = starts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("start"))  # a row for each range
    x = x.join(F.broadcast(starts), "range")
    return x.withColumn("number", F.col("start") + F.row_number().over(W.partitionBy("range").orderBy(key)) - 1).drop("range", "start")


def sequence_in_trace(points: DataFrame) -> DataFrame:
    """``points`` (trace_id, time, point_id) with ``seq``, from 0 in order of time."""
    return points.withColumn("seq", F.row_number().over(W.partitionBy("trace_id").orderBy("time", "point_id")) - 1)


def locate_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, edge_id: the longest edge of each asked name, whatever its case; ties go to the smaller id."""
    asked = names.select(F.lower("name").alias("key"), "name").distinct()
    x = edges.select(F.lower("name").alias("key"), "edge_id", "length_m").join(asked, "key")
    return x.groupBy("name").agg(F.max(F.struct("length_m", (-F.col("edge_id")).alias("minus"))).alias("m")).select("name", (-F.col("m.minus")).alias("edge_id"))


def longest(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k names with most kilometres."""
    x = edges.where("name is not null and not is_reverse").groupBy("name").agg(F.round(F.sum(F.col("length_m").cast("double")) / 1000, 3).alias("km"))
    return x.orderBy(F.desc("km"), "name").limit(k)


def out_degree(edges: DataFrame) -> DataFrame:
    """node_id, n: how many edges leave each node that has any edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit(1).alias("one")), F.struct(F.col("target").alias("node_id"), F.lit(0).alias("one")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.one").alias("n"))


def spatial_order(df: DataFrame, x: str, y: str, strips: int = 16) -> DataFrame:
    """Sort-tile-recursive layout: vertical strips of about equal numbers of rows, each sorted from south to north."""
    return df.repartitionByRange(strips, x).sortWithinPartitions(y, x)
