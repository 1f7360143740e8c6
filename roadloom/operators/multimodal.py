"""Edges of several modes together, and the places where travellers change from one to another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the changes (from walking, to walking).
CHANGES = {"driving": ("park", "retrieve"), "cycling": ("bike_park", "bike_unpark")}
COLUMNS = ("edge_id", "source", "target", "cost_s", "length_m", "highway", "name")


def together(modes: dict[str, DataFrame]) -> DataFrame:
    """The edges of all modes in one table, with their mode."""
    return reduce(DataFrame.unionByName, [e.select(F.lit(m).alias("mode"), *COLUMNS) for m, e in modes.items()])


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()


def transfers(modes: dict[str, DataFrame], cost_s: float = 60.0, pairs: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """node_id, from_mode, to_mode, cost_s, kind: between walking and each other mode, wherever both have the node."""
    pairs, out = pairs or {}, []
    walked = _nodes(modes["walking"])
    for mode in sorted(set(modes) - {"walking"}):
        enter, leave = CHANGES.get(mode, ("enter", "exit"))
        change = lambda a, b, kind: F.struct(F.lit(a).alias("from_mode"), F.lit(b).alias("to_mode"), F.lit(float(pairs.get((a, b), cost_s))).alias("cost_s"), F.lit(kind).alias("kind"))
        both = walked.intersect(_nodes(modes[mode]))
        out.append(both.select("node_id", F.explode(F.array(change("walking", mode, enter), change(mode, "walking", leave))).alias("c")).select("node_id", "c.*"))
    return reduce(DataFrame.unionByName, out)


def with_node_costs(changes: DataFrame, costs: DataFrame, only_listed: bool = False) -> DataFrame:
    """``changes`` with the costs of (node_id, cost_s, from_mode, to_mode); of the rows that fit the one naming most modes counts.

    A null mode fits all. Where one names the first mode and one the second, the greater cost counts.
    """
    c = costs.select(F.col("node_id").alias("at"), F.col("cost_s").alias("new_s"), F.col("from_mode").alias("f"), F.col("to_mode").alias("t"))
    fits = (F.col("node_id") == F.col("at")) & (F.col("f").isNull() | (F.col("f") == F.col("from_mode"))) & (F.col("t").isNull() | (F.col("t") == F.col("to_mode")))
    named = F.col("f").isNotNull().cast("int") + F.col("t").isNotNull().cast("int")
    x = changes.join(c, fits, "inner" if only_listed else "left").groupBy("node_id", "from_mode", "to_mode", "kind", "cost_s").agg(F.max(F.when(F.col("at").isNotNull(), F.struct(named.alias("k"), "new_s"))).alias("best"))
    return x.select("node_id", "from_mode", "to_mode", F.coalesce("best.new_s", "cost_s").alias("cost_s"), "kind")
