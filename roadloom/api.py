"""A road network as an object: tables are built when first asked for, staged once, and used again by all questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.tags import spread
from roadloom.operators import chains, network, turns, types
from roadloom.operators.ways import MODES, TAGS, mode_ways
from roadloom.staging import grown, staged

USES = {"driving": "car", "walking": "walk", "cycling": "bike"}
SPEED_OF = {"walking": 5.0, "cycling": 15.0}


class Network:
    """Built from raw nodes (osm_id, lon, lat, tags), ways (osm_id, tags, refs) and relations (osm_id, tags, refs, ref_roles, ref_types).

    Ways may have a column ``tag:<key>`` for each tag that rules name instead of ``tags``.
    """

    def __init__(self, nodes: DataFrame, ways: DataFrame, relations: DataFrame | None = None):
        self.spark: SparkSession = ways.sparkSession
        self._raw = {"nodes": nodes, "ways": ways, "relations": relations}
        self._tables: dict[str, DataFrame] = {}
        self._parts: dict[tuple[str, str], DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = staged(make(), name)
        return self._tables[name]

    def tables(self) -> dict[str, DataFrame]:
        """The tables made so far."""
        return dict(self._tables)

    def has(self, name: str) -> bool:
        return name in self._tables

    def raw_nodes(self) -> DataFrame:
        return self._once("raw_nodes", lambda: self._raw["nodes"].select("osm_id", "lon", "lat", "tags"))

    def tagged_ways(self) -> DataFrame:
        """osm_id, refs and a column for each tag that rules name."""
        return self._once("tagged_ways", lambda: spread(self._raw["ways"], (*TAGS, *types.TYPE_TAGS)))

    def junctions(self) -> DataFrame:
        return self._once("junctions", lambda: network.global_junctions(self.tagged_ways()))

    def ways(self, mode: str) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}: choose from {', '.join(MODES)}")
        return self._once(f"{mode}_ways", lambda: mode_ways(self.tagged_ways(), mode))

    def edges(self, mode: str) -> DataFrame:
        """All edges of a mode, restricted ones included."""
        name = f"{mode}_edges"
        if name not in self._tables:
            self._tables[name] = network.build(self.raw_nodes(), self.ways(mode), self.junctions(), mode)
        return self._tables[name]

    def edges_with(self, mode: str, wanted: str) -> DataFrame:
        """Edges of a mode, all those of the ways for which a condition on them holds among them; a question on few ways need not build all.

        They are as in ``edges``: junctions come from all ways, all else is done way by way. Only paths of other modes
        are cut where the mode's ways meet that are not built (ferries), so these modes are built whole.
        """
        if mode != "driving" or self.has(f"{mode}_edges"):
            return self.edges(mode)
        if (mode, wanted) not in self._parts:
            some = self.ways(mode) if self.has(f"{mode}_ways") else mode_ways(self.tagged_ways(), mode)
            some = staged(some.where(wanted), f"{mode}_some_ways")
            self._parts[mode, wanted] = network.build(self.raw_nodes(), some, self.junctions(), mode)
        return self._parts[mode, wanted]

    def edges_around(self, mode: str, box: tuple[float, float, float, float]) -> DataFrame:
        """Edges of a mode, all those that meet a box (west, south, east, north) among them, as in ``edges``."""
        if mode != "driving" or self.has(f"{mode}_edges"):
            return self.edges(mode)
        if (mode, str(box)) not in self._parts:
            ways = self.ways(mode)
            at = grown(ways.select("osm_id", F.explode("refs").alias("node"))).join(self.raw_nodes().select(F.col("osm_id").alias("node"), "lon", "lat"), "node")
            own = at.groupBy("osm_id").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
            west, south, east, north = map(F.lit, box)
            near = own.where((F.col("x0") <= east) & (F.col("x1") >= west) & (F.col("y0") <= north) & (F.col("y1") >= south)).select("osm_id")
            some = staged(ways.join(grown(near), "osm_id", "left_semi"), f"{mode}_near_ways")
            self._parts[mode, str(box)] = network.build(self.raw_nodes(), some, self.junctions(), mode)
        return self._parts[mode, str(box)]

    def merged(self, mode: str) -> tuple[DataFrame, DataFrame]:
        """(edges, edge_id_map) with chains of the same road merged, cut at the mode's own junctions."""
        arcs = self._once(f"{mode}_plain_arcs", lambda: network.plain_arcs(self.raw_nodes(), self.ways(mode)))
        both = f"{mode}_merged_edges", f"{mode}_edge_id_map"
        if both[0] not in self._tables:
            merged, mapped = chains.contract(arcs)
            self._tables[both[0]] = network.checked_ids(staged(network.directed_edges(network.in_order(network.split_parallels(merged)), mode), both[0]))
            self._tables[both[1]] = staged(mapped, both[1])
        return self._tables[both[0]], self._tables[both[1]]

    def open_edges(self, mode: str) -> DataFrame:
        return network.open_edges(self.edges(mode))

    def private_edges(self, mode: str) -> DataFrame:
        return network.private_split(self.edges(mode))[1]

    def nodes(self, mode: str) -> DataFrame:
        return self._once(f"{mode}_nodes", lambda: network.node_table(self.edges(mode)))

    def typed_edges(self, mode: str) -> DataFrame:
        """Walking or cycling edges with connectors of loose path ends, types, and where a bicycle is pushed."""

        def make() -> DataFrame:
            edges = self.edges(mode)
            kmh = F.lit(SPEED_OF[mode]).cast("float")
            more = types.connectors(edges).withColumn("maxspeed_kmh", kmh).withColumn("cost_s", network.cost_seconds())
            return types.with_types(edges.unionByName(more, allowMissingColumns=True), self.tagged_ways(), mode)

        return self._once(f"{mode}_typed_edges", make)

    def rules(self) -> DataFrame:
        if self._raw["relations"] is None:
            raise ValueError("the network has no relations")
        return self._once("rules", lambda: turns.raw_rules(self._raw["relations"]))

    def _ends(self, mode: str) -> DataFrame:
        return self._once(f"{mode}_end_ways", lambda: turns.end_ways(self.open_edges(mode), self.ways(mode)))

    def turn_restrictions(self, mode: str = "driving") -> DataFrame:
        return self._once(f"{mode}_turn_restrictions", lambda: turns.turn_restrictions(self.rules(), self._ends(mode)))

    def turn_path_restrictions(self, mode: str = "driving") -> DataFrame:
        return self._once(f"{mode}_turn_path_restrictions", lambda: turns.path_restrictions(self.rules(), self._ends(mode)))

    def _lines(self, mode: str) -> DataFrame:
        """The line graph without turns back on bridges."""
        return self._once(f"{mode}_line_graph", lambda: turns.without_bridge_turnbacks(network.edge_graph(self.edges(mode), USES[mode]), self.open_edges(mode)))

    def _bans(self, mode: str) -> DataFrame:
        return self._once(f"{mode}_bans", lambda: turns.banned(self._lines(mode), self.turn_restrictions(mode)))

    def edge_graph(self, mode: str = "driving") -> DataFrame:
        """Legal turns: from_edge, to_edge, via_edge, cost, uses."""
        if self._raw["relations"] is None:
            return self._lines(mode)
        return self._once(f"{mode}_edge_graph", lambda: turns.without_banned(self._lines(mode), self._bans(mode)))

    def turn_permission(self, mode: str = "driving") -> DataFrame:
        return self._once(f"{mode}_turn_permission", lambda: turns.turn_permission(self._bans(mode)))

    def save(self, folder: str) -> None:
        """All tables made so far, a Parquet folder each."""
        for name, t in self._tables.items():
            t.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, names: list[str]) -> Network:
        """A saved network with the named tables."""
        net = cls.__new__(cls)
        net.spark, net._raw = spark, {"nodes": None, "ways": None, "relations": spark.range(0)}
        net._parts = {}
        net._tables = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
        return net
