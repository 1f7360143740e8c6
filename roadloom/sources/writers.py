"""Writers of a network as text: GeoJSON lines, CSV, and a traffic simulator's XML, a file a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def well_known_text(line: Column) -> Column:
    points = F.transform(line, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")"))


def geojson_lines(edges: DataFrame, path: str) -> None:
    """A GeoJSON feature a line; all columns but the geometry are properties."""
    line = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    rest = F.struct(*[F.col(c) for c in edges.columns if c != "geometry"])
    feature = F.struct(F.lit("Feature").alias("type"), rest.alias("properties"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))
    edges.select(F.to_json(feature)).write.text(path)


def csv(edges: DataFrame, path: str) -> None:
    """CSV with a header; lines as well-known text, arrays joined by blanks."""
    kinds = dict(edges.dtypes)
    shown = {c: well_known_text(F.col(c)) if c == "geometry" else F.array_join(F.col(c).cast("array<string>"), " ") if kinds[c].startswith("array") else F.col(c) for c in edges.columns}
    edges.select(*[v.alias(c) for c, v in shown.items()]).write.csv(path, header=True)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_rows(df: DataFrame, element: str, attributes: dict[str, str]) -> DataFrame:
    """``value``: an empty element for each row; ``attributes`` are names and the columns they come from, nulls are left out."""
    parts = [F.concat(F.lit(f' {name}="'), _escaped(F.col(c).cast("string")), F.lit('"')) for name, c in attributes.items()]
    return df.select(F.concat(F.lit(f"<{element}"), F.concat_ws("", *parts), F.lit("/>")).alias("value"))


def simulation_links(edges: DataFrame) -> DataFrame:
    """The links of an agent-based traffic simulation as XML elements: metres, metres a second, vehicles an hour, lanes."""
    from roadloom.operators.planning import assignment_links

    x = edges.join(assignment_links(edges).select(F.col("link_id").alias("edge_id"), "capacity"), "edge_id")
    x = x.withColumns({"freespeed": F.round(F.col("maxspeed_kmh").cast("double") / 3.6, 3), "lanes": F.coalesce("lanes", F.lit(1))})
    return xml_rows(x, "link", {"id": "edge_id", "from": "source", "to": "target", "length": "length_m", "freespeed": "freespeed", "capacity": "capacity", "permlanes": "lanes"})
