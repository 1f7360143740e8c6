"""Distances, bearings and tiles as column expressions; a line is an array of structs (lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def line_length(line: Column) -> Column:
    """Metres along a line, summed in order. Most lines have two points, which need no loop over an array."""
    a, b = F.get(line, F.lit(0)), F.get(line, F.lit(1))
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: haversine(F.get(line, i - 1)["lon"], F.get(line, i - 1)["lat"], F.get(line, i)["lon"], F.get(line, i)["lat"]))
    return F.when(F.size(line) == 2, haversine(a["lon"], a["lat"], b["lon"], b["lat"])).when(F.size(line) > 2, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Compass degrees in [0, 360) from the first point to the second."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    r = F.radians(lat)
    clip = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit((1 << zoom) - 1)).cast("long")
    return clip((lon + 180) / 360 * n), clip((1 - F.asinh(F.tan(r)) / F.pi()) / 2 * n)


def tile_key(x: Column, y: Column, zoom: int) -> Column:
    """Quadkey digits from bit 61 down, the zoom in the lowest six bits."""
    key = F.lit(zoom).cast("long")
    for k in range(zoom):
        bit = zoom - 1 - k
        digit = F.shiftright(x, bit).bitwiseAND(1) + 2 * F.shiftright(y, bit).bitwiseAND(1)
        key = key + F.shiftleft(digit.cast("long"), 60 - 2 * k)
    return key


def _between(a: Column, b: Column, share: Column) -> Column:
    return F.struct((a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"))


def _offsets(line: Column) -> Column:
    """Planar length from the start to each point, in degrees."""
    step = lambda i: F.hypot(F.get(line, i)["lon"] - F.get(line, i - 1)["lon"], F.get(line, i)["lat"] - F.get(line, i - 1)["lat"])
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), step)
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))


def halves(line: Column) -> Column:
    """A line cut in the middle of its planar length: a struct of the lines ``first`` and ``second``, which share a point."""

    def cut(at: Column) -> Column:
        half = F.element_at(at, -1) / 2
        k = F.greatest(F.size(F.filter(at, lambda d: d < half)), F.lit(1))  # the middle is between points k-1 and k
        width = F.get(at, k) - F.get(at, k - 1)
        share = F.when(width > 0, (half - F.get(at, k - 1)) / width).otherwise(0.0)
        point = F.array(_between(F.get(line, k - 1), F.get(line, k), share))
        return F.struct(F.concat(F.slice(line, F.lit(1), k), point).alias("first"), F.concat(point, F.slice(line, k + 1, F.size(line) - k)).alias("second"))

    return F.get(F.transform(F.array(_offsets(line)), cut), F.lit(0))


def turn_angle(before: Column, after: Column) -> Column:
    """Degrees in [-180, 180) from one bearing to another; left is positive."""
    return F.pmod(before - after + 180, F.lit(360.0)) - 180


def project(x: Column, y: Column, a: Column, b: Column) -> Column:
    """The point of the segment a-b nearest to (x, y), in a local metric: a struct of distance_m, share, lon, lat."""
    east = 111_320.0 * F.cos(F.radians(y))
    ax, ay = (a["lon"] - x) * east, (a["lat"] - y) * 110_540.0
    dx, dy = (b["lon"] - a["lon"]) * east, (b["lat"] - a["lat"]) * 110_540.0
    square = dx * dx + dy * dy
    share = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
    return F.struct(F.hypot(ax + dx * share, ay + dy * share).alias("distance_m"), share.alias("share"), (a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"))
