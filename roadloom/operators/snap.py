"""Points set on the nearest edge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadloom.functions.geo import project
from roadloom.staging import bounded, python_ready, staged

CELL = 0.001  # degrees
#: Rows of a cell that a task takes at once, of points and of segments; pairs that are compared without a further cut.
PIECE, PAIRS = 1 << 16, 1 << 14
#: Metres by which a segment may be farther than the nearest one and still be a tie once both are rounded.
SLACK = 0.002


def _cells(low: Column, high: Column, cell: float, least: Column | None = None, most: Column | None = None) -> Column:
    """Numbers of the cells from one value to another, those from ``least`` to ``most`` only; null if there is none."""
    a, b = F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long")
    if least is not None:
        a, b = F.greatest(a, least), F.least(b, most)
    return F.when(a <= b, F.sequence(a, b))


def _distances(x: np.ndarray, y: np.ndarray, s: list[np.ndarray]) -> np.ndarray:
    """Metres from each point to each segment, as ``project`` has them."""
    east = 111_320.0 * np.cos(np.radians(y))[:, None]
    ax, ay = (s[0] - x[:, None]) * east, (s[1] - y[:, None]) * 110_540.0
    dx, dy = (s[2] - s[0]) * east, (s[3] - s[1]) * 110_540.0
    square = dx * dx + dy * dy
    share = np.clip(-(ax * dx + ay * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    return np.hypot(ax + dx * share, ay + dy * share)


def nearest_pairs(x: np.ndarray, y: np.ndarray, s: list[np.ndarray], radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of points and of segments (lon, lat of both ends): all segments that may be a point's nearest within the radius.

    Points are cut in halves; from the middle of their box at most the radius of the box is lost either way, so a segment
    that is farther than the nearest one by twice that is nearest to none of them.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    todo = [(np.arange(len(x)), np.arange(len(s[0])))]
    while todo:
        p, c = todo.pop()
        if len(p) and len(p) * len(c) > PAIRS:
            (x0, x1), (y0, y1) = ((v.min(), v.max()) for v in (x[p], y[p]))
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            east = 111_320.0 * np.cos(np.radians(np.array([my, y0, y1, np.clip(0.0, y0, y1)])))
            low, high = min(east) / east[0], max(east) / east[0]  # degrees east are not as long all over the box
            wide, tall = (x1 - x0) * east[0], (y1 - y0) * 110_540.0
            half = np.hypot(wide, tall) / 2
            d = _distances(np.array([mx]), np.array([my]), [v[c] for v in s])[0]
            c = c[low * (d - half) <= min(high * (d.min() + half), radius_m) + SLACK]
            if len(p) * len(c) > PAIRS and half > 0 and len(p) > 1:
                by = x[p] if wide > tall else y[p]
                order = np.argpartition(by, len(p) // 2)
                todo += [(p[order[: len(p) // 2]], c), (p[order[len(p) // 2 :]], c)]
                continue
        if not len(c):
            continue
        step = max(1, 8 * PAIRS // len(c))
        for k in range(0, len(p), step):
            some = p[k : k + step]
            d = _distances(x[some], y[some], [v[c] for v in s])
            i, j = np.nonzero(d <= np.minimum(d.min(axis=1), radius_m)[:, None] + SLACK)
            found.append((some[i], c[j]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _in_pieces(points: DataFrame, segments: DataFrame, piece: int) -> tuple[DataFrame, DataFrame]:
    """Both with i and j: a cell's points are dealt by i and its segments by j, so that no group has many more than ``piece`` of either."""
    counts = [staged(t.groupBy("cx", "cy").count().where(F.col("count") > piece).select("cx", "cy", F.ceil(F.col("count") / piece).cast("int").alias("n")), "full") for t in (points, segments)]
    of = (F.xxhash64("point_id", "x", "y"), F.xxhash64("edge_id", "part"))
    for own, other, full, row in (("i", "j", counts[0], of[0]), ("j", "i", counts[1], of[1])):
        mine, theirs = (points, segments) if own == "i" else (segments, points)
        if full.isEmpty():
            mine, theirs = mine.withColumn(own, F.lit(0)), theirs.withColumn(own, F.lit(0))
        else:
            mine = mine.join(bounded(full), ["cx", "cy"], "left").withColumn(own, F.coalesce(F.pmod(row, F.col("n")).cast("int"), F.lit(0))).drop("n")
            theirs = theirs.join(bounded(full), ["cx", "cy"], "left").withColumn(own, F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
        points, segments = (mine, theirs) if own == "i" else (theirs, mine)
    return points, segments


def around(points: DataFrame, radius_m: float = 50.0) -> tuple[float, float, float, float]:
    """West, south, east and north of all that is within the radius of a point; an empty box without points."""
    pad = radius_m / 110_000.0
    real = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    x0, y0, x1, y1 = real.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if x0 is None:
        return 0.0, 0.0, -1.0, -1.0
    wide = min(360.0, pad / max(1e-9, np.cos(np.radians(min(90.0, max(abs(y0), abs(y1)) + pad)))))
    return float(x0 - wide), float(y0 - pad), float(x1 + wide), float(y1 + pad)


def snap(points: DataFrame, edges: DataFrame, radius_m: float = 50.0, cell: float = CELL) -> DataFrame:
    """point_id, edge_id, share, distance_m, snap_x, snap_y of the nearest edge within the radius; ties go to the smaller edge id.

    Points are dealt to grid cells, segments to those that they come near, column by column, not to those of their whole box.
    Cells outside the points' box are not made. A task finds the segments that may be nearest to the points of a cell
    by halves of the points, not by all pairs; those few are compared and rounded as columns. ``share`` is along the segment; ``part`` numbers it;
    ``fraction`` is along the edge, by planar length.
    """
    python_ready(points.sparkSession)
    pad = radius_m / 110_000.0
    steps = F.transform(F.sequence(F.lit(1), F.size("geometry") - 1), lambda i: F.struct(F.get("geometry", i - 1).alias("a"), F.get("geometry", i).alias("b")))
    long = lambda s: F.hypot(s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"])
    e = edges.where(F.size("geometry") > 1).select("edge_id", steps.alias("steps")).withColumn("lengths", F.transform("steps", long))
    s = e.select("edge_id", "lengths", F.posexplode("steps").alias("part", "s")).select("edge_id", "part", "s.a", "s.b", "lengths")
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("part")), F.lit(0.0), lambda t, x: t + x)
    s = s.withColumns({"before": before, "whole": F.aggregate("lengths", F.lit(0.0), lambda t, x: t + x), "own": F.get("lengths", F.col("part"))}).drop("lengths")
    real = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    at_cell = lambda c: F.floor(F.col(c) / cell).cast("long")
    p = points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(real).withColumns({"cx": at_cell("x"), "cy": at_cell("y")})
    box = p.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    s = s.crossJoin(F.broadcast(box))  # one row
    both = lambda f, c: f(F.col("a")[c], F.col("b")[c])
    far = F.least(F.lit(90.0), F.greatest(*[F.abs(F.col(k)["lat"]) for k in "ab"]) + pad)  # where degrees east are shortest
    s = s.withColumn("wide", F.least(F.lit(360.0), pad / F.greatest(F.lit(1e-9), F.cos(F.radians(far)))))
    s = s.withColumn("cx", F.explode(_cells(both(F.least, "lon") - F.col("wide"), both(F.greatest, "lon") + F.col("wide"), cell, F.col("x0"), F.col("x1"))))
    # the segment's latitudes within reach of the column
    run = F.col("b.lon") - F.col("a.lon")
    at = lambda x: F.col("a.lat") + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.col("a.lon")) / run)) * (F.col("b.lat") - F.col("a.lat"))
    west, east = at(F.col("cx") * cell - F.col("wide")), at((F.col("cx") + 1) * cell + F.col("wide"))
    low, high = F.when(run == 0, both(F.least, "lat")).otherwise(F.least(west, east)), F.when(run == 0, both(F.greatest, "lat")).otherwise(F.greatest(west, east))
    s = s.withColumn("cy", F.explode(_cells(low - pad - 1e-9, high + pad + 1e-9, cell, F.col("y0"), F.col("y1"))))
    ends = [F.col(f"{k}.{c}").cast("double").alias(f"{k}_{c}") for k in "ab" for c in ("lon", "lat")]
    s = staged(s.select("cx", "cy", "edge_id", "part", *ends, "before", "whole", "own"), "segments")
    p, s = _in_pieces(p, s, PIECE)
    group = ("cx", "cy", "i", "j")
    schema = StructType([*p.select("point_id", "x", "y").schema, *s.select("edge_id", "part", "a_lon", "a_lat", "b_lon", "b_lat", "before", "whole", "own").schema])

    def meet(ps: pa.Table, ss: pa.Table) -> pa.Table:
        i, j = nearest_pairs(*[ps.column(c).to_numpy() for c in "xy"], [ss.column(c).to_numpy() for c in ("a_lon", "a_lat", "b_lon", "b_lat")], radius_m)
        ps, ss = ps.take(i), ss.take(j)
        return pa.table([(ps if c in ("point_id", "x", "y") else ss).column(c) for c in schema.names], names=schema.names)

    near = p.groupBy(*group).cogroup(s.groupBy(*group)).applyInArrow(meet, schema)
    end = lambda k: F.struct(F.col(f"{k}_lon").alias("lon"), F.col(f"{k}_lat").alias("lat"))
    near = near.withColumn("q", project(F.col("x"), F.col("y"), end("a"), end("b"))).where(F.col("q.distance_m") <= radius_m)
    fraction = F.when(F.col("whole") > 0, (F.col("before") + F.col("q.share") * F.col("own")) / F.col("whole")).otherwise(0.0)
    best = near.groupBy("point_id").agg(F.min(F.struct(F.round("q.distance_m", 3).alias("d"), "edge_id", "part", "q", fraction.alias("fraction"))).alias("m"))
    return best.select("point_id", "m.edge_id", "m.part", F.col("m.q.share").alias("share"), F.col("m.fraction").alias("fraction"), F.col("m.d").alias("distance_m"), F.col("m.q.lon").alias("snap_x"), F.col("m.q.lat").alias("snap_y"))
