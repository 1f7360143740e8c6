"""Ways that a mode of travel may use, with direction, lanes and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.tags import first_integer, is_in, most_specific, spread, tag

MODES = ("driving", "walking", "cycling")

# Classes of roads and words of tags, as mappers use them.
CAR_ROADS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary",
    "tertiary_link", "unclassified", "residential", "service", "living_street", "road", "busway",
)
FOOT_ROADS = (
    "footway", "path", "pedestrian", "steps", "living_street", "residential", "service", "platform", "corridor", "track", "bridleway",
    "road", "unclassified", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
)
BIKE_ROADS = (
    "cycleway", "path", "track", "bridleway", "living_street", "residential", "service", "unclassified", "primary", "primary_link",
    "secondary", "secondary_link", "tertiary", "tertiary_link",
)
NO_CARS = ("footway", "path", "cycleway", "steps", "pedestrian", "bridleway", "corridor", "platform")
PATHS = ("footway", "path", "cycleway", "steps", "pedestrian", "bridleway", "corridor")
ALLOWED = ("yes", "designated", "permissive")
YES = ("yes", "1", "true")
CLOSED = {"driving": ("no", "agricultural", "forestry", "emergency"), "walking": ("no",), "cycling": ("no",)}
ACCESS_KEYS = {"driving": ("motorcar", "motor_vehicle", "vehicle", "access"), "walking": ("foot", "access"), "cycling": ("bicycle", "vehicle", "access")}

TAGS = ("highway", "route", "name", "maxspeed", "junction", "oneway", "oneway:foot", "oneway:bicycle", "oneway:bus", "oneway:psv", "access", "vehicle", "motor_vehicle", "motorcar", "foot", "bicycle", "cycleway", "motorroad", "sidewalk", "sidewalk:both", "sidewalk:left", "sidewalk:right", "lanes", "lanes:forward", "lanes:backward", "lanes:reversible", "surface", "layer", "bridge", "tunnel", "service")
CARRIED = ("surface", "junction", "layer", "bridge", "tunnel", "service")


def shared_street() -> Column:
    """A pedestrian street that lets cars in."""
    cars = is_in(most_specific("motorcar", "motor_vehicle"), ALLOWED) | is_in(tag("access"), ("delivery", "destination", "agricultural"))
    return is_in(tag("highway"), ("pedestrian",)) & cars


def may_use(mode: str) -> Column:
    highway = tag("highway")
    if mode == "driving":
        return is_in(highway, (*CAR_ROADS, "pedestrian"))
    if mode == "walking":
        apart = is_in(tag("sidewalk"), ("separate",)) | is_in(tag("sidewalk:both"), ("separate",)) | (is_in(tag("sidewalk:left"), ("separate",)) & is_in(tag("sidewalk:right"), ("separate",)))
        plain = is_in(highway, FOOT_ROADS) & ~is_in(tag("motorroad"), ("yes",)) & ~is_in(tag("foot"), ("use_sidepath",)) & ~apart
        return ~is_in(highway, ("motorway", "motorway_link")) & (is_in(tag("foot"), ALLOWED) | is_in(tag("sidewalk"), ("yes", "both", "left", "right")) | plain)
    track = tag("cycleway").isNotNull() & ~is_in(tag("cycleway"), ("no", "none", "separate"))
    return is_in(highway, (*BIKE_ROADS, "footway", "pedestrian")) | is_in(tag("bicycle"), ALLOWED) | track


def direction(mode: str) -> Column:
    """1 along the way as drawn, -1 against it, 0 both."""
    by = lambda key, otherwise: F.when(is_in(tag(key), YES), 1).when(is_in(tag(key), ("-1",)), -1).otherwise(otherwise)
    if mode == "walking":
        return by("oneway:foot", 0)
    ring = is_in(tag("junction"), ("roundabout", "circular"))
    if mode == "driving":
        explicit_no = is_in(tag("oneway"), ("no", "false", "0"))
        implied = F.when(is_in(tag("highway"), ("motorway", "motorway_link")) & ~explicit_no, 1).otherwise(0)
        return F.when(ring, 1).otherwise(by("oneway", implied))
    pushed = is_in(tag("highway"), ("footway", "pedestrian")) & ~is_in(tag("bicycle"), ALLOWED)
    ridden = F.when(ring, 1).otherwise(by("oneway", 0))
    return F.when(pushed | is_in(tag("oneway:bicycle"), ("no",)), 0).otherwise(by("oneway:bicycle", ridden))


#: Lane counts that the rules name many times over, so they are columns.
COUNTS = ("n_total", "n_forward", "n_backward", "n_both")


def with_counts(df: DataFrame) -> DataFrame:
    total, fwd, bwd, both = (first_integer(tag(k)) for k in ("lanes", "lanes:forward", "lanes:backward", "lanes:reversible"))
    return df.withColumns(dict(zip(COUNTS, (total, fwd, bwd, F.coalesce(both, F.lit(0))), strict=True)))


def car_lanes(car_dir: Column, contraflow_bus: Column) -> tuple[Column, Column]:
    """Lanes along the cars' direction and against it. A reversible lane counts for both; roads without cars have none."""
    total, fwd, bwd, both = map(F.col, COUNTS)
    usual = F.when(is_in(tag("highway"), ("motorway", "trunk")), 2).otherwise(1)
    at_least_one = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(1)))
    less = lambda other: at_least_one(total - F.when(contraflow_bus, F.coalesce(other, F.lit(1))).otherwise(0))
    forward = (
        F.when(car_dir == -1, F.coalesce(bwd, less(fwd), usual))
        .when(car_dir == 1, F.coalesce(fwd, less(bwd), usual))
        .otherwise(F.coalesce(fwd, at_least_one(total - bwd), at_least_one(F.ceil(total / 2).cast("int")), usual))
    )
    backward = F.coalesce(bwd, at_least_one(total - fwd), at_least_one(F.floor(total / 2).cast("int")), usual)
    cars = ~is_in(F.split_part(F.coalesce(tag("highway"), F.lit("")), F.lit(";"), F.lit(1)), NO_CARS)
    return F.when(cars, forward + both).cast("int"), F.when(cars & ((car_dir == 0) | contraflow_bus), backward + both).cast("int")


def mode_ways(raw_ways: DataFrame, mode: str) -> DataFrame:
    """raw ways (osm_id, tags, refs) → a way's class, direction, access, lanes and other attributes, and its refs in legal order.

    ``bus_back``: buses may run against the one-way; ``against``: the legal direction is against the drawing.
    """
    contra = is_in(tag("oneway:bus"), ("no",)) | is_in(tag("oneway:psv"), ("no",))
    access = most_specific(*ACCESS_KEYS[mode])
    if mode == "driving":
        walked = is_in(tag("highway"), ("pedestrian",)) & ~shared_street()
        access = F.when(is_in(tag("highway"), ("busway",)), "bus").when(walked, F.coalesce(F.when(is_in(access, ("private", "delivery", *CLOSED["driving"])), access), F.lit("pedestrian"))).otherwise(access)
    real = tag("highway").isNotNull() | is_in(tag("route"), ("ferry",))
    x = with_counts(spread(raw_ways, TAGS).where(may_use(mode) & real))
    x = x.withColumns({"dir": direction(mode), "car_dir": direction("driving"), "contra": contra, "acc": access})
    x = x.where(~is_in(F.col("acc"), CLOSED[mode]))
    contra, access = F.col("contra"), F.col("acc")
    x = x.withColumns(dict(zip(("along", "counter"), car_lanes(F.col("car_dir"), contra), strict=True)))
    along, against = F.col("along"), F.col("counter")
    turned = (F.col("dir") == -1) != (F.col("car_dir") == -1)
    name = F.when(shared_street(), "living_street") if mode == "driving" else F.lit(None).cast("string")
    bus_back = (F.col("dir") != 0) & contra if mode == "driving" else F.lit(False)
    return x.select(
        "osm_id",
        F.coalesce(name, tag("highway"), F.when(is_in(tag("route"), ("ferry",)), "ferry")).alias("highway"),
        tag("name").alias("name"),
        tag("maxspeed").alias("maxspeed"),
        (F.col("dir") != 0).alias("oneway"),
        bus_back.alias("bus_back"),
        (F.col("dir") == -1).alias("against"),
        access.alias("access"),
        *[tag(k).alias(k) for k in CARRIED],
        F.when(turned, against).otherwise(along).alias("lanes_fwd"),
        F.when(turned, along).otherwise(against).alias("lanes_bwd"),
        F.when(F.col("dir") == -1, F.reverse("refs")).otherwise(F.col("refs")).alias("refs"),
    )
