"""Reading tags of a MAP<STRING, STRING> column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(key: str) -> Column:
    """The column that ``spread`` makes of a tag."""
    return F.col(f"`tag:{key}`")


def spread(df: DataFrame, keys) -> DataFrame:
    """``df`` with a column for each tag instead of ``tags``; as it is, if it has these columns already.

    Rules name tags many times over: stage the result, else each mention looks the map up again.
    """
    if "tags" not in df.columns:
        return df
    return df.select(*[c for c in df.columns if c != "tags"], *[F.element_at(F.col("tags"), F.lit(k)).alias(f"tag:{k}") for k in keys])


def most_specific(*keys: str) -> Column:
    return F.coalesce(*map(tag, keys))


def is_in(column: Column, values) -> Column:
    """Membership that is false, not null, for a missing tag."""
    return F.coalesce(column.isin(*values), F.lit(False))


def first_integer(column: Column) -> Column:
    """The first whole number in a tag; null if there is none or it is 0."""
    n = F.nullif(F.regexp_extract(column, r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.nullif(n, F.lit(0))


def merge_tags(old: Column, new: Column) -> Column:
    """Both maps in one; of a key in both the new value counts."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
