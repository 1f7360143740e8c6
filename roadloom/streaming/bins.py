"""Counts and means by edge and time bin over a stream of observations, with late rows handled by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_bins(rows: DataFrame, every: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """edge_id, bin, n, mean of a streaming table (edge_id, time, value); a bin is closed when the watermark has passed it."""
    bins = rows.withWatermark("time", late).groupBy("edge_id", F.window("time", every).alias("w"))
    return bins.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("edge_id", F.col("w.start").alias("bin"), "n", "mean")
