"""Drift of an incoming table against a stored reference, by event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift as D


def windowed_bins(stream: DataFrame, stored: DataFrame, ts: str, features: list[str], length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, feature, bin, cnt) of a stream or a table; rows later than the watermark are dropped."""
    long = D.melt(stream.withWatermark(ts, late), features, [ts])
    held = long.join(F.broadcast(stored.select("feature", "edges")), "feature").where("value IS NOT NULL")  # a row per feature
    return held.groupBy(F.window(ts, length).alias("window"), "feature", D.bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def window_report(bins: DataFrame, stored: DataFrame) -> DataFrame:
    """(window, feature, psi, severity) of complete windows' bin counts."""
    windows = bins.select("window", "feature").distinct()
    every = windows.join(stored.select("feature", F.posexplode("counts").alias("bin", "r")), "feature")
    reference = every.select("window", "feature", "bin", F.col("r").alias("cnt"))
    return D.psi(reference, bins, ["window"], "bin").withColumn("severity", D.severity(F.col("psi")))


def run_drift(stream: DataFrame, stored: DataFrame, ts: str, features: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, length: str = "1 day", late: str = "1 hour"):
    """Starts a query that hands the report of each finished window to sink, and returns it."""

    def report(batch: DataFrame, number: int) -> None:
        sink(window_report(batch, stored), number)

    bins = windowed_bins(stream, stored, ts, features, length, late)
    return bins.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(report).start()
