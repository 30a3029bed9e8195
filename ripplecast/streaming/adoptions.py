"""Streams of adoptions: first adoptions and activity windows, by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_adoptions(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(u, i, at) of a stream with a timestamp at: each user and item once within the watermark, the first to arrive."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["u", "i"]).select("u", "i", "at")


def activity_windows(stream: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, i, n): adoptions of an item a window, sent once the watermark has passed it."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "i").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "i", "n")


def influence_logs(stream: DataFrame, edges: DataFrame, delta: int, late: str = "1 day") -> DataFrame:
    """(u, v, i, at_u, at_v): arcs u -> v where v's adoption follows u's by at most delta seconds.

    A stream-stream interval join: state is kept for delta and the watermark only.  edges is a static table.
    """
    once = first_adoptions(stream, late)
    a = once.join(edges.select("u", "v"), "u").select("u", "v", F.col("i").alias("ia"), F.col("at").alias("at_u"))
    b = first_adoptions(stream, late).select(F.col("u").alias("vb"), "i", F.col("at").alias("at_v"))
    met = a.join(b, (F.col("ia") == F.col("i")) & (F.col("v") == F.col("vb")) & (F.col("at_v") > F.col("at_u")) & (F.col("at_v") <= F.col("at_u") + F.expr(f"interval {delta} seconds")))
    return met.select("u", "v", "i", "at_u", "at_v")
