"""Pipeline health as windowed queries.

Rates are exact counts over a window divided by its length; there is no
extrapolation at the edges and there are no counter resets to handle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(seconds: int, time: str = "cluster_time") -> Column:
    """The window of a time, numbered since 1970."""
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def rate(events: DataFrame, seconds: int, by: list[str], time: str = "cluster_time") -> DataFrame:
    """(by, bucket, n, per_second) of each window with events."""
    counted = events.groupBy(*by, bucket(seconds, time).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("per_second", F.round(F.col("n") / F.lit(float(seconds)), 6))


def offset_rate(rates: DataFrame, windows: int, by: list[str]) -> DataFrame:
    """Add before and change: the same series some windows earlier."""
    earlier = rates.select(*by, (F.col("bucket") + windows).alias("bucket"), F.col("n").alias("before"))
    return rates.join(earlier, [*by, "bucket"], "left").withColumn("change", F.col("n") - F.coalesce("before", F.lit(0)))


def error_share(events: DataFrame, failed: Column, by: list[Column | str]) -> DataFrame:
    """(by, n, failed, error_pct, success_pct)."""
    out = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(failed, 1)).alias("failed"))
    share = F.col("failed") * F.lit(100.0) / F.col("n")
    return out.withColumn("error_pct", F.round(share, 6)).withColumn("success_pct", F.round(F.lit(100.0) - share, 6))


def gaps(events: DataFrame, seconds: int, by: str, time: str = "cluster_time") -> DataFrame:
    """(by, after_bucket, silent): runs of windows without an event between windows with some."""
    seen = events.select(by, bucket(seconds, time).alias("bucket")).distinct()
    following = F.lead("bucket").over(Window.partitionBy(by).orderBy("bucket"))
    return seen.withColumn("silent", following - F.col("bucket") - 1).where("silent > 0").select(by, F.col("bucket").alias("after_bucket"), "silent")


def lag(events: DataFrame, seen: Column, by: list[str], time: str = "cluster_time") -> DataFrame:
    """(by, n, mean_lag, most_lag): seconds from an event's time to ``seen``, the time at which it was taken."""
    late = F.greatest(F.lit(0), F.unix_micros(seen) - F.unix_micros(F.col(time).cast("timestamp")))
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(late) / F.count(F.lit(1)) / F.lit(1e6), 6).alias("mean_lag"), F.round(F.max(late) / F.lit(1e6), 6).alias("most_lag"))


def histogram(events: DataFrame, value: str, bounds: list[float], by: list[Column | str]) -> DataFrame:
    """(by, n, at_most): events, and how many of them lie at or below each bound.  A sum, so tasks send one row a group."""
    counts = [F.count(F.when(F.col(value) <= F.lit(float(b)), 1)) for b in bounds]
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.array(*counts).alias("at_most"))


def histogram_quantile(q: float, bounds: list[float], n: str = "n", at_most: str = "at_most") -> Column:
    """The quantile that a histogram shows: linear within a bucket, from 0 on in the first; the last bound beyond it."""
    rank = F.lit(float(q)) * F.col(n)
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, before = (F.lit(float(bounds[i - 1])), F.col(at_most)[i - 1]) if i else (F.lit(0.0), F.lit(0))
        inside = F.col(at_most)[i] - before
        share = F.when(inside > 0, (rank - before) / inside).otherwise(F.lit(1.0))
        out = F.when(F.col(at_most)[i] >= rank, low + (F.lit(float(bounds[i])) - low) * share).otherwise(out)
    return F.when(F.col(n) > 0, out)


def not_running(events: DataFrame, seconds: int, by: str, order: str, time: str = "cluster_time") -> DataFrame:
    """(by, bucket, status): windows whose last event says that the stream ended (status 0, not 1)."""
    last = events.groupBy(by, bucket(seconds, time).alias("bucket")).agg(F.max_by("operation", order).alias("last"))
    return last.withColumn("status", F.when(F.col("last") == "invalidate", 0).otherwise(1)).where("status <> 1").select(by, "bucket", "status")


def lock_alerts(replayed: DataFrame) -> DataFrame:
    """(key, lost, held): keys with a lease that was lost (a refresh that failed), or with no holder in the end."""
    lost = F.count(F.when((F.col("action") == "refresh") & ~F.col("ok"), 1))
    held = F.when(F.max(F.struct("seq", "holder"))["holder"].isNull(), 0).otherwise(1)
    return replayed.groupBy("key").agg(lost.alias("lost"), held.alias("held")).where("lost > 0 OR held = 0")
