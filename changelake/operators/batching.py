"""Assigning events to batches: by size or time, by count, and by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tick(time: str, timeout_us: int, start_us: int = 0) -> Column:
    """The timer interval of a time: a fixed-rate timer that size flushes don't reset."""
    return F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.lit(start_us)) / F.lit(timeout_us)).cast("long")


def size_or_time(events: DataFrame, size: int, timeout_us: int, start_us: int = 0, worker: str = "collection", order: str = "event_id", time: str = "cluster_time") -> DataFrame:
    """Add tick and chunk: a batch ends at ``size`` events or at a timer tick.

    Within a worker's tick, chunks count up from 0.  The window is partitioned by
    worker and tick, so no worker's whole log meets in one task.
    """
    ticked = events.withColumn("tick", tick(time, timeout_us, start_us))
    within = Window.partitionBy(worker, "tick").orderBy(order)
    return ticked.withColumn("chunk", F.floor((F.row_number().over(within) - 1) / F.lit(size)).cast("long"))


def numbered(rows: DataFrame, order: str, width: int = 1 << 16) -> DataFrame:
    """Add row_index: each row's place (from 0) in the order of an integer column.

    Rows are counted by ranges of ``width`` values; ranges before a row come from
    a sum over these counts, places within a range from a window over the range.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(order) / F.lit(width)))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    # One row a range: 65,536 times fewer than there are rows.
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__range", "before")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return ranged.join(before, "__range").withColumn("row_index", (F.col("before") + place).cast("long")).drop("__range", "before")


def fixed(events: DataFrame, size: int, order: str = "event_id") -> DataFrame:
    """Add batch: consecutive runs of ``size`` events."""
    return numbered(events, order).withColumn("batch", F.floor(F.col("row_index") / F.lit(size)).cast("long")).drop("row_index")


def by_bytes(events: DataFrame, limit: int, size: Column, keys: list[str], order: str = "event_id") -> DataFrame:
    """(keys, order, bytes, batch): a batch closes before it would pass ``limit``; one event may pass it alone.

    The rule is a recurrence, so each group of ``keys`` is one sequential pass
    over two numbers a row.  Put a tick into the keys to bound the groups.
    """
    sized = events.select(*keys, order, size.cast("long").alias("bytes")).repartition(*keys).sortWithinPartitions(*keys, order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema.fields) + ", batch long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The group that the last frame ended in, the bytes of its open batch (none yet: None), and that batch's number.
        last, held, batch = None, None, 0
        for frame in frames:
            n, sizes = len(frame), frame["bytes"].to_numpy(np.int64)
            total = np.concatenate([[0], np.cumsum(sizes)])
            fresh = np.ones(n, bool)
            if n > 1:
                fresh[1:] = np.any([(frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1]) for k in keys], axis=0)
            starts = np.flatnonzero(fresh) if n else np.array([], int)
            out = np.empty(n, np.int64)
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                group = tuple(frame[k].iat[a] for k in keys)
                if group != last:
                    last, held, batch = group, None, 0
                at = a
                while at < b:
                    # Rows up to here still fit; an empty batch takes one row whatever its size.
                    end = int(np.searchsorted(total, total[at] + limit - (held or 0), "right")) - 1
                    end = min(b, max(end, at + 1 if held is None else at))
                    out[at:end] = batch
                    if end < b:
                        held, batch = None, batch + 1
                    else:
                        held = (held or 0) + int(total[end] - total[at])
                    at = end
            yield frame.assign(batch=out)

    return sized.mapInPandas(run, schema)


def capped(events: DataFrame, size: int, rows: int, worker: str = "collection", order: list[str] = ("cluster_time", "resume_token"), bucket: int = 32) -> DataFrame:
    """Add lane and chunk: runs of at most ``size`` events of a worker, in a micro-batch of about ``rows`` events.

    A micro-batch of more than ``bucket`` batches is dealt over lanes by a hash of
    the token, so the window of a worker with most of the events is spread.  The
    same events get the same lanes and chunks again.
    """
    lanes = max(1, -(-rows // (size * bucket)))
    dealt = events.withColumn("lane", F.pmod(F.xxhash64("resume_token"), F.lit(lanes)).cast("int"))
    within = Window.partitionBy(worker, "lane").orderBy(*order)
    return dealt.withColumn("chunk", F.floor((F.row_number().over(within) - 1) / F.lit(size)).cast("long"))


def simulate_size_or_time(times_us: list[int], size: int, timeout_us: int, start_us: int = 0) -> list[int]:
    """Batch sizes of one worker, by running its loop: the reference for tests."""
    out, held, due = [], 0, start_us + timeout_us
    for t in times_us:
        while t >= due:
            if held:
                out.append(held)
                held = 0
            due += timeout_us
        held += 1
        if held >= size:
            out.append(held)
            held = 0
    return [*out, held] if held else out
