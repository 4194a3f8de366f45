"""Counters, gauges and histograms of pipelines.

A ``Pipeline`` feeds its registry itself as it takes leases and flushes; a query
listener adds what only Spark knows: whether the query runs, and lines of the
source that were no event.
"""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds of histogram buckets; an endless one follows.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 100, 1000, 10_000, 1e6, 1e9)


class Metrics:
    """A registry; values by name and labels.  Histograms keep counts of buckets and exact sums, no values."""

    def __init__(self, bounds: tuple[float, ...] = BOUNDS) -> None:
        self.guard, self.bounds = threading.Lock(), bounds
        self.counters: dict[tuple, float] = defaultdict(float)
        self.gauges: dict[tuple, float] = {}
        self.histograms: dict[tuple, list[float]] = {}  # a count for each bucket, and the sum

    @staticmethod
    def _key(name: str, labels: dict[str, str]) -> tuple:
        return name, *sorted(labels.items())

    def count(self, name: str, by: float = 1, **labels: str) -> None:
        with self.guard:
            self.counters[self._key(name, labels)] += by

    def gauge(self, name: str, value: float, **labels: str) -> None:
        with self.guard:
            self.gauges[self._key(name, labels)] = value

    def shift(self, name: str, by: float, **labels: str) -> None:
        """Move a gauge, which starts at 0."""
        key = self._key(name, labels)
        with self.guard:
            self.gauges[key] = self.gauges.get(key, 0) + by

    def observe(self, name: str, value: float, **labels: str) -> None:
        key = self._key(name, labels)
        with self.guard:
            held = self.histograms.setdefault(key, [0] * (len(self.bounds) + 1) + [0.0])
            held[bisect_left(self.bounds, value)] += 1
            held[-1] += value

    def value(self, name: str, **labels: str) -> float:
        """A counter's or gauge's value, or how often a histogram was fed."""
        key = self._key(name, labels)
        with self.guard:
            if key in self.histograms:
                return sum(self.histograms[key][:-1])
            return self.gauges.get(key, self.counters.get(key, 0))

    def text(self) -> str:
        """Lines in the common exposition format."""

        def line(key: tuple, value: float, suffix: str = "", *more: tuple[str, str]) -> str:
            labels = ",".join(f'{k}="{v}"' for k, v in (*key[1:], *more))
            return f"changelake_{key[0]}{suffix}{{{labels}}} {value:.15g}"

        with self.guard:
            out = [line(k, v) for k, v in sorted(self.counters.items())] + [line(k, v) for k, v in sorted(self.gauges.items())]
            for k, held in sorted(self.histograms.items()):
                below = 0
                for bound, n in zip((*(f"{b:g}" for b in self.bounds), "+Inf"), held, strict=False):
                    below += n
                    out.append(line(k, below, "_bucket", ("le", bound)))
                out += [line(k, below, "_count"), line(k, held[-1], "_sum")]
        return "\n".join(out) + "\n"


class Listener(StreamingQueryListener):
    """Feeds a registry from one query's events; queries go by ``name``, or all of a session where it is None."""

    def __init__(self, metrics: Metrics, label: str, name: str | None = None):
        self.metrics, self.label, self.name, self.runs = metrics, label, name, set()
        self.ended = threading.Event()  # the query's last event is here

    def _mine(self, event) -> bool:
        return self.name is None or event.runId in self.runs

    def onQueryStarted(self, event) -> None:
        if self.name is None or event.name == self.name:
            self.runs.add(event.runId)
            self.metrics.gauge("pipeline_status", 1)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is not None and p.name != self.name:
            return
        seen = p.observedMetrics.get("changelake_source")
        if seen is not None and seen["broken"]:
            self.metrics.count("events_failed_total", seen["broken"], collection=self.label, error_type="serialization_error")

    def onQueryIdle(self, event) -> None:
        if self._mine(event):
            self.metrics.gauge("batch_queue_size", 0, collection=self.label)

    def onQueryTerminated(self, event) -> None:
        if self._mine(event):
            self.metrics.gauge("pipeline_status", 0)
            self.ended.set()
