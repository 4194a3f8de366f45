"""A pipeline: a streaming source, ``$match`` stages, a destination, a store.

Spark's checkpoint holds the offsets and is committed after the destination has
written an epoch; the store's token is saved after the write too.  A failed epoch
is written again under the same number, and destinations replace an epoch's
files, so nothing is lost or doubled.  An epoch ends by the source's admission
limit or by the trigger's time; in it, a batch of one collection ends at
``batch_size`` events, which is the most an object holds.

``run`` opens the stream again after errors of the source that allow it.
``stop`` drains: what the source holds at that moment is written before the
leases go back.  ``Workers`` runs one pipeline for each watched collection.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.functions import match as M
from changelake.functions.errors import category_of
from changelake.operators.normalize import normalize
from changelake.operators.state import images
from changelake.sinks.base import Destination, DestinationError, classify
from changelake.sources.replay import at_level
from changelake.streaming.config import PipelineConfig, WatchLevel
from changelake.streaming.metrics import Listener, Metrics
from changelake.streaming.reconnect import Reconnector, keep_open
from changelake.streaming.stores import LeaseKeeper, StateStore

log = logging.getLogger("changelake")


@dataclass
class Stats:
    events_processed: int = 0
    batches_written: int = 0
    write_errors: int = 0
    retries: int = 0
    reconnects: int = 0
    counts: dict[tuple[str, str], int] = field(default_factory=dict)


def write_with_retry(write: Callable[[], None], max_retries: int, delay: float, most: float, stats: Stats | None = None, sleep: Callable[[float], None] = time.sleep, tell: Callable[[str, str], None] = lambda what, category: None) -> None:
    """Up to 1 + max_retries tries, while errors are retryable; delays double up to ``most``.

    ``tell`` hears of each error and each retry, with the error's category.
    """
    stats, tries = stats or Stats(), 0
    while True:
        try:
            return write()
        except Exception as e:
            error: DestinationError = classify(e)
            category = category_of(f"{type(error).__name__} {error}")
            stats.write_errors += 1
            tell("error", category)
            tries += 1
            if tries > max_retries or not error.retryable:
                raise error from e
            stats.retries += 1
            tell("retry", category)
            sleep(error.retry_after if error.retry_after is not None else delay)
            delay = min(most, delay * 2)


class LockHeld(RuntimeError):
    pass


class Pipeline:
    """One streaming query over a watch level.

    ``sequence`` names a column that orders events, if there is one; a ``patient``
    pipeline waits for a lease that another holds, others do so until an orphan's
    lease would have run out.
    """

    def __init__(self, config: PipelineConfig, raw: DataFrame, destination: Destination, store: StateStore, checkpoint: str, sequence: str | None = "seq", metrics: Metrics | None = None, patient: bool = False):
        self.config, self.raw, self.destination, self.store, self.checkpoint, self.sequence, self.patient = config, raw, destination, store, checkpoint, sequence, patient
        self.owner = f"changelake-{uuid.uuid4()}"
        self.metrics = metrics if metrics is not None else Metrics()
        self.stats, self.query, self.keepers = Stats(), None, []
        self.newest: dict[str, tuple] = {}  # the furthest event of each key: a token never goes back
        self.ended: dict[str, int] = {}  # where invalidated collections ended
        self.guard, self.ending = threading.Lock(), threading.RLock()
        self.lost_lock, self.stopping = threading.Event(), threading.Event()
        self.reconnector = Reconnector(config.stream)
        self.listener: Listener | None = None
        self.kind = destination.metadata().kind
        if destination.limit is None:
            destination.limit = config.batch_size

    def events(self) -> DataFrame:
        """The stream of events: normalised, at the watch level, with images if asked for, through the filter stages."""
        level, stream = self.config.watch_level, self.config.stream
        raw = self.raw.observe("changelake_source", F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("_id").isNull(), 1)).alias("broken"))
        events = at_level(normalize(raw), level.kind, self.config.database, list(level.collections))
        if stream.images == "state" and (stream.full_document_on_update or stream.full_document_before_change):
            events = images(events, lookup=stream.full_document_on_update, before=stream.full_document_before_change, order=self.sequence or "cluster_time")
        return M.apply(events, list(stream.pipeline))

    def scopes(self) -> list[str | None]:
        level = self.config.watch_level
        return list(level.collections) if level.kind == "collection" else [None]

    # --- leases ---------------------------------------------------------------------------

    def _locks(self) -> None:
        lock, level = self.config.lock, self.config.watch_level
        for scope in self.scopes() if lock.enabled else []:
            key = level.lock_key(self.config.database, scope)
            until = time.monotonic() + lock.ttl + lock.retry_interval
            while not self._acquire(key):  # an orphan's lease runs out by then
                if self.stopping.is_set() or (not self.patient and time.monotonic() >= until):
                    self._release()
                    raise LockHeld(f"{key} is held by {self.store.holder(key)}")
                self.stopping.wait(min(lock.retry_interval, 0.2))
            self.metrics.count("lock_acquisitions_total")
            self.metrics.shift("locks_held", 1)
            self.keepers.append(LeaseKeeper(self.store, key, self.owner, lock.ttl, lock.refresh_interval, self._lost, lambda: self.metrics.count("lock_refreshes_total")).start())

    def _acquire(self, key: str) -> bool:
        try:
            got = self.store.acquire(key, self.owner, self.config.lock.ttl)
        except Exception:
            self.metrics.count("lock_acquisition_failures_total", reason="error")
            raise
        if not got:
            self.metrics.count("lock_acquisition_failures_total", reason="already_held")
        return got

    def _lost(self) -> None:
        log.error("a lease was lost; stopping")
        self.metrics.count("locks_lost_total")
        self.metrics.shift("locks_held", -1)
        self.lost_lock.set()
        self.stopping.set()
        if self.query is not None:
            self.query.stop()

    def _release(self) -> None:
        for k in self.keepers:
            if k.stop():
                self.metrics.count("locks_released_total")
                self.metrics.shift("locks_held", -1)
        self.keepers = []

    # --- flushing -------------------------------------------------------------------------

    def _end_key(self, collection: str) -> str:
        return f"invalidated:{self.config.database}:{collection}"

    def _cut(self, batch: DataFrame, found: list) -> tuple[DataFrame, list]:
        """Without events of watched collections from their first invalidate on."""
        if self.config.watch_level.kind != "collection" or not self.config.stream.stop_on_invalidate:
            return batch, found
        for r in found:
            if r.operation == "invalidate" and r.collection not in self.ended:
                self.ended[r.collection] = r.began
                self.store.save(self._end_key(r.collection), str(r.began))
        if not any(r.collection in self.ended for r in found):
            return batch, found
        place, stays = self._place(), F.lit(True)
        for collection, end in self.ended.items():
            at = (place < end) if self.sequence else (place <= end) & (F.col("operation") != "invalidate")
            stays = F.when(F.col("collection") == collection, at).otherwise(stays)
        batch = batch.where(stays)
        return batch, self._found(batch)

    def _place(self):
        return F.col(self.sequence).cast("long") if self.sequence else F.unix_micros("cluster_time")

    def _found(self, batch: DataFrame) -> list:
        """A row for each collection and operation of a batch: bounded by their number."""
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("document_key", "full_document", "resume_token")), F.lit(0))
        order = F.struct(*([self.sequence] if self.sequence else []), "cluster_time")
        return (
            batch.groupBy("collection", "operation")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.min(self._place()).alias("began"), F.unix_micros(F.max("cluster_time")).alias("newest"), F.max(F.struct(order.alias("at"), "resume_token")).alias("last"))
            .collect()
        )

    def _tell(self, what: str, category: str) -> None:
        if what == "retry":
            self.metrics.count("retries_total", error_type=category)
        else:
            self.metrics.count("destination_write_errors_total", destination_type=self.kind, error_type=category)

    def flush(self, batch: DataFrame, epoch: int) -> None:
        """One epoch: write with retries, then save tokens, then count."""
        if self.lost_lock.is_set():
            raise RuntimeError("the lease was lost")
        level, metrics, start = self.config.watch_level, self.metrics, time.monotonic()
        batch = batch.persist()
        sizes: dict[str, int] = {}
        try:
            chosen, found = self._cut(batch, self._found(batch))
            if not found:
                return
            for r in found:
                sizes[r.collection] = sizes.get(r.collection, 0) + r.n
            metrics.gauge("active_collections", len(sizes))
            for c, n in sizes.items():
                metrics.gauge("batch_queue_size", n, collection=c)
                metrics.observe("change_stream_lag_seconds", max(0.0, time.time() - max(r.newest for r in found if r.collection == c) / 1e6), collection=c)
            writing = time.monotonic()
            try:
                write_with_retry(lambda: self.destination.write_batch(chosen, epoch), self.config.max_retries, self.config.retry_delay, self.config.max_retry_delay, self.stats, tell=self._tell)
                self.destination.flush()
            except Exception as e:
                for c, n in sizes.items():
                    metrics.count("events_failed_total", n, collection=c, error_type=category_of(f"{type(e).__name__} {e}"))
                raise
            metrics.observe("destination_write_duration_seconds", time.monotonic() - writing, destination_type=self.kind)
            metrics.observe("destination_write_bytes", sum(r.bytes for r in found), destination_type=self.kind)
            for r in found:
                key = level.resume_token_key(self.config.database, r.collection if level.kind == "collection" else None)
                self.newest[key] = max(self.newest.get(key, ((), "")), (tuple(r["last"]["at"]), r["last"]["resume_token"]))
                self.store.save(key, self.newest[key][1])
            batches = sum(-(-n // self.config.batch_size) for n in sizes.values())
            with self.guard:
                for r in found:
                    self.stats.events_processed += r.n
                    self.stats.counts[r.collection, r.operation] = self.stats.counts.get((r.collection, r.operation), 0) + r.n
                    metrics.count("events_processed_total", r.n, collection=r.collection, operation=r.operation)
                self.stats.batches_written += batches
            metrics.count("batches_written_total", batches, destination_type=self.kind)
            took = time.monotonic() - start
            for c, n in sizes.items():
                metrics.gauge("batch_queue_size", 0, collection=c)
                metrics.observe("batch_duration_seconds", took, collection=c)
                for _ in range(n // self.config.batch_size):
                    metrics.observe("batch_size", self.config.batch_size, collection=c)
                if rest := n % self.config.batch_size:
                    metrics.observe("batch_size", rest, collection=c)
            self.reconnector.active()
        finally:
            batch.unpersist()

    # --- running --------------------------------------------------------------------------

    def _open(self, once: bool = False) -> None:
        name = f"changelake {self.config.database} {uuid.uuid4()}"
        self._unlisten()
        self.listener = Listener(self.metrics, self.config.database, name)
        self.raw.sparkSession.streams.addListener(self.listener)
        writer = self.events().writeStream.queryName(name).foreachBatch(self.flush).option("checkpointLocation", self.checkpoint)
        trigger = {"availableNow": True} if once else {"processingTime": f"{self.config.batch_timeout} seconds"}
        self.query = writer.trigger(**trigger).start()
        self.metrics.gauge("pipeline_status", 1)

    def _unlisten(self) -> None:
        if self.listener is not None:
            if self.query is not None and self.listener.runs:
                self.listener.ended.wait(5)  # events come on a thread of their own
            self.raw.sparkSession.streams.removeListener(self.listener)
            self.listener = None

    def start(self, once: bool = False) -> Pipeline:
        """Take the leases and start the query; ``once`` takes what is there and ends."""
        for c in self.scopes():
            if c is not None and (end := self.store.get(self._end_key(c))) is not None:
                self.ended[c] = int(end)
        self._locks()
        self._open(once)
        return self

    def run(self, once: bool = False) -> Stats:
        """Start, and stay until the stream ends or ``stop`` is called; opens the stream again after a source's errors."""
        opened = False

        def open_() -> None:
            nonlocal opened
            if opened:
                self.stats.reconnects += 1
                self._open(once)
            else:
                opened = True
                self.start(once)

        try:
            keep_open(open_, lambda: self.query.awaitTermination(), self.reconnector, self.stopping.wait)
        finally:
            self.stop(drain=False)
        return self.stats

    def run_once(self) -> Stats:
        return self.run(once=True)

    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def stop(self, drain: bool = True) -> None:
        """End the query, write what the source holds by now, give the leases back, close the destination.

        Ending may break off an epoch; draining writes it again under its number.
        Without a lease, or after a failure, nothing is drained.
        """
        self.stopping.set()
        with self.ending:
            running = self.is_running()
            if running:
                self.query.stop()
            try:
                if drain and running and not self.lost_lock.is_set():
                    self._open(once=True)
                    self.query.awaitTermination()
            finally:
                self.reconnector.close()
                self._release()
                self._unlisten()
                self.metrics.gauge("pipeline_status", 0)
                self.destination.close()


class Workers:
    """A pipeline for each watched collection, with a query, checkpoint, token, lease and destination of its own.

    A collection whose lease is held elsewhere is waited for until ``stop``, so
    what another process gives up is taken over.
    """

    def __init__(self, config: PipelineConfig, raw: DataFrame, destination: Callable[[str], Destination], store: StateStore, checkpoint: str, sequence: str | None = "seq", metrics: Metrics | None = None):
        self.metrics = metrics if metrics is not None else Metrics()
        level = lambda c: replace(config, watch_level=WatchLevel("collection", (c,)))
        self.pipelines = {c: Pipeline(level(c), raw, destination(c), store, f"{checkpoint.rstrip('/')}/{c}", sequence, self.metrics) for c in config.watch_level.collections}
        self.threads: list[threading.Thread] = []
        self.errors: dict[str, Exception] = {}

    def _run(self, name: str, once: bool) -> None:
        pipeline = self.pipelines[name]
        try:
            pipeline.run(once)
        except Exception as e:
            if not (isinstance(e, LockHeld) and pipeline.stopping.is_set()):
                log.error("%s: %s", name, e)
                self.errors[name] = e

    def start(self, once: bool = False) -> Workers:
        for p in self.pipelines.values():
            p.patient = not once
        self.threads = [threading.Thread(target=self._run, args=(c, once), daemon=True) for c in self.pipelines]
        for t in self.threads:
            t.start()
        return self

    def run_once(self) -> dict[str, Stats]:
        """Take what is there, all collections at a time; the first error of any is raised in the end."""
        self.start(once=True)
        for t in self.threads:
            t.join()
        if self.errors:
            raise next(iter(self.errors.values()))
        return {c: p.stats for c, p in self.pipelines.items()}

    def stop(self, drain: bool = True) -> None:
        for p in self.pipelines.values():
            p.stopping.set()
        for p in self.pipelines.values():
            p.stop(drain)
        for t in self.threads:
            t.join(timeout=60)
