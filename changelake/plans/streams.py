"""Queries that run a stream through the pipeline, and Spark's own windowed streams."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import functions as F

from changelake import schema
from changelake.functions import events as E
from changelake.operators.state import token_sequence
from changelake.plans.changelog import CHG, changelog, workspace
from changelake.plans.events import COMPACT_SQL
from changelake.plans.registry import query
from changelake.sinks.base import ConnectionFailed
from changelake.sinks.buckets import ObjectDestination
from changelake.sinks.files import FileDestination, read, read_objects
from changelake.sources.replay import ReplaySource, ReplayStream, SourceError, watch
from changelake.streaming.config import LockConfig, PipelineConfig, StreamConfig, WatchLevel
from changelake.streaming.pipeline import Pipeline, Workers
from changelake.streaming.stores import MemoryStore


#: Events of a published file at most, about, which bounds the task that sorts and writes it.
FILE = 250_000


def publish(spark, sf_dir, path, files=4, log=None):
    """The change log as JSON lines, in files ordered by sequence: ``files``, or a multiple of it for a large log, which is returned."""
    log = changelog(spark, sf_dir) if log is None else log
    times = max(1, -(-log.count() // (files * FILE)))
    line = F.concat(F.regexp_replace(E.json_line(), r"\}$", ""), F.lit(',"seq":'), F.col("event_id").cast("string"), F.lit("}"))
    log.repartitionByRange(files * times, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return times


def _config(**options):
    return PipelineConfig(**{"database": "testdb", "batch_size": 10_000, "lock": LockConfig(enabled=False)} | options)


def _flat(events):
    return events.select(*schema.FLAT7).withColumn("cluster_time", F.col("cluster_time").cast("timestamp_ntz"))


def _read(spark, path):
    return _flat(read(spark, path, "parquet"))


def _replay(spark, path, source=ReplaySource, max_files=1, **options):
    """The published log by the replay source: files in the order of their names, ``max_files`` a micro-batch."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(path=path, suffix=".txt", level="deployment", max_files=max_files, **options).load()


@query(CHG + COMPACT_SQL)
def q_stream_replay_pipeline(spark, sf_dir):
    root = workspace(spark)
    times = publish(spark, sf_dir, f"{root}/log")
    sink = FileDestination(f"{root}/out", "parquet", layout="collection")
    Pipeline(_config(), watch(spark, f"{root}/log", max_files=times), sink, MemoryStore(), f"{root}/checkpoint").run_once()
    return _read(spark, f"{root}/out")


class FailsOnce(FileDestination):
    """Writes the second epoch's files, and then fails as if the process had died."""

    def _write(self, batch, epoch):
        super()._write(batch, epoch)
        if epoch == 1:
            raise ConnectionFailed("connection lost after the write")


@query(CHG + COMPACT_SQL)
def q_stream_restart(spark, sf_dir):
    root = workspace(spark)
    times = publish(spark, sf_dir, f"{root}/log")
    store = MemoryStore()
    try:
        Pipeline(_config(), watch(spark, f"{root}/log", max_files=times), FailsOnce(f"{root}/out", "parquet", layout="collection"), store, f"{root}/checkpoint").run_once()
    except Exception as e:
        if "connection lost" not in str(e):
            raise
    sink = FileDestination(f"{root}/out", "parquet", layout="collection")
    Pipeline(_config(), watch(spark, f"{root}/log", max_files=times), sink, store, f"{root}/checkpoint").run_once()
    return _read(spark, f"{root}/out")


def _objects(fmt, compression, strategy, sql):
    """A stream that writes whole objects of at most 1,000 events by a key strategy, read back."""

    def f(spark, sf_dir):
        root = workspace(spark)
        publish(spark, sf_dir, f"{root}/log")
        sink = ObjectDestination(f"{root}/out", fmt, compression, strategy, "data")
        Pipeline(_config(batch_size=1000), watch(spark, f"{root}/log"), sink, MemoryStore(), f"{root}/checkpoint").run_once()
        return _flat(read_objects(spark, f"{root}/out", fmt, compression))

    f.__name__ = f"q_stream_key_{strategy}"
    return query(CHG + sql)(f)


_objects("avro", "gzip", "hive", COMPACT_SQL)
_objects("json", "zstd", "date_hour", COMPACT_SQL)
_objects("csv", "gzip", "date", COMPACT_SQL)
_objects("parquet", "zstd", "collection", COMPACT_SQL)
_objects("json", "gzip", "flat", COMPACT_SQL)


@query(CHG + "SELECT event_id, collection FROM chg WHERE event_id > (SELECT CAST(count(*) // 3 AS BIGINT) FROM chg)")
def q_stream_resume(spark, sf_dir):
    """The replay source from a token in the middle of a file on."""
    root, log = workspace(spark), changelog(spark, sf_dir)
    times = publish(spark, sf_dir, f"{root}/log", log=log)
    third = log.count() // 3
    token = log.where(F.col("event_id") == third).first()["resume_token"]
    sink = FileDestination(f"{root}/out", "parquet", layout="collection")
    Pipeline(_config(), _replay(spark, f"{root}/log", max_files=times, resume_after=token), sink, MemoryStore(), f"{root}/checkpoint").run_once()
    return read(spark, f"{root}/out").select(token_sequence(F.col("resume_token")).alias("event_id"), "collection")


@query(CHG + "SELECT c.event_id, c.collection FROM chg c LEFT JOIN (SELECT collection, min(event_id) AS stop FROM chg WHERE operation = 'invalidate' GROUP BY collection) s ON c.collection = s.collection WHERE c.collection IN ('users', 'orders') AND (s.stop IS NULL OR c.event_id < s.stop)")
def q_stream_invalidate(spark, sf_dir):
    """Watched collections end at their first invalidate, over several micro-batches."""
    root = workspace(spark)
    times = publish(spark, sf_dir, f"{root}/log")
    sink = FileDestination(f"{root}/out", "parquet", layout="collection")
    config = _config(watch_level=WatchLevel("collection", ("users", "orders")))
    Pipeline(config, _replay(spark, f"{root}/log", max_files=times), sink, MemoryStore(), f"{root}/checkpoint").run_once()
    return read(spark, f"{root}/out").select(token_sequence(F.col("resume_token")).alias("event_id"), "collection")


_NUMBER = "CAST(json_extract_string(full_document, '$.k') AS BIGINT)"


@query(CHG + f""", bare AS (SELECT event_id, operation, collection, document_key, CASE WHEN operation <> 'update' THEN {_NUMBER} END AS own FROM chg),
marked AS (SELECT *, max(CASE WHEN operation = 'delete' THEN event_id END) OVER w AS gone FROM bare WINDOW w AS (PARTITION BY collection, document_key ORDER BY event_id)),
seen AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY collection, document_key, gone ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM marked)
SELECT event_id, CASE WHEN operation = 'update' THEN state ELSE own END AS k, lag(CASE WHEN operation <> 'delete' THEN state END) OVER (PARTITION BY collection, document_key ORDER BY event_id) AS k_before FROM seen WHERE document_key IS NOT NULL""")
def q_stream_images(spark, sf_dir):
    """Updates without documents get the last version, and all events the one before, from the stream's state."""
    root = workspace(spark)
    bare = changelog(spark, sf_dir).withColumn("full_document", F.when(F.col("operation") != "update", F.col("full_document"))).withColumn("update_description", F.lit(None).cast(schema.UPDATE))
    times = publish(spark, sf_dir, f"{root}/log", log=bare)
    config = _config(stream=StreamConfig(images="state", full_document_before_change=True))
    events = Pipeline(config, _replay(spark, f"{root}/log", max_files=times), FileDestination(f"{root}/unused"), MemoryStore(), f"{root}/checkpoint").events()
    events.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    k = lambda c: F.get_json_object(c, "$.k").cast("long")
    out = spark.read.schema("seq long, document_key string, full_document string, full_document_before_change string").parquet(f"{root}/out")
    return out.where("document_key IS NOT NULL").select(F.col("seq").alias("event_id"), k("full_document").alias("k"), k("full_document_before_change").alias("k_before"))


@query(CHG + COMPACT_SQL)
def q_stream_workers(spark, sf_dir):
    """A query, checkpoint, token and lease for each collection."""
    root = workspace(spark)
    publish(spark, sf_dir, f"{root}/log")
    config = _config(watch_level=WatchLevel("collection", ("users", "orders", "products")), stream=StreamConfig(stop_on_invalidate=False), lock=LockConfig())
    Workers(config, watch(spark, f"{root}/log"), lambda c: FileDestination(f"{root}/out/{c}", "parquet", layout="flat"), MemoryStore(), f"{root}/checkpoint").run_once()
    return _flat(reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(f"{root}/out/{c}") for c in ("users", "orders", "products")]))


class FlakyStream(ReplayStream):
    """Loses the connection the first time that it reads a file."""

    def read(self, partition):
        import os

        seen = f"{partition.path}.seen"
        if not os.path.exists(seen):
            open(seen, "w").close()
            raise SourceError("connection reset by peer", code=6)
        return super().read(partition)


class FlakySource(ReplaySource):
    @classmethod
    def name(cls):
        return "changelake_flaky"

    def streamReader(self, schema):
        return FlakyStream(self.options)


@query(CHG + COMPACT_SQL)
def q_stream_reconnect(spark, sf_dir):
    """A source that fails once for every file; the stream opens again from its checkpoint."""
    root = workspace(spark)
    times = publish(spark, sf_dir, f"{root}/log")
    sink = FileDestination(f"{root}/out", "parquet", layout="collection")
    config = _config(stream=StreamConfig(initial_backoff=0.01, max_reconnect_attempts=20))
    Pipeline(config, _replay(spark, f"{root}/log", FlakySource, max_files=times), sink, MemoryStore(), f"{root}/checkpoint").run_once()
    return _read(spark, f"{root}/out")


@query(CHG + COMPACT_SQL)
def q_stream_drain(spark, sf_dir):
    """A running stream that is stopped writes what came in since its last micro-batch."""
    root, log = workspace(spark), changelog(spark, sf_dir)
    publish(spark, sf_dir, f"{root}/log/a", log=log.where("event_id % 2 = 0"))
    sink = FileDestination(f"{root}/out", "parquet", layout="collection")
    pipeline = Pipeline(_config(batch_timeout=3600), watch(spark, f"{root}/log/*"), sink, MemoryStore(), f"{root}/checkpoint").start()
    for _ in range(600):  # the first micro-batch starts at once, the next an hour later
        if pipeline.stats.batches_written or not pipeline.is_running():
            break
        time.sleep(0.1)
    publish(spark, sf_dir, f"{root}/log/b", log=log.where("event_id % 2 = 1"))
    pipeline.stop()
    return _read(spark, f"{root}/out")


# --- extensions: not operators of the change-data-capture engine, but what Spark adds -----------


@query(CHG + "SELECT collection, document_key, arg_max(operation, event_id) AS operation, max(event_id) AS event_id FROM chg WHERE document_key IS NOT NULL GROUP BY collection, document_key")
def q_x_latest_state(spark, sf_dir):
    from changelake.operators.state import latest_by_key

    keyed = changelog(spark, sf_dir).where("document_key IS NOT NULL").select("event_id", "collection", "document_key", "operation")
    return latest_by_key(keyed, ["collection", "document_key"])


@query(CHG + "SELECT collection, date_trunc('hour', cluster_time) AS window_start, count(*) AS n FROM chg GROUP BY 1, 2")
def q_x_tumbling(spark, sf_dir):
    windows = changelog(spark, sf_dir).groupBy("collection", F.window("cluster_time", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return windows.select("collection", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def q_x_session(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query(CHG + "SELECT resume_token, collection FROM chg")
def q_x_dedup_watermark(spark, sf_dir):
    """The log published twice, deduplicated by token within a watermark, as a stream."""
    root = workspace(spark)
    times = publish(spark, sf_dir, f"{root}/log/a", 2)
    publish(spark, sf_dir, f"{root}/log/b", 2)
    raw = watch(spark, f"{root}/log/*", max_files=8 * times).select("_id", "ns", "clusterTime")
    once = raw.withWatermark("clusterTime", "400 days").dropDuplicatesWithinWatermark(["_id"])
    out = once.select(F.col("_id").alias("resume_token"), F.col("ns.collection").alias("collection"))
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
