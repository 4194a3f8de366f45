import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changelake import schema
from changelake.functions import keys
from changelake.sinks import avro, base, files
from changelake.sinks.base import BucketConfig, CapacityError, ConfigurationError, ConnectionFailed, Destination, Metadata, SerializationError, UnknownError, WriteError, classify
from changelake.sources.replay import ReplaySource, describe_level, parse, watch
from changelake.streaming.config import ConfigError, LockConfig, PipelineConfig, StreamConfig, WatchLevel
from changelake.streaming.metrics import Metrics
from changelake.streaming.pipeline import LockHeld, Pipeline, Stats, write_with_retry
from changelake.streaming.stores import FileStore, KeyValueStore, LeaseKeeper, MemoryStore


def test_config_defaults_and_limits():
    c = PipelineConfig("db")
    assert (c.batch_size, c.batch_timeout, c.max_retries, c.retry_delay, c.max_retry_delay, c.watch_level.kind) == (100, 5.0, 0, 0.1, 30.0, "database")
    for bad in (lambda: PipelineConfig(""), lambda: PipelineConfig("db", batch_size=10_001), lambda: PipelineConfig("db", retry_delay=9, max_retry_delay=1), lambda: PipelineConfig("db", watch_level=WatchLevel("collection")), lambda: WatchLevel("planet"), lambda: LockConfig(ttl=5, refresh_interval=5), lambda: LockConfig(ttl=0.5, refresh_interval=0.1), lambda: StreamConfig(initial_backoff=0), lambda: StreamConfig(initial_backoff=9, max_backoff=1), lambda: StreamConfig(jitter=2)):
        with pytest.raises(ConfigError):
            bad()


def test_bucket_config():
    assert BucketConfig("my-bucket.1", "us-east-1", "data/x").path == "s3a://my-bucket.1/data/x"
    for bad in (("ab", "r"), ("a" * 64, "r"), ("My_Bucket", "r"), ("bucket", ""), ("bucket", "r", "../up"), ("bucket", "r", "/top")):
        with pytest.raises(ConfigurationError):
            BucketConfig(*bad)


def test_watch_level_keys():
    assert WatchLevel("collection", ("users",)).resume_token_key("mydb", "users") == "resume_token:mydb:users"
    assert WatchLevel("collection", ("users",)).resume_token_key("mydb") == "resume_token:mydb"
    assert WatchLevel().resume_token_key("mydb") == "resume_token:database:mydb"
    assert WatchLevel("deployment").resume_token_key("mydb") == "resume_token:deployment"
    assert WatchLevel().lock_key("mydb").endswith(":mydb:__database__")
    assert describe_level("collection", []) == "no collections" and describe_level("collection", ["a"]) == "1 collection (a)" and describe_level("collection", ["a", "b"]) == "2 collections"


def test_error_flags():
    assert [ConnectionFailed("x").retryable, CapacityError("x").retryable, WriteError("x", True).retryable] == [True] * 3
    assert [SerializationError("x").retryable, ConfigurationError("x").retryable, WriteError("x", False).retryable, UnknownError("x").retryable] == [False] * 4
    assert CapacityError("x", 2.5).retry_after == 2.5
    assert isinstance(classify(OSError("Read timed out")), ConnectionFailed) and isinstance(classify(OSError("503 SlowDown")), CapacityError)
    assert not classify(OSError("Access Denied")).retryable


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


class FakeClient:
    """As much of a Redis client as the store needs."""

    def __init__(self):
        self.kept = {}

    def set(self, k, v, nx=False, ex=None):
        if nx and k in self.kept:
            return None
        self.kept[k] = v
        return True

    def get(self, k):
        v = self.kept.get(k)
        return v.encode() if v is not None else None

    def delete(self, k):
        self.kept.pop(k, None)

    def scan_iter(self, match):
        return [k.encode() for k in self.kept if k.startswith(match.rstrip("*"))]

    def eval(self, script, n, key, owner, *args):
        if self.kept.get(key) != owner:
            return 0
        if "del" in script:
            del self.kept[key]
        return 1


@pytest.fixture(params=["memory", "file", "client"])
def store(request, tmp_path):
    return {"memory": MemoryStore, "file": lambda: FileStore(str(tmp_path)), "client": lambda: KeyValueStore(FakeClient())}[request.param]()


def test_tokens(store):
    token = json.dumps({"_data": "x" * 1024, "nested": {"a": [1, 2]}})
    store.save("resume_token:db:users", token)
    store.save("resume_token:deployment", "t2")
    assert store.get("resume_token:db:users") == token and store.get("none") is None
    assert store.keys() == ["resume_token:db:users", "resume_token:deployment"]
    store.delete("resume_token:db:users")
    assert store.get("resume_token:db:users") is None


def test_leases(store):
    assert store.acquire("k", "a", 30) and not store.acquire("k", "b", 30) and store.is_locked("k") and store.holder("k") == "a"
    assert store.refresh("k", "a", 30) and not store.refresh("k", "b", 30)
    assert not store.release("k", "b") and store.release("k", "a") and not store.is_locked("k")
    assert store.acquire("k", "b", 30)


@pytest.mark.parametrize("kind", ["memory", "file"])
def test_lease_runs_out(kind, tmp_path):
    clock = Clock()
    s = MemoryStore(clock) if kind == "memory" else FileStore(str(tmp_path), clock)
    assert s.acquire("k", "a", 2)
    clock.now = 2.5
    assert not s.refresh("k", "a", 2) and s.acquire("k", "b", 2) and s.holder("k") == "b"


def test_lost_lease_is_told():
    s, told = MemoryStore(), []
    s.acquire("k", "a", 5)
    keeper = LeaseKeeper(s, "k", "a", 5, 0.01, lambda: told.append(1)).start()
    s.leases["k"] = "b", s.clock() + 5
    keeper.thread.join(5)
    assert told == [1]


def test_retries_count_and_wait():
    def failing(times, error):
        left = [times]

        def f():
            if left[0]:
                left[0] -= 1
                raise error

        return f

    waited, stats = [], Stats()
    write_with_retry(failing(3, ConnectionFailed("x")), 3, 0.1, 0.2, stats, waited.append)
    assert waited == [0.1, 0.2, 0.2] and (stats.write_errors, stats.retries) == (3, 3)
    stats = Stats()
    with pytest.raises(SerializationError):
        write_with_retry(failing(1, SerializationError("x")), 5, 0.1, 1, stats, waited.append)
    assert (stats.write_errors, stats.retries) == (1, 0)
    stats = Stats()
    with pytest.raises(ConnectionFailed):
        write_with_retry(failing(9, ConnectionFailed("x")), 2, 0, 0, stats, lambda s: None)
    assert (stats.write_errors, stats.retries) == (3, 2)
    waited.clear()
    write_with_retry(failing(1, CapacityError("x", 7)), 1, 0.1, 1, None, waited.append)
    assert waited == [7]


def test_avro_round_trip():
    rows = [("Insert", "d", "c", "2025-01-15T10:30:45+00:00", '{"_id":1}', None, "t"), ("Unknown(\"x\")", "", "é" * 100, "t", None, '{"a":"ü"}', "")] * 5000
    for codec in ("null", "deflate"):
        assert list(avro.decode(avro.encode(rows, codec))) == rows
    assert list(avro.decode(avro.encode([]))) == []
    with pytest.raises(ValueError):
        list(avro.decode(b"PAR1"))


EVENTS = [("insert", "db", "users", '{"_id":1}', '{"name":"A \\"q\\", b\\n"}', None, datetime(2025, 1, 2, 3, 4, 5, 678901), '{"_data":"1"}'), ("futureOperation", "db", "orders", None, None, None, datetime(2025, 1, 2, 23), '{"_data":"2"}'), ("update", "db", "users", '{"_id":1}', None, ('{"x":1}', ["y"], None), datetime(2025, 2, 1), '{"_data":"3"}')]


@pytest.fixture
def some(spark):
    return spark.createDataFrame(EVENTS, schema.EVENT)


def flat(df):
    return sorted(tuple(r) for r in df.select(*schema.FLAT7).collect())


@pytest.mark.parametrize(("fmt", "compression"), [("json", "none"), ("json", "gzip"), ("csv", "gzip"), ("csv", "none"), ("parquet", "zstd"), ("parquet", "none")])
@pytest.mark.parametrize("layout", ["hive", "flat"])
def test_formats_come_back(spark, some, tmp_path, fmt, compression, layout):
    files.write(some, str(tmp_path / "o"), fmt, compression, layout, F.col("cluster_time"))
    assert flat(files.read(spark, str(tmp_path / "o"), fmt)) == flat(some)
    if layout == "hive":
        assert (tmp_path / "o/collection=users/year=2025/month=01/day=02/hour=03").is_dir()


def test_unsupported_codec(some, tmp_path):
    with pytest.raises(ConfigurationError):
        files.write(some, str(tmp_path), "json", "zstd")
    with pytest.raises(ConfigurationError):
        files.FileDestination(str(tmp_path), "xml")


@pytest.mark.parametrize("compression", ["none", "gzip", "zstd"])
def test_objects(spark, some, tmp_path, compression):
    import gzip

    import zstandard

    open_ = {"none": bytes, "gzip": gzip.decompress, "zstd": lambda b: zstandard.ZstdDecompressor().decompress(b)}[compression]
    name = keys.object_key("flat", "p", "collection", F.lit(datetime(2025, 1, 1)), "jsonl", keys.COMPRESSED[compression])
    made = files.objects(some, ["collection"], name, "json", compression).collect()
    assert sorted(r["n"] for r in made) == [1, 2] and all(r["object_key"].startswith("p/") for r in made)
    assert sum(open_(bytes(r["content"])).count(b"\n") for r in made) == 3
    made = files.objects(some, ["collection"], keys.object_key("hive", "p", "collection", F.lit(datetime(2025, 1, 1)), "avro"), "avro")
    assert files.put(made, str(tmp_path)) == 2
    assert flat(files.read(spark, str(tmp_path), "avro")) == flat(some)


def test_writing_an_epoch_again_changes_nothing(spark, some, tmp_path):
    sink = files.FileDestination(str(tmp_path / "o"), "parquet", layout="collection")
    for epoch in (0, 1, 1, 0):
        sink.write_batch(some, epoch)
    assert files.read(spark, str(tmp_path / "o")).count() == 6
    sink.close()
    sink.close()
    sink.flush()
    with pytest.raises(WriteError):
        sink.write_batch(some, 2)


def lines(path, n, files_=2):
    path.mkdir()
    for f in range(files_):
        (path / f"{f}.jsonl").write_text("".join(json.dumps({"operationType": "insert", "ns": {"db": "db" if i % 3 else "other", "coll": "users" if i % 2 else "orders"}, "documentKey": {"_id": i}, "fullDocument": {"_id": i}, "clusterTime": "2025-01-01T00:00:00+00:00", "_id": {"_data": i}, "seq": i}) + "\n" for i in range(f * n, (f + 1) * n)) + "broken\n")


def test_replay_source(spark, tmp_path):
    spark.dataSource.register(ReplaySource)
    lines(tmp_path / "log", 10)
    read = lambda **o: spark.read.format("changelake_replay").option("path", str(tmp_path / "log")).options(**o).load()
    assert read(level="deployment").count() == 20
    assert read(level="database", database="db").count() == 13
    assert {r["ns"]["collection"] for r in read(level="collection", database="db", collections="users").collect()} == {"users"}
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.format("changelake_replay").option("path", str(tmp_path / "log")).option("level", "deployment").option("max_files", 1).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination()
    assert spark.read.parquet(out).select("seq").distinct().count() == spark.read.parquet(out).count() > 0
    assert parse("{") is None and parse('{"ns":null}')[0] is None


class Collecting(Destination):
    def __init__(self, fail=0):
        super().__init__()
        self.rows, self.fail = [], fail

    def _write(self, batch, epoch):
        if self.fail:
            self.fail -= 1
            raise ConnectionFailed("down")
        self.rows += [r["resume_token"] for r in batch.collect()]

    def metadata(self):
        return Metadata("collecting", "memory")


def publish(tmp_path, n=10):
    (tmp_path / "log").mkdir()
    for f in range(2):
        (tmp_path / "log" / f"{f}.jsonl").write_text("".join(json.dumps({"operationType": "insert" if i % 2 else "Delete", "ns": {"database": "db", "collection": "users"}, "clusterTime": "2025-01-01T00:00:00Z", "_id": f"t{i}", "seq": i}) + "\n" for i in range(f * n, (f + 1) * n)))
    return str(tmp_path / "log")


def test_pipeline_filters_retries_and_keeps_the_token(spark, tmp_path):
    path, store = publish(tmp_path), MemoryStore()
    config = PipelineConfig("db", max_retries=2, retry_delay=0.001, stream=StreamConfig(pipeline=({"$match": {"operationType": "insert"}},)))
    sink = Collecting(fail=1)
    stats = Pipeline(config, watch(spark, path, 1), sink, store, str(tmp_path / "check")).run_once()
    assert sorted(sink.rows) == sorted(f"t{i}" for i in range(20) if i % 2)
    assert (stats.events_processed, stats.batches_written, stats.write_errors, stats.retries, stats.counts) == (10, 2, 1, 1, {("users", "insert"): 10})
    assert store.get("resume_token:database:db") == "t19" and not store.is_locked("changelake:lock:db:__database__") and sink.closed


def test_failed_epoch_keeps_no_token(spark, tmp_path):
    path, store = publish(tmp_path), MemoryStore()
    with pytest.raises(Exception, match="down"):
        Pipeline(PipelineConfig("db"), watch(spark, path, 1), Collecting(fail=1), store, str(tmp_path / "check")).run_once()
    assert store.keys() == []
    sink = Collecting()
    Pipeline(PipelineConfig("db"), watch(spark, path, 1), sink, store, str(tmp_path / "check")).run_once()
    assert sorted(sink.rows) == sorted(f"t{i}" for i in range(20))


def test_held_lock(spark, tmp_path):
    store = MemoryStore()
    store.acquire("changelake:lock:db:__database__", "other", 60)
    with pytest.raises(LockHeld):
        Pipeline(PipelineConfig("db", lock=LockConfig(ttl=1, refresh_interval=0.5, retry_interval=0.1)), watch(spark, publish(tmp_path)), Collecting(), store, str(tmp_path / "check")).start()


def test_metrics_text():
    m = Metrics()
    m.count("events_processed_total", 2, collection="users", operation="insert")
    m.gauge("pipeline_status", 1)
    m.observe("batch_size", 10, collection="users")
    assert 'changelake_events_processed_total{collection="users",operation="insert"} 2' in m.text() and "changelake_pipeline_status{} 1" in m.text() and 'changelake_batch_size_sum{collection="users"} 10' in m.text()
    assert len({*schema.COUNTERS, *schema.GAUGES, *schema.HISTOGRAMS}) == 19 and base.log.name == "changelake"


def write_log(folder, rows, size=4):
    """Rows (operation, key, document) of collection users as replayable files."""
    folder.mkdir(parents=True, exist_ok=True)
    for f in range(0, len(rows), size):
        lines = [json.dumps({"operationType": op, "ns": {"database": "db", "collection": c}, "documentKey": None if k is None else {"_id": k}, "fullDocument": d, "clusterTime": "2025-01-01T00:00:00Z", "_id": f"t{i}", "seq": i}) for i, (op, c, k, d) in enumerate(rows[f : f + size], f)]
        (folder / f"{f:05}.jsonl").write_text("".join(x + "\n" for x in lines))
    return str(folder)


def replayed(spark, path, **options):
    spark.dataSource.register(ReplaySource)
    return spark.readStream.format("changelake_replay").options(path=path, level="deployment", max_files=1, **options).load()


def test_resume_inside_a_file_and_unknown_tokens(spark, tmp_path):
    path = write_log(tmp_path / "log", [("insert", "users", i, {"a": i}) for i in range(10)], 5)
    for token, expected in (("t1", range(2, 10)), ("t4", range(5, 10)), ("t9", ())):
        sink = Collecting()
        Pipeline(PipelineConfig("db"), replayed(spark, path, resume_after=token), sink, MemoryStore(), str(tmp_path / f"check-{token}")).run_once()
        assert sorted(sink.rows) == sorted(f"t{i}" for i in expected)
    with pytest.raises(Exception, match="no event has the token"):
        Pipeline(PipelineConfig("db"), replayed(spark, path, resume_after="nowhere"), Collecting(), MemoryStore(), str(tmp_path / "check-x")).run_once()


def test_replay_goes_on_behind_its_checkpoint(spark, tmp_path):
    path, sink = write_log(tmp_path / "log", [("insert", "users", i, None) for i in range(6)], 2), Collecting()
    for n in (6, 8):
        write_log(tmp_path / "log", [("insert", "users", i, None) for i in range(n)], 2)
        Pipeline(PipelineConfig("db"), replayed(spark, path), sink, MemoryStore(), str(tmp_path / "check")).run_once()
        sink.closed = False
    assert sorted(sink.rows) == sorted(f"t{i}" for i in range(8))


def test_broken_lines_are_counted_or_refused(spark, tmp_path):
    path = write_log(tmp_path / "log", [("insert", "users", 1, None)])
    (tmp_path / "log" / "x.jsonl").write_text("{broken\n")
    metrics, sink = Metrics(), Collecting()
    Pipeline(PipelineConfig("db"), watch(spark, path), sink, MemoryStore(), str(tmp_path / "a"), metrics=metrics).run_once()
    assert sink.rows == ["t0"] and metrics.value("events_failed_total", collection="db", error_type="serialization_error") == 1
    with pytest.raises(Exception, match="no event"):
        Pipeline(PipelineConfig("db"), replayed(spark, path, broken="fail"), Collecting(), MemoryStore(), str(tmp_path / "b")).run_once()


def test_all_metrics_are_emitted(spark, tmp_path):
    path, metrics = publish(tmp_path), Metrics()
    config = PipelineConfig("db", batch_size=3, max_retries=1, retry_delay=0.001, lock=LockConfig(ttl=1, refresh_interval=0.02, retry_interval=0.1))
    pipeline = Pipeline(config, watch(spark, path), Collecting(fail=1), MemoryStore(), str(tmp_path / "check"), metrics=metrics)
    pipeline.run_once()
    v = metrics.value
    assert (v("events_processed_total", collection="users", operation="insert"), v("events_processed_total", collection="users", operation="delete")) == (10, 10)
    assert v("batches_written_total", destination_type="memory") == 7 and v("batch_size", collection="users") == 7 and pipeline.stats.batches_written == 7
    assert v("retries_total", error_type="connection_error") == 1 and v("destination_write_errors_total", destination_type="memory", error_type="connection_error") == 1
    assert v("destination_write_duration_seconds", destination_type="memory") == v("destination_write_bytes", destination_type="memory") == v("change_stream_lag_seconds", collection="users") == v("batch_duration_seconds", collection="users") == 1
    assert v("active_collections") == 1 and v("batch_queue_size", collection="users") == 0 and v("pipeline_status") == 0
    assert v("lock_acquisitions_total") == v("locks_released_total") == 1 and v("locks_held") == 0 and v("lock_refreshes_total") > 0
    failing, store = Metrics(), MemoryStore()
    with pytest.raises(Exception, match="down"):
        Pipeline(PipelineConfig("db"), watch(spark, path), Collecting(fail=1), store, str(tmp_path / "other"), metrics=failing).run_once()
    assert failing.value("events_failed_total", collection="users", error_type="connection_error") == 20
    store.acquire("changelake:lock:db:__database__", "other", 60)
    with pytest.raises(LockHeld):
        Pipeline(PipelineConfig("db", lock=LockConfig(ttl=1, refresh_interval=0.5, retry_interval=0.1)), watch(spark, path), Collecting(), store, str(tmp_path / "third"), metrics=failing).run_once()
    assert failing.value("lock_acquisition_failures_total", reason="already_held") > 0


def test_histograms_count_exactly():
    m = Metrics(bounds=(1, 10))
    for i in range(30_000):
        m.observe("batch_size", i % 3 * 5, collection="c")
    text = m.text()
    assert 'batch_size_count{collection="c"} 30000' in text and 'batch_size_sum{collection="c"} 150000' in text
    assert 'batch_size_bucket{collection="c",le="1"} 10000' in text and 'le="10"} 30000' in text and 'le="+Inf"} 30000' in text


def test_reconnects_until_the_limit():
    from changelake.functions.errors import stream_error
    from changelake.sources.replay import SourceError
    from changelake.streaming.reconnect import Reconnector, ReconnectsExceeded, keep_open

    lost = SourceError("gone", code=6)
    assert stream_error(str(lost)).retryable and not stream_error(str(SourceError("x", code=286))).retryable and stream_error(str(SourceError("x", code=286))).category == "invalid_token"
    assert stream_error(str(SourceError("x", code=None, labels=("NetworkError",)))).retryable and not stream_error(str(SourceError("x", "conversion", 6))).retryable and stream_error("other") is None
    r = Reconnector(StreamConfig(max_reconnect_attempts=3, jitter=0))
    assert [r.failed(lost) for _ in range(3)] == [0.1, 0.2, 0.4] and r.state == "reconnecting"
    with pytest.raises(ReconnectsExceeded):
        r.failed(lost)
    assert r.state == "closed"
    r = Reconnector(StreamConfig(max_reconnect_attempts=1, jitter=0))
    for _ in range(5):
        r.failed(lost)
        r.active()
    with pytest.raises(ValueError):
        r.failed(ValueError("fatal"))
    opened, left = [], [2]

    def wait():
        if left[0]:
            left[0] -= 1
            raise lost

    keep_open(lambda: opened.append(1), wait, Reconnector(StreamConfig(initial_backoff=0.001)), lambda s: False)
    assert len(opened) == 3
    left[0] = 9
    keep_open(lambda: opened.append(1), wait, Reconnector(StreamConfig()), lambda s: True)  # told to stop while waiting
    assert len(opened) == 4


def test_invalidate_ends_a_collection_for_good(spark, tmp_path):
    rows = [("insert", "users", 1, None), ("insert", "orders", 1, None), ("invalidate", "users", None, None), ("insert", "users", 2, None), ("insert", "orders", 2, None), ("insert", "users", 3, None)]
    path, store, sink = write_log(tmp_path / "log", rows, 3), MemoryStore(), Collecting()
    config = PipelineConfig("db", watch_level=WatchLevel("collection", ("users", "orders")), lock=LockConfig(enabled=False))
    Pipeline(config, replayed(spark, path), sink, store, str(tmp_path / "check")).run_once()
    assert sorted(sink.rows) == ["t0", "t1", "t4"]
    write_log(tmp_path / "log", rows + [("insert", "users", 9, None), ("insert", "orders", 9, None), ("drop", "orders", None, None)], 3)
    sink.closed = False
    Pipeline(config, replayed(spark, path), sink, store, str(tmp_path / "check")).run_once()
    assert sorted(sink.rows) == ["t0", "t1", "t4", "t7", "t8"]
    everything = Collecting()
    Pipeline(PipelineConfig("db", lock=LockConfig(enabled=False)), replayed(spark, path), everything, MemoryStore(), str(tmp_path / "all")).run_once()
    assert len(everything.rows) == 9


def test_images_over_micro_batches(spark, tmp_path):
    rows = [("insert", "users", 1, {"v": 1}), ("update", "users", 1, None), ("update", "users", 2, None), ("replace", "users", 1, {"v": 2}), ("update", "users", 1, None), ("delete", "users", 1, None), ("update", "users", 1, None), ("drop", "users", None, None)]
    path = write_log(tmp_path / "log", rows, 2)
    config = PipelineConfig("db", stream=StreamConfig(images="state", full_document_before_change=True))
    events = Pipeline(config, replayed(spark, path), Collecting(), MemoryStore(), str(tmp_path / "unused")).events()
    events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {r["seq"]: (r["full_document"], r["full_document_before_change"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    one, two = '{"v":1}', '{"v":2}'
    assert got == {0: (one, None), 1: (one, one), 2: (None, None), 3: (two, one), 4: (two, two), 5: (None, two), 6: (None, None), 7: (None, None)}


def test_batch_size_bounds_objects_and_hot_collections_are_spread(spark, tmp_path):
    from changelake.sinks.buckets import ObjectDestination

    path = write_log(tmp_path / "log", [("insert", "users" if i % 10 else "orders", i, {"i": i}) for i in range(500)], 500)
    sink = ObjectDestination(str(tmp_path / "out"), "json", "none", "hive", "data")
    Pipeline(PipelineConfig("db", batch_size=5), watch(spark, path), sink, MemoryStore(), str(tmp_path / "check")).run_once()
    objects = list((tmp_path / "out").rglob("*.jsonl"))
    sizes = [len(o.read_text().splitlines()) for o in objects]
    assert max(sizes) <= 5 and sum(sizes) == 500 and sink.objects_written == len(objects)
    assert all(o.relative_to(tmp_path / "out").as_posix().startswith(("data/collection=users/year=2025/month=01/day=01/hour=00/1735689600000-0-", "data/collection=orders/year=2025/month=01/day=01/hour=00/1735689600000-0-")) for o in objects)
    before = sorted(o.name for o in objects)
    sink.closed = False
    Pipeline(PipelineConfig("db", batch_size=5), watch(spark, path), sink, MemoryStore(), str(tmp_path / "again")).run_once()  # the same epoch again
    assert sorted(o.name for o in (tmp_path / "out").rglob("*.jsonl")) == before


@pytest.mark.parametrize(("strategy", "pattern"), [("hive", "p/collection=users/year=2025/month=01/day=15/hour=10/1736937045000.jsonl"), ("date_hour", "p/users/2025/01/15/10/1736937045000.jsonl"), ("date", "p/users/2025/01/15/1736937045000.jsonl"), ("collection", "p/users/1736937045000.jsonl"), ("flat", "p/users_1736937045000.jsonl")])
def test_object_names(strategy, pattern):
    time = datetime(2025, 1, 15, 10, 30, 45)
    assert keys.object_name(strategy, "p", "users", time, "jsonl") == pattern
    assert keys.object_name(strategy, "", "users", time, "jsonl", ".gz", "-1-0-0") == pattern.removeprefix("p/").replace(".jsonl", "-1-0-0.jsonl.gz")


def test_bucket_settings_reach_the_client():
    from changelake.sinks.buckets import ObjectDestination

    c = BucketConfig("bucket", "eu-west-1", "data", "avro", "none", "hive", 7, "http://localhost:4566", True)
    assert c.client() == {"region": "eu-west-1", "force_virtual_addressing": False, "max_attempts": 8, "endpoint_override": "localhost:4566", "scheme": "http"}
    sink = ObjectDestination.of(c)
    assert (sink.root, sink.fmt, sink.strategy, sink.prefix, sink.metadata().kind) == ("s3://bucket", "avro", "hive", "data", "s3")
    assert files.filesystem(sink.root, sink.options)[1] == "bucket" and c.hadoop()["fs.s3a.path.style.access"] == "true"
    with pytest.raises(ConfigurationError):
        ObjectDestination("x", "avro", "zstd")


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet", "avro"])
def test_documents_over_lines_come_back(spark, tmp_path, fmt):
    text = '{\n "a": "x, \\"y\\"",\r\n "b": [1,\n2] }'
    row = ("insert", "db", "users", '{\n"_id":1}', text, None, datetime(2025, 1, 2), '{"_data":\n"1"}')
    made = spark.createDataFrame([row, row], schema.EVENT)
    if fmt == "avro":
        files.put(files.objects(made, ["collection"], F.lit("x.avro")), str(tmp_path / "o"))
    else:
        files.write(made, str(tmp_path / "o"), fmt, layout="flat")
    back = files.read(spark, str(tmp_path / "o"), fmt).select(*schema.FLAT7).collect()
    assert len(back) == 2 and all(json.loads(r["full_document"]) == json.loads(text) and r["operation"] == "insert" for r in back)
    if fmt != "json":
        assert {r["full_document"] for r in back} == {text}


def test_a_constant_layout_is_not_one_task(spark, tmp_path):
    events = spark.range(4000, numPartitions=8).select(F.lit("insert").alias("operation"), F.lit("db").alias("database"), F.lit("users").alias("collection"), F.col("id").cast("string").alias("document_key"), F.lit("{}").alias("full_document"), F.lit(None).cast(schema.UPDATE).alias("update_description"), F.lit(datetime(2025, 1, 1)).alias("cluster_time"), F.col("id").cast("string").alias("resume_token"))
    files.write(events, str(tmp_path / "flat"), "parquet", layout="flat", epoch=3)
    assert len(list((tmp_path / "flat").rglob("*.parquet"))) == 8
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files.write(events, str(tmp_path / "one"), "parquet", layout="collection", epoch=3)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "one").rglob("*.parquet"))) > 1


@pytest.mark.parametrize(("fmt", "compression"), [("csv", "none"), ("csv", "gzip"), ("json", "gzip")])
def test_files_that_cannot_be_split_are_bounded(spark, tmp_path, fmt, compression):
    n = 210_000
    text = F.concat(F.lit('{\n"k": '), F.col("id"), F.lit("\n}"))
    events = spark.range(n, numPartitions=2).select(F.lit("insert").alias("operation"), F.lit("db").alias("database"), F.lit("users").alias("collection"), F.col("id").cast("string").alias("document_key"), text.alias("full_document"), F.lit(None).cast(schema.UPDATE).alias("update_description"), F.lit(datetime(2025, 1, 1)).alias("cluster_time"), F.col("id").cast("string").alias("resume_token"))
    path = str(tmp_path / "o")
    files.write(events, path, fmt, compression, layout="collection")
    back = files.read(spark, path, fmt)
    sizes = [r["count"] for r in back.groupBy(F.input_file_name().alias("file")).count().collect()]
    assert max(sizes) <= 100_000 and sum(sizes) == n
    assert back.select("resume_token", F.get_json_object("full_document", "$.k").alias("k")).where("k = resume_token").distinct().count() == n


def test_avro_rows_by_expressions(spark):
    long = "é" * 5000
    rows = [("insert", "", "c", "t", None, long, "x"), ("a" * 63, "b" * 64, "c" * 8191, "d" * 8192, "k", None, "")]
    made = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in avro.COLUMNS)).select(avro.row().alias("row")).collect()
    assert list(avro.decode(avro.assemble([bytes(r["row"]) for r in made], "deflate"))) == rows


def test_drained_stop_and_workers_wait_for_a_lease(spark, tmp_path):
    import time

    from changelake.streaming.pipeline import Workers

    path, store = write_log(tmp_path / "log", [("insert", c, i, None) for i in range(4) for c in ("users", "orders")], 4), MemoryStore()
    store.acquire("changelake:lock:db:orders", "other", 60)
    sinks = {c: Collecting() for c in ("users", "orders")}
    config = PipelineConfig("db", watch_level=WatchLevel("collection", ("users", "orders")), batch_timeout=0.1, lock=LockConfig(ttl=1, refresh_interval=0.2, retry_interval=0.1))
    workers = Workers(config, watch(spark, path), sinks.__getitem__, store, str(tmp_path / "check")).start()

    def until(true):
        for _ in range(300):
            if true():
                return True
            time.sleep(0.1)

    assert until(lambda: len(sinks["users"].rows) == 4) and not sinks["orders"].rows
    store.release("changelake:lock:db:orders", "other")
    assert until(lambda: len(sinks["orders"].rows) == 4)
    write_log(tmp_path / "log", [("insert", c, i, None) for i in range(6) for c in ("users", "orders")], 4)
    workers.stop()
    assert not workers.errors and {c: len(s.rows) for c, s in sinks.items()} == {"users": 6, "orders": 6} and store.keys() == ["resume_token:db:orders", "resume_token:db:users"]
    assert not store.is_locked("changelake:lock:db:users")


def test_a_larger_log_is_published_in_more_files(spark, tmp_path, monkeypatch):
    from changelake.plans import streams
    from tests.compare import DATA

    monkeypatch.setattr(streams, "FILE", 100, raising=False)
    times = streams.publish(spark, DATA, str(tmp_path / "log"), 2)
    parts = [[json.loads(line)["seq"] for line in p.read_text().splitlines()] for p in sorted((tmp_path / "log").glob("*.txt"))]
    assert max(map(len, parts)) <= 200 and times == 5 and sum(parts, []) == list(range(1000))


@pytest.mark.parametrize("name", ["q_x_dedup_watermark", "q_stream_images", "q_stream_restart", "q_stream_resume", "q_stream_reconnect"])
def test_streams_over_a_log_in_more_files(spark, monkeypatch, name):
    from changelake.plans import streams
    from changelake.plans.catalogue import ORACLES, QUERIES
    from tests.compare import DATA, oracle, rows

    monkeypatch.setattr(streams, "FILE", 100, raising=False)
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(oracle(ORACLES[name]))


def test_replay_reads_parts_of_a_file(tmp_path, monkeypatch):
    from changelake.sources import replay

    texts = [f'{{"_id":"é{i}","seq":{i},"fullDocument":"{"x" * (i % 7 * 9)}"}}' for i in range(50)]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join([*texts[:20], "no event", *texts[20:]]), newline="")
    for size in (1, 7, 64, 500, 10**6):
        monkeypatch.setattr(replay, "PART", size, raising=False)
        reader = ReplaySource({"path": str(tmp_path), "level": "deployment"}).streamReader(None)
        planned = reader.partitions({"file": 0, "line": 0}, {"file": 1, "line": 0})
        assert (len(planned) > 1) == (size < 1000)
        assert [r[-1] for p in planned for r in reader.read(p)] == list(range(50))
        strict = ReplaySource({"path": str(tmp_path), "level": "deployment", "broken": "fail"}).reader(None)
        with pytest.raises(replay.SourceError, match="line 21"):
            [r for p in strict.partitions() for r in strict.read(p)]
    behind = reader.partitions({"file": 0, "line": 30}, {"file": 1, "line": 0})
    assert [r[-1] for p in behind for r in reader.read(p)] == list(range(29, 50))
