import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from changelake import schema
from changelake.functions import errors, events, keys, match
from changelake.operators import batching, state
from changelake.operators.locks import replay

EVENTS = StructType([*schema.EVENT.fields, StructField("event_id", LongType())])
T = datetime(2025, 1, 15, 10, 30, 45)


def make(spark, rows):
    """Events from (operation, collection, key, document, update)."""
    return spark.createDataFrame([(op, "testdb", coll, key, doc, update, T, f'{{"_data":"token_{coll}_{i}"}}', i) for i, (op, coll, key, doc, update) in enumerate(rows)], schema=EVENTS)


@pytest.mark.parametrize(("op", "modification", "removal", "ddl", "unknown"), [("insert", 1, 0, 0, 0), ("update", 1, 0, 0, 0), ("replace", 1, 0, 0, 0), ("delete", 0, 1, 0, 0), ("drop", 0, 1, 1, 0), ("dropdatabase", 0, 1, 1, 0), ("rename", 0, 0, 1, 0), ("invalidate", 0, 0, 0, 0), ("futureOperation", 0, 0, 0, 1)])
def test_operation_table(spark, op, modification, removal, ddl, unknown):
    row = spark.createDataFrame([(op,)], "operation string").select(events.is_data_modification(), events.is_data_removal(), events.is_ddl(), events.is_unknown(), events.display_name()).first()
    assert [int(x) for x in row[:4]] == [modification, removal, ddl, unknown]
    assert row[4] == schema.DISPLAY.get(op, f'Unknown("{op}")')


GOLDEN = [
    ("hive", "data", "users", "jsonl", "", "data/collection=users/year=2025/month=01/day=15/hour=10/1736937045000.jsonl"),
    ("hive", "data", "orders", "jsonl", ".gz", "data/collection=orders/year=2025/month=01/day=15/hour=10/1736937045000.jsonl.gz"),
    ("date_hour", "events", "products", "csv", "", "events/products/2025/01/15/10/1736937045000.csv"),
    ("date", "daily", "analytics", "parquet", ".zst", "daily/analytics/2025/01/15/1736937045000.parquet.zst"),
    ("collection", "collections", "metrics", "avro", "", "collections/metrics/1736937045000.avro"),
    ("flat", "backup", "users", "jsonl", ".gz", "backup/users_1736937045000.jsonl.gz"),
    ("collection", None, "events", "jsonl", "", "events/1736937045000.jsonl"),
    ("date_hour", "", "users", "jsonl", "", "users/2025/01/15/10/1736937045000.jsonl"),
]


@pytest.mark.parametrize(("strategy", "prefix", "coll", "ext", "comp", "expected"), GOLDEN)
def test_object_keys(spark, strategy, prefix, coll, ext, comp, expected):
    df = spark.createDataFrame([(coll, T)], "collection string, t timestamp")
    assert df.select(keys.object_key(strategy, prefix, "collection", "t", ext, comp)).first()[0] == expected


def test_match_operators(spark):
    df = make(spark, [("insert", "users", '{"_id":1}', '{"priority":5,"tag":"a","open":true}', None), ("update", "orders", '{"_id":2}', '{"priority":4.5}', None), ("delete", "users", '{"_id":3}', None, None)])
    ids = lambda *stages: sorted(r[0] for r in match.apply(df, [{"$match": s} for s in stages]).select("event_id").collect())
    assert ids({"operationType": "insert"}) == [0]
    assert ids({"operationType": {"$in": ["insert", "update"]}}, {"fullDocument.priority": {"$gte": 5}}) == [0]
    assert ids({"fullDocument.priority": {"$lt": 5}}) == [1]
    assert ids({"fullDocument.tag": {"$exists": False}}) == [1, 2]
    assert ids({"fullDocument.tag": {"$ne": "a"}}) == [1, 2]
    assert ids({"fullDocument.tag": {"$nin": ["a"]}}) == [1, 2]
    assert ids({"fullDocument.open": True}) == [0]
    assert ids({"fullDocument.priority": {"$not": {"$gt": 4}}}) == [2]
    assert ids({"$or": [{"ns.coll": "orders"}, {"documentKey._id": 3}]}) == [1, 2]
    assert ids({"$nor": [{"ns.coll": "orders"}]}) == [0, 2]
    assert ids({"fullDocument": None}) == [2]
    assert match.apply(df, [{"$project": {"fullDocument.priority": 1, "name": "$ns.coll"}}]).columns == ["priority", "name"]
    for bad in ({"$group": {"_id": 1}}, {"$match": {"nowhere": 1}}, {"$match": {"operationType": {"$regex": "x"}}}):
        with pytest.raises(match.UnsupportedStage):
            match.apply(df, [bad])


def test_filters_reach_the_scan(spark, tmp_path):
    make(spark, [("insert", "users", None, None, None)]).write.parquet(str(tmp_path / "e"))
    plan = match.apply(spark.read.parquet(str(tmp_path / "e")), [{"$match": {"operationType": "insert"}}]).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(operation,insert)" in plan and "full_document" not in plan


def test_estimated_size(spark):
    df = make(spark, [("update", "users", '{"_id":1}', '{"a":1,"b":{"c":2}}', ('{"x":1}', ["old", "older"], None)), ("drop", "users", None, None, None)])
    assert [r[0] for r in df.orderBy("event_id").select(events.estimated_size(100)).collect()] == [100 + 50 * 4 + 8, 100]


def test_json_line_leaves_absent_members_out(spark):
    df = make(spark, [("invalidate", "us\"ers", None, None, None), ("insert", "u", '{"_id":1}', '{"z":1, "a":1.50}', None)])
    lines = [r[0] for r in df.orderBy("event_id").select(events.json_line()).collect()]
    assert lines[0] == '{"operationType":"invalidate","ns":{"database":"testdb","collection":"us\\"ers"},"clusterTime":"2025-01-15T10:30:45.000000Z","_id":{"_data":"token_us"ers_0"}}'
    assert '"fullDocument":{"z":1, "a":1.50}' in lines[1]


def test_size_or_time_follows_the_loop(spark):
    r = random.Random(3)
    times, t = [], 0
    for _ in range(700):
        t += r.choice([1, 5, 40, 900])
        times.append(t)
    df = spark.createDataFrame([(i, "w", x) for i, x in enumerate(times)], "event_id long, collection string, us long").withColumn("cluster_time", F.timestamp_micros("us"))
    got = batching.size_or_time(df, 7, 1000).groupBy("tick", "chunk").count().orderBy("tick", "chunk").collect()
    assert [x[2] for x in got] == batching.simulate_size_or_time(times, 7, 1000)


def test_numbered_with_gaps(spark):
    ids = sorted(random.Random(5).sample(range(10_000), 500))
    got = batching.numbered(spark.createDataFrame([(i,) for i in ids], "event_id long"), "event_id", width=64).collect()
    assert sorted((r["event_id"], r["row_index"]) for r in got) == [(v, k) for k, v in enumerate(ids)]


def test_one_event_may_pass_the_byte_limit(spark):
    df = spark.createDataFrame([(i, "c", s) for i, s in enumerate([3, 3, 3, 20, 1, 1])], "event_id long, collection string, s long")
    got = batching.by_bytes(df, 6, F.col("s"), ["collection"]).orderBy("event_id").collect()
    assert [r["batch"] for r in got] == [0, 0, 1, 2, 3, 3]


def test_dedup_keeps_first_and_all_without_key(spark):
    df = make(spark, [("insert", "a", "k", None, None), ("update", "b", "k", None, None), ("drop", "a", None, None, None), ("drop", "a", None, None, None)])
    assert sorted(r[0] for r in state.dedup_by_key(df.select("event_id", "document_key", "operation")).select("event_id").collect()) == [0, 2, 3]


def test_update_lookup_and_pre_image(spark):
    df = make(spark, [("insert", "a", "k", "1", None), ("update", "a", "k", None, None), ("replace", "a", "k", "2", None), ("update", "a", "j", None, None)])
    assert [r["full_document"] for r in state.update_lookup(df, ["document_key"]).orderBy("event_id").collect()] == ["1", "1", "2", None]
    assert [r["full_document_before_change"] for r in state.pre_image(df, ["document_key"]).orderBy("event_id").collect()] == [None, "1", None, None]


def test_error_classes(spark):
    df = spark.createDataFrame([("connection", 6, []), ("connection", 286, ["NetworkError"]), ("connection", None, ["NetworkError"]), ("invalidated", None, []), ("max_retries", 6, [])], "kind string, code int, labels array<string>")
    assert [r[0] for r in df.select(errors.retryable(F.col("kind"), F.col("code"), F.col("labels"))).collect()] == [True, False, True, False, False]


def test_backoff():
    assert errors.backoff_schedule(5, 0.1, 1.0) == [0.1, 0.2, 0.4, 0.8, 1.0]
    for base, got in zip(errors.backoff_schedule(6, 1, 8), errors.backoff_schedule(6, 1, 8, 0.5, random.Random(1)), strict=True):
        assert 0.75 * base <= got <= 1.25 * base


@pytest.mark.parametrize(("url", "masked"), [("redis://user:pw@host:6379/0", "redis://***:***@host:6379/0"), ("redis://:pw@host", "redis://:***@host"), ("redis://host:6379", "redis://host:6379"), ("nonsense", "***.***"), ("redis://host:port", "redis://***.***")])
def test_masking(url, masked):
    assert errors.mask_credentials(url) == masked


def test_lock_log(spark):
    ops = [(1, 0, "k", "a", "acquire", 10), (2, 1, "k", "b", "acquire", 10), (3, 2, "k", "b", "refresh", 10), (4, 9, "k", "a", "refresh", 10), (5, 12, "k", "x", "is_locked", 0), (6, 19, "k", "b", "acquire", 10), (7, 20, "k", "a", "release", 0), (8, 21, "k", "b", "release", 0)]
    got = replay(spark.createDataFrame(ops, "seq long, at long, key string, owner string, action string, ttl long")).orderBy("seq").collect()
    assert [r["ok"] for r in got] == [True, False, False, True, True, True, False, True]
