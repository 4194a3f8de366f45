"""Queries over batching, deduplication and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelake.functions import events as E
from changelake.functions import keys as K
from changelake.operators import batching as B
from changelake.operators import state as S
from changelake.plans.changelog import CHG, changelog
from changelake.plans.registry import query

DAY_US, START_US, SIZE = 86_400_000_000, 1_704_067_200_000_000, 100
TICKS = CHG + f""", ticked AS (SELECT *, CAST(floor((epoch_us(cluster_time) - {START_US}) / {DAY_US}.0) AS BIGINT) AS tick FROM chg),
chunked AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY collection, tick ORDER BY event_id) - 1) / {SIZE}.0) AS BIGINT) AS chunk FROM ticked),
batches AS (SELECT collection, tick, chunk, count(*) AS n FROM chunked GROUP BY collection, tick, chunk) """


def batched(spark, sf_dir):
    return B.size_or_time(changelog(spark, sf_dir), SIZE, DAY_US, START_US)


def batches(spark, sf_dir):
    return batched(spark, sf_dir).groupBy("collection", "tick", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query(TICKS + "SELECT * FROM batches")
def q_batch_size_or_time(spark, sf_dir):
    return batches(spark, sf_dir)


@query(CHG + f"SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / {SIZE}.0) AS BIGINT) AS batch FROM chg")
def q_batch_fixed(spark, sf_dir):
    return B.fixed(changelog(spark, sf_dir).select("event_id"), SIZE)


BYTES = 4096


@query("WITH RECURSIVE " + TICKS.removeprefix("WITH ").strip() + f""", sized AS (SELECT collection, tick, event_id, row_number() OVER (PARTITION BY collection, tick ORDER BY event_id) AS rn,
  200 + 50 * (coalesce(len(json_keys(document_key)), 0) + coalesce(len(json_keys(full_document)), 0)) AS z FROM ticked),
walk AS (SELECT collection, tick, rn, event_id, z AS bytes, z AS held, CAST(0 AS BIGINT) AS batch FROM sized WHERE rn = 1
  UNION ALL SELECT s.collection, s.tick, s.rn, s.event_id, s.z, CASE WHEN w.held + s.z > {BYTES} THEN s.z ELSE w.held + s.z END, w.batch + CASE WHEN w.held + s.z > {BYTES} THEN 1 ELSE 0 END
  FROM walk w JOIN sized s ON s.collection = w.collection AND s.tick = w.tick AND s.rn = w.rn + 1)
SELECT collection, tick, event_id, CAST(bytes AS BIGINT) AS bytes, batch FROM walk""")
def q_batch_bytes(spark, sf_dir):
    ticked = changelog(spark, sf_dir).withColumn("tick", B.tick("cluster_time", DAY_US, START_US))
    return B.by_bytes(ticked, BYTES, E.estimated_size(200, update=None), ["collection", "tick"])


@query(CHG + "SELECT collection, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM chg GROUP BY collection")
def q_group_by_collection(spark, sf_dir):
    return changelog(spark, sf_dir).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(CHG + "SELECT event_id, document_key, operation FROM (SELECT *, row_number() OVER (PARTITION BY document_key ORDER BY event_id) AS rn FROM chg) WHERE rn = 1 OR document_key IS NULL")
def q_dedup_by_key(spark, sf_dir):
    return S.dedup_by_key(changelog(spark, sf_dir).select("event_id", "document_key", "operation"))


@query(TICKS + "SELECT tick, count(DISTINCT collection) AS collections, count(*) AS objects, CAST(sum(n) AS BIGINT) AS events FROM batches GROUP BY tick")
def q_objects_per_flush(spark, sf_dir):
    return batches(spark, sf_dir).groupBy("tick").agg(F.count_distinct("collection").alias("collections"), F.count(F.lit(1)).alias("objects"), F.sum("n").alias("events"))


@query(TICKS + "SELECT collection, count(*) AS batches, CAST(sum(n) AS BIGINT) AS events, min(n) AS least, max(n) AS most, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95 FROM batches GROUP BY collection")
def q_batch_size_stats(spark, sf_dir):
    q = lambda p: F.round(F.percentile("n", F.lit(p)), 6)
    return batches(spark, sf_dir).groupBy("collection").agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("events"), F.min("n").alias("least"), F.max("n").alias("most"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def _keys(strategy, prefix, extension, compression):
    def f(spark, sf_dir):
        return changelog(spark, sf_dir).select("event_id", K.object_key(strategy, prefix, "collection", "cluster_time", extension, compression).alias("object_key"))

    f.__name__ = f"q_key_{strategy}"
    return f


_MS = "CAST(epoch_us(cluster_time) // 1000 AS VARCHAR)"
query(CHG + f"SELECT event_id, concat('data/collection=', collection, strftime(cluster_time, '/year=%Y/month=%m/day=%d/hour=%H/'), {_MS}, '.jsonl.gz') AS object_key FROM chg")(_keys("hive", "data", "jsonl", ".gz"))
query(CHG + f"SELECT event_id, concat('events/', collection, strftime(cluster_time, '/%Y/%m/%d/%H/'), {_MS}, '.csv') AS object_key FROM chg")(_keys("date_hour", "events", "csv", ""))
query(CHG + f"SELECT event_id, concat('daily/', collection, strftime(cluster_time, '/%Y/%m/%d/'), {_MS}, '.parquet.zst') AS object_key FROM chg")(_keys("date", "daily", "parquet", ".zst"))
query(CHG + f"SELECT event_id, concat(collection, '/', {_MS}, '.avro') AS object_key FROM chg")(_keys("collection", None, "avro", ""))
query(CHG + f"SELECT event_id, concat('backup/', collection, '_', {_MS}, '.jsonl.gz') AS object_key FROM chg")(_keys("flat", "backup", "jsonl", ".gz"))

SCOPES = "(VALUES ('collection','testdb','users'), ('collection','testdb',NULL), ('database','testdb',NULL), ('deployment','testdb',NULL)) AS t(level, db, coll)"


@query(f"""SELECT level, coll, CASE WHEN level = 'collection' AND coll IS NULL THEN concat('resume_token:', db) WHEN level = 'collection' THEN concat('resume_token:', db, ':', coll)
  WHEN level = 'database' THEN concat('resume_token:database:', db) ELSE 'resume_token:deployment' END AS token_key FROM {SCOPES}""")
def q_resume_token_key(spark, sf_dir):
    scopes = spark.sql(f"SELECT * FROM {SCOPES}")
    return scopes.select("level", "coll", K.resume_token_key(F.col("level"), F.col("db"), F.col("coll")).alias("token_key"))


@query(f"""SELECT level, coll, concat('changelake:lock:', db, ':', CASE level WHEN 'collection' THEN coll WHEN 'database' THEN '__database__' ELSE '__deployment__' END) AS lock_key FROM {SCOPES} WHERE level <> 'collection' OR coll IS NOT NULL""")
def q_lock_key(spark, sf_dir):
    scopes = spark.sql(f"SELECT * FROM {SCOPES}").where("level <> 'collection' OR coll IS NOT NULL")
    return scopes.select("level", "coll", K.lock_key(F.col("level"), F.col("db"), F.col("coll")).alias("lock_key"))
