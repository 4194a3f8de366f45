"""Queries over pipeline health."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelake.functions import events as E
from changelake.operators import health as H
from changelake.plans.batches import DAY_US, START_US, TICKS, batched, batches
from changelake.plans.changelog import CHG, changelog
from changelake.plans.registry import query


def _bucket(seconds: int) -> str:
    return f"CAST(floor(epoch_us(cluster_time) / {seconds * 1_000_000}.0) AS BIGINT)"


@query(CHG + "SELECT collection, operation, count(*) AS n FROM chg GROUP BY collection, operation")
def q_events_processed(spark, sf_dir):
    return changelog(spark, sf_dir).groupBy("collection", "operation").agg(F.count(F.lit(1)).alias("n"))


@query(TICKS + """SELECT (SELECT CAST(sum(n) AS BIGINT) FROM batches) AS events, (SELECT count(*) FROM batches) AS batches,
  (SELECT count(*) FROM chg WHERE operation NOT IN ('insert','update','delete','replace','invalidate','drop','dropdatabase','rename')) AS unknown_operations""")
def q_pipeline_stats(spark, sf_dir):
    each = batched(spark, sf_dir).groupBy("collection", "tick", "chunk").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(E.is_unknown(), 1)).alias("unknown"))
    return each.agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("batches"), F.sum("unknown").alias("unknown_operations"))


@query(CHG + f"SELECT collection, operation, {_bucket(300)} AS bucket, count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM chg GROUP BY 1, 2, 3")
def q_rate_5m(spark, sf_dir):
    return H.rate(changelog(spark, sf_dir), 300, ["collection", "operation"])


@query(CHG + f"SELECT collection, {_bucket(300)} AS bucket, count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM chg GROUP BY 1, 2")
def q_rate_by_collection(spark, sf_dir):
    return H.rate(changelog(spark, sf_dir), 300, ["collection"])


@query(CHG + f""", r AS (SELECT collection, {_bucket(3600)} AS bucket, count(*) AS n, round(count(*) / 3600.0, 6) AS per_second FROM chg GROUP BY 1, 2)
SELECT a.collection, a.bucket, a.n, a.per_second, b.n AS before, a.n - coalesce(b.n, 0) AS change FROM r a LEFT JOIN r b ON a.collection = b.collection AND a.bucket = b.bucket + 1""")
def q_rate_offset(spark, sf_dir):
    return H.offset_rate(H.rate(changelog(spark, sf_dir), 3600, ["collection"]), 1, ["collection"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def q_latency_quantiles(spark, sf_dir):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


@query(TICKS + "SELECT collection, round(sum(n) / CAST(count(*) AS DOUBLE), 6) AS average FROM batches GROUP BY collection")
def q_avg_batch(spark, sf_dir):
    return batches(spark, sf_dir).groupBy("collection").agg(F.round(F.sum("n") / F.count(F.lit(1)).cast("double"), 6).alias("average"))


@query(CHG + f""", e AS (SELECT collection, {_bucket(86400)} AS bucket, count(*) AS n, count(CASE WHEN operation = 'delete' THEN 1 END) AS failed FROM chg GROUP BY 1, 2)
SELECT *, round(failed * 100.0::DOUBLE / n, 6) AS error_pct, round(100.0::DOUBLE - failed * 100.0::DOUBLE / n, 6) AS success_pct FROM e""")
def q_error_pct(spark, sf_dir):
    return H.error_share(changelog(spark, sf_dir), F.col("operation") == "delete", ["collection", H.bucket(86400).alias("bucket")])


@query(CHG + """, e AS (SELECT collection, count(*) AS n, count(CASE WHEN operation = 'invalidate' THEN 1 END) AS failed FROM chg GROUP BY 1)
SELECT *, round(failed * 100.0::DOUBLE / n, 6) AS error_pct, round(100.0::DOUBLE - failed * 100.0::DOUBLE / n, 6) AS success_pct FROM e""")
def q_write_success(spark, sf_dir):
    return H.error_share(changelog(spark, sf_dir), F.col("operation") == "invalidate", ["collection"])


@query(TICKS + ", t AS (SELECT collection, tick, max(least(n, 100)) AS depth, CAST(sum(n) AS BIGINT) AS events FROM batches GROUP BY collection, tick) SELECT collection, max(depth) AS deepest, round(regr_slope(CAST(events AS DOUBLE), CAST(tick AS DOUBLE)), 6) AS slope FROM t GROUP BY collection")
def q_queue_depth(spark, sf_dir):
    ticks = batches(spark, sf_dir).groupBy("collection", "tick").agg(F.max(F.least("n", F.lit(100))).alias("depth"), F.sum("n").alias("events"))
    return ticks.groupBy("collection").agg(F.max("depth").alias("deepest"), F.round(F.regr_slope(F.col("events").cast("double"), F.col("tick").cast("double")), 6).alias("slope"))


@query(CHG + f"SELECT collection, {_bucket(3600)} AS bucket, CAST(sum(length(full_document)) AS BIGINT) AS bytes, round(sum(length(full_document)) / 3600.0, 6) AS bytes_per_second FROM chg WHERE full_document IS NOT NULL GROUP BY 1, 2")
def q_bytes_rate(spark, sf_dir):
    docs = changelog(spark, sf_dir).where("full_document IS NOT NULL")
    total = F.sum(F.octet_length("full_document"))
    return docs.groupBy("collection", H.bucket(3600).alias("bucket")).agg(total.alias("bytes"), F.round(total / F.lit(3600.0), 6).alias("bytes_per_second"))


@query(CHG + f""", e AS (SELECT collection, {_bucket(86400)} AS bucket, count(*) AS n, count(CASE WHEN operation = 'delete' THEN 1 END) AS failed FROM chg GROUP BY 1, 2)
SELECT collection, bucket, n, failed FROM e WHERE failed * 100.0 / n > 5""")
def q_alert_error_rate(spark, sf_dir):
    shares = H.error_share(changelog(spark, sf_dir), F.col("operation") == "delete", ["collection", H.bucket(86400).alias("bucket")])
    return shares.where("error_pct > 5").select("collection", "bucket", "n", "failed")


@query(CHG + f""", s AS (SELECT DISTINCT collection, {_bucket(600)} AS bucket FROM chg), g AS (SELECT collection, bucket AS after_bucket, lead(bucket) OVER (PARTITION BY collection ORDER BY bucket) - bucket - 1 AS silent FROM s) SELECT * FROM g WHERE silent > 0""")
def q_alert_no_events(spark, sf_dir):
    return H.gaps(changelog(spark, sf_dir), 600, "collection")


@query(TICKS + f"""SELECT collection, count(*) AS n, round(sum(({START_US} + (tick + 1) * {DAY_US}) - epoch_us(cluster_time)) / CAST(count(*) AS DOUBLE) / 1e6, 6) AS mean_lag,
  round(max(({START_US} + (tick + 1) * {DAY_US}) - epoch_us(cluster_time)) / 1e6, 6) AS most_lag FROM ticked GROUP BY collection""")
def q_lag(spark, sf_dir):
    """How far events are behind when their batch is flushed by the timer."""
    flushed = F.timestamp_micros(F.lit(START_US) + (F.col("tick") + 1) * DAY_US)
    return H.lag(batched(spark, sf_dir), flushed, ["collection"])


@query(CHG + f""", l AS (SELECT collection, {_bucket(86400)} AS bucket, arg_max(operation, event_id) AS op FROM chg GROUP BY 1, 2) SELECT collection, bucket, 0 AS status FROM l WHERE op = 'invalidate'""")
def q_alert_status(spark, sf_dir):
    return H.not_running(changelog(spark, sf_dir), 86400, "collection", "event_id")


LATENCY = [1, 2, 5, 10, 20, 50, 100, 200, 500]


@query(f"""WITH b AS (SELECT event_type, CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) AS bucket, value FROM events), le AS (SELECT CAST(unnest({LATENCY}) AS DOUBLE) AS le),
c AS (SELECT event_type, bucket, le, count(value) FILTER (value <= le) AS below, count(value) AS n FROM b, le GROUP BY 1, 2, 3),
w AS (SELECT *, coalesce(lag(le) OVER g, 0.0) AS low, coalesce(lag(below) OVER g, 0) AS before FROM c WINDOW g AS (PARTITION BY event_type, bucket ORDER BY le)),
p AS (SELECT event_type, bucket, n, arg_min(low + (le - low) * CASE WHEN below > before THEN (0.99::DOUBLE * n - before) / (below - before) ELSE 1 END, le) FILTER (below >= 0.99::DOUBLE * n) AS inside FROM w GROUP BY 1, 2, 3)
SELECT event_type, bucket, n, round(coalesce(inside, {float(LATENCY[-1])}), 6) AS p99 FROM p WHERE coalesce(inside, {float(LATENCY[-1])}) > 5""")
def q_alert_write_latency(spark, sf_dir):
    """Windows whose 99th percentile, read from a histogram, is above 5 seconds; the value stands for a write's seconds."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", H.bucket(86400, "ts").alias("bucket"), "value")
    p99 = H.histogram(e, "value", LATENCY, ["event_type", "bucket"]).withColumn("p99", H.histogram_quantile(0.99, LATENCY))
    return p99.where("p99 > 5").select("event_type", "bucket", "n", F.round("p99", 6).alias("p99"))


@query(f"SELECT user_id % 3 AS worker, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS bucket, count(*) AS n, round(count(*) / 3600.0, 6) AS per_second FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) / 3600.0 > 1 / 3600.0")
def q_alert_retry_rate(spark, sf_dir):
    """Hours with more than one retry an hour; errors stand for retries, and the log is too thin for one a second."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select((F.col("user_id") % 3).alias("worker"), "ts")
    return H.rate(e, 3600, ["worker"], "ts").where(F.col("n") > 1)


@query(TICKS + ", t AS (SELECT collection, tick, CAST(sum(n) AS BIGINT) AS events FROM batches GROUP BY collection, tick), s AS (SELECT collection, regr_slope(CAST(events AS DOUBLE), CAST(tick AS DOUBLE)) AS slope FROM t GROUP BY collection) SELECT collection, round(slope, 6) AS slope FROM s WHERE slope > 0")
def q_alert_queue_growing(spark, sf_dir):
    ticks = batches(spark, sf_dir).groupBy("collection", "tick").agg(F.sum("n").alias("events"))
    slope = F.regr_slope(F.col("events").cast("double"), F.col("tick").cast("double"))
    return ticks.groupBy("collection").agg(slope.alias("slope")).where("slope > 0").select("collection", F.round("slope", 6).alias("slope"))
