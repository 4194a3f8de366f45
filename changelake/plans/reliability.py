"""Queries over retries, error classes, tokens and locks."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelake.functions import errors as X
from changelake.functions import keys as K
from changelake.operators import state as S
from changelake.operators.health import lock_alerts
from changelake.operators.locks import replay
from changelake.plans.changelog import CHG, changelog
from changelake.plans.registry import query


@query("SELECT CAST(n AS BIGINT) AS attempt, CAST(least(30000.0, 100.0 * pow(2.0, n - 1)) AS BIGINT) AS delay_ms, CAST(least(30000.0, 100.0 * pow(2.0, n - 1)) * 0.95 AS DOUBLE) AS least_ms, CAST(least(30000.0, 100.0 * pow(2.0, n - 1)) * 1.05 AS DOUBLE) AS most_ms FROM range(1, 13) t(n)")
def q_backoff_schedule(spark, sf_dir):
    delay = X.backoff_ms(F.col("id"))
    return spark.range(1, 13).select(F.col("id").alias("attempt"), delay.alias("delay_ms"), (delay * F.lit(0.95)).alias("least_ms"), (delay * F.lit(1.05)).alias("most_ms"))


@query("SELECT CAST(n AS BIGINT) AS retry, CAST(least(1000.0, 100.0 * pow(2.0, n - 1)) AS BIGINT) AS delay_ms, CAST(sum(least(1000.0, 100.0 * pow(2.0, n - 1))) OVER (ORDER BY n) AS BIGINT) AS waited_ms FROM range(1, 8) t(n)")
def q_retry_schedule(spark, sf_dir):
    delays = spark.range(1, 8).withColumn("delay_ms", X.backoff_ms(F.col("id"), 100, 1000))
    waited = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("id")), F.lit(0).cast("long"), lambda s, n: s + X.backoff_ms(n, 100, 1000))
    return delays.select(F.col("id").alias("retry"), "delay_ms", waited.alias("waited_ms"))


MESSAGES = "(VALUES ('Request TIMEOUT after 5s'), ('authentication timeout'), ('Connection refused'), ('network unreachable'), ('serialization failed'), ('cannot encode value'), ('permission denied'), ('AUTH required'), ('validation of field x'), ('key not found'), ('HTTP 404'), ('Rate limit reached'), ('request throttled'), ('boom'), ('')) AS t(message)"


@query(f"""SELECT message, CASE WHEN m LIKE '%timeout%' THEN 'timeout_error' WHEN m LIKE '%connection%' OR m LIKE '%network%' THEN 'connection_error' WHEN m LIKE '%serialization%' OR m LIKE '%encode%' THEN 'serialization_error'
  WHEN m LIKE '%permission%' OR m LIKE '%auth%' THEN 'permission_error' WHEN m LIKE '%validation%' THEN 'validation_error' WHEN m LIKE '%not found%' OR m LIKE '%404%' THEN 'not_found_error'
  WHEN m LIKE '%rate limit%' OR m LIKE '%throttle%' THEN 'rate_limit_error' ELSE 'unknown_error' END AS category FROM (SELECT message, lower(message) AS m FROM {MESSAGES})""")
def q_categorize_error(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {MESSAGES}").select("message", X.category(F.col("message")).alias("category"))


FAILURES = "(VALUES (1,'connection',6,''), (2,'connection',43,''), (3,'connection',13436,''), (4,'connection',286,''), (5,'connection',18,''), (6,'connection',18,'NetworkError'), (7,'connection',NULL,'RetryableWriteError'), (8,'connection',NULL,''), (9,'invalidated',NULL,''), (10,'max_retries',NULL,''), (11,'conversion',6,''), (12,'persistence',NULL,'NetworkError'), (13,'configuration',NULL,'')) AS t(id, kind, code, label)"


@query(f"""SELECT id, CASE WHEN kind = 'connection' AND code = 286 THEN 'invalid_token' ELSE kind END AS category,
  kind = 'connection' AND coalesce(code, 0) <> 286 AND (label IN ('RetryableWriteError','TransientTransactionError','NetworkError') OR coalesce(code IN (6,7,43,89,91,10107,11600,11602,13435,13436), false)) AS retryable FROM {FAILURES}""")
def q_error_retryable(spark, sf_dir):
    f = spark.sql(f"SELECT * FROM {FAILURES}")
    kind, code = F.col("kind"), F.col("code")
    return f.select("id", X.stream_category(kind, code).alias("category"), X.retryable(kind, code, F.array("label")).alias("retryable"))


@query(CHG + "SELECT concat('resume_token:', database, ':', collection) AS token_key, arg_max(resume_token, event_id) AS resume_token FROM chg GROUP BY 1")
def q_list_tokens(spark, sf_dir):
    return S.latest_tokens(changelog(spark, sf_dir), K.resume_token_key(F.lit("collection"), F.col("database"), F.col("collection")))


LOCKS = "(SELECT event_id AS seq, epoch_us(ts) // 1000000 AS sec, event_type AS key, concat('w', user_id % 3) AS owner, CASE event_id % 4 WHEN 0 THEN 'acquire' WHEN 1 THEN 'refresh' WHEN 2 THEN 'is_locked' ELSE CASE WHEN user_id % 2 = 0 THEN 'release' ELSE 'acquire' END END AS action FROM events)"


REPLAY = f"""WITH RECURSIVE ops AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM {LOCKS}),
state AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, '' AS owner, '' AS action, false AS ok, CAST(NULL AS VARCHAR) AS holder, CAST(0 AS BIGINT) AS until FROM ops WHERE rn = 1
  UNION ALL
  SELECT key, rn, seq, owner, action, ok, CASE WHEN ok AND action IN ('acquire', 'refresh') THEN owner WHEN ok AND action = 'release' THEN NULL ELSE live END,
         CASE WHEN ok AND action IN ('acquire', 'refresh') THEN sec + 3600 ELSE until END
  FROM (SELECT *, CASE action WHEN 'acquire' THEN live IS NULL WHEN 'is_locked' THEN live IS NOT NULL ELSE coalesce(live = owner, false) END AS ok
        FROM (SELECT o.key, o.rn, o.seq, o.owner, o.action, o.sec, s.until, CASE WHEN o.sec < s.until THEN s.holder END AS live FROM state s JOIN ops o ON o.key = s.key AND o.rn = s.rn + 1)))
"""


@query(REPLAY + "SELECT seq, key, owner, action, ok, holder FROM state WHERE rn > 0")
def q_lock_replay(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    turn = F.col("event_id") % 4
    action = F.when(turn == 0, "acquire").when(turn == 1, "refresh").when(turn == 2, "is_locked").otherwise(F.when(F.col("user_id") % 2 == 0, "release").otherwise("acquire"))
    requests = e.select(F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("key"), F.concat(F.lit("w"), F.col("user_id") % 3).alias("owner"), action.alias("action"), F.lit(3600).alias("ttl"))
    return replay(requests)


@query(REPLAY + ", a AS (SELECT key, count(*) FILTER (action = 'refresh' AND NOT ok) AS lost, CASE WHEN max_by(struct_pack(h := holder), seq).h IS NULL THEN 0 ELSE 1 END AS held FROM state WHERE rn > 0 GROUP BY key) SELECT key, lost, held FROM a WHERE lost > 0 OR held = 0")
def q_alert_locks(spark, sf_dir):
    return lock_alerts(q_lock_replay(spark, sf_dir))
