"""Queries over events, watch levels and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from changelake.functions import events as E
from changelake.functions import match as M
from changelake.operators import state as S
from changelake.operators.normalize import normalize
from changelake.plans.changelog import CHG, changelog
from changelake.plans.registry import query
from changelake.sources.replay import at_level

KNOWN_SQL = "('insert','update','delete','replace','invalidate','drop','dropdatabase','rename')"


@query(CHG + "SELECT event_id, operation, operation = 'insert' AS is_insert, operation = 'update' AS is_update, operation = 'delete' AS is_delete, operation = 'replace' AS is_replace, operation = 'invalidate' AS is_invalidate FROM chg")
def q_operation_flags(spark, sf_dir):
    flags = [E.is_operation(x).alias(f"is_{x}") for x in ("insert", "update", "delete", "replace", "invalidate")]
    return changelog(spark, sf_dir).select("event_id", "operation", *flags)


@query(CHG + "SELECT event_id, operation FROM chg WHERE operation IN ('insert','update','replace')")
def q_is_data_modification(spark, sf_dir):
    return changelog(spark, sf_dir).where(E.is_data_modification()).select("event_id", "operation")


@query(CHG + "SELECT event_id, operation FROM chg WHERE operation IN ('delete','drop','dropdatabase')")
def q_is_data_removal(spark, sf_dir):
    return changelog(spark, sf_dir).where(E.is_data_removal()).select("event_id", "operation")


@query(CHG + "SELECT event_id, operation FROM chg WHERE operation IN ('drop','dropdatabase','rename')")
def q_is_ddl(spark, sf_dir):
    return changelog(spark, sf_dir).where(E.is_ddl()).select("event_id", "operation")


@query(CHG + f"SELECT event_id, operation FROM chg WHERE operation NOT IN {KNOWN_SQL}")
def q_is_unknown(spark, sf_dir):
    return changelog(spark, sf_dir).where(E.is_unknown()).select("event_id", "operation")


@query(CHG + "SELECT event_id, full_document IS NOT NULL AS has_full_document, operation = 'update' AS has_update_description FROM chg")
def q_has_full_document(spark, sf_dir):
    return changelog(spark, sf_dir).select("event_id", E.has_full_document().alias("has_full_document"), E.has_update_description().alias("has_update_description"))


@query(CHG + "SELECT event_id, concat(database, '.', collection) AS full_namespace, database AS database_name, collection AS collection_name FROM chg")
def q_full_namespace(spark, sf_dir):
    return changelog(spark, sf_dir).select("event_id", E.full_namespace().alias("full_namespace"), F.col("database").alias("database_name"), F.col("collection").alias("collection_name"))


@query(CHG + "SELECT event_id, json_extract_string(document_key, '$._id') AS document_id FROM chg")
def q_document_id(spark, sf_dir):
    return changelog(spark, sf_dir).select("event_id", E.document_id().alias("document_id"))


@query(CHG + """SELECT event_id, CAST(200 + 50 * (coalesce(len(json_keys(document_key)), 0) + coalesce(len(json_keys(full_document)), 0)
  + CASE WHEN operation = 'update' THEN coalesce(len(json_keys(full_document)), 0) ELSE 0 END)
  + CASE WHEN operation = 'update' AND event_id % 2 = 0 THEN 6 ELSE 0 END AS BIGINT) AS estimated_size FROM chg""")
def q_estimated_size(spark, sf_dir):
    return changelog(spark, sf_dir).select("event_id", E.estimated_size(200).alias("estimated_size"))


@query(CHG + "SELECT event_id, unnest(json_keys(full_document)) AS field FROM chg WHERE operation = 'update'")
def q_update_fields(spark, sf_dir):
    return changelog(spark, sf_dir).where(E.has_update_description()).select("event_id", F.explode(E.update_fields()).alias("field"))


@query("""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'shardCollection' WHEN event_id % 13 = 0 THEN 'dropdatabase' WHEN event_type = 'view' THEN 'replace' ELSE 'insert' END AS operation,
  CASE WHEN event_id % 97 = 0 THEN '' ELSE 'testdb' END AS database, CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN '' ELSE 'users' END AS collection,
  CASE WHEN event_id % 5 = 0 THEN greatest(event_id % 7 - 3, 0) END AS new_size,
  CASE WHEN event_id % 101 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE ts END AS cluster_time FROM events WHERE event_id % 103 <> 0""")
def q_normalize(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    name = F.when(i % 17 == 0, "shardCollection").when(i % 13 == 0, "dropDatabase").when(F.col("event_type") == "view", "replace").otherwise("INSERT")
    ns = F.when(i % 97 != 0, F.struct(F.lit("testdb").alias("database"), F.when(i % 89 != 0, "users").alias("collection")))
    cut = F.when(i % 5 == 0, F.array(F.struct(F.lit("tags").alias("field"), (i % 7 - 3).alias("newSize"))))
    raw = e.select(
        "event_id", name.alias("operationType"), ns.alias("ns"), F.lit(None).cast("string").alias("documentKey"), F.col("props").alias("fullDocument"),
        F.struct(F.lit("{}").alias("updatedFields"), F.array().cast("array<string>").alias("removedFields"), cut.alias("truncatedArrays")).alias("updateDescription"),
        F.when(i % 101 != 0, F.col("ts").cast("timestamp")).alias("clusterTime"), F.when(i % 103 != 0, i.cast("string")).alias("_id"),
    )
    out = normalize(raw, F.lit("1970-01-01").cast("timestamp"))
    return out.select("event_id", "operation", "database", "collection", F.col("update_description.truncatedArrays")[0]["newSize"].alias("new_size"), F.col("cluster_time").cast("timestamp_ntz").alias("cluster_time"))


#: As FLAT_SQL, for formats that read documents back without spaces between members.
COMPACT_SQL = """SELECT operation, database, collection, cluster_time, document_key, replace(full_document, '": ', '":') AS full_document, resume_token FROM chg"""
FLAT_SQL = "SELECT operation, database, collection, cluster_time, document_key, full_document, resume_token FROM chg"


@query(CHG + FLAT_SQL)
def q_flat7(spark, sf_dir):
    return changelog(spark, sf_dir).select(*E.flat7()).withColumn("cluster_time", F.col("cluster_time").cast("timestamp_ntz"))


@query(CHG + "SELECT event_id, collection FROM chg WHERE database = 'testdb' AND collection IN ('users', 'orders')")
def q_watch_collections(spark, sf_dir):
    return at_level(changelog(spark, sf_dir), "collection", "testdb", ["users", "orders"]).select("event_id", "collection")


@query(CHG + "SELECT event_id, collection FROM chg WHERE database = 'testdb'")
def q_watch_database(spark, sf_dir):
    return at_level(changelog(spark, sf_dir), "database", "testdb").select("event_id", "collection")


@query(CHG + "SELECT event_id, database, collection FROM chg")
def q_watch_deployment(spark, sf_dir):
    return at_level(changelog(spark, sf_dir), "deployment").select("event_id", "database", "collection")


@query(CHG + "SELECT event_id, operation FROM chg WHERE operation = 'insert'")
def q_match_insert(spark, sf_dir):
    return M.apply(changelog(spark, sf_dir), [{"$match": {"operationType": "insert"}}]).select("event_id", "operation")


@query(CHG + "SELECT event_id, operation FROM chg WHERE operation IN ('insert', 'update')")
def q_match_in(spark, sf_dir):
    return M.apply(changelog(spark, sf_dir), [{"$match": {"operationType": {"$in": ["insert", "update"]}}}]).select("event_id", "operation")


@query(CHG + "SELECT event_id, full_document FROM chg WHERE CAST(json_extract_string(full_document, '$.k') AS BIGINT) >= 50")
def q_match_payload_gte(spark, sf_dir):
    return M.apply(changelog(spark, sf_dir), [{"$match": {"fullDocument.k": {"$gte": 50}}}]).select("event_id", "full_document")


@query(CHG + "SELECT event_id, operation, full_document FROM chg WHERE operation IN ('insert', 'update') AND CAST(json_extract_string(full_document, '$.k') AS BIGINT) >= 5 AND collection <> 'orders'")
def q_match_multi(spark, sf_dir):
    stages = [{"$match": {"operationType": {"$in": ["insert", "update"]}}}, {"$match": {"fullDocument.k": {"$gte": 5}, "$or": [{"ns.coll": "users"}, {"ns.coll": {"$not": {"$in": ["users", "orders"]}}}]}}]
    return M.apply(changelog(spark, sf_dir), stages).select("event_id", "operation", "full_document")


@query(CHG + "SELECT operation AS list, event_id FROM chg WHERE operation IN ('insert', 'update', 'delete')")
def q_filter_by_operation(spark, sf_dir):
    # One pass for three lists: the operation is the list's name.
    return changelog(spark, sf_dir).where(F.col("operation").isin("insert", "update", "delete")).select(F.col("operation").alias("list"), "event_id")


@query(CHG + "SELECT event_id, collection FROM chg WHERE event_id > 500")
def q_resume_after(spark, sf_dir):
    return S.resume_after(changelog(spark, sf_dir), '{"_data":"token_users_500"}').select("event_id", "collection")


@query(CHG + "SELECT c.event_id, c.collection, c.operation FROM chg c LEFT JOIN (SELECT collection, min(event_id) AS stop FROM chg WHERE operation = 'invalidate' GROUP BY collection) s ON c.collection = s.collection WHERE s.stop IS NULL OR c.event_id < s.stop")
def q_until_invalidate(spark, sf_dir):
    return S.until_invalidate(changelog(spark, sf_dir)).select("event_id", "collection", "operation")


@query(CHG + """, bare AS (SELECT event_id, operation, collection, document_key, CASE WHEN operation <> 'update' THEN full_document END AS full_document FROM chg)
SELECT event_id, document_key, full_document FROM (SELECT *, CASE WHEN operation = 'update' THEN last_value(full_document IGNORE NULLS) OVER (PARTITION BY collection, document_key ORDER BY event_id ROWS UNBOUNDED PRECEDING) ELSE full_document END AS looked FROM bare) AS t(event_id, operation, collection, document_key, was, full_document) WHERE operation = 'update'""")
def q_update_lookup(spark, sf_dir):
    bare = changelog(spark, sf_dir).withColumn("full_document", F.when(F.col("operation") != "update", F.col("full_document")))
    return S.update_lookup(bare, ["collection", "document_key"]).where("operation = 'update'").select("event_id", "document_key", "full_document")


@query(CHG + "SELECT event_id, full_document, lag(full_document) OVER (PARTITION BY collection, document_key ORDER BY event_id) AS full_document_before_change FROM chg WHERE document_key IS NOT NULL")
def q_pre_image(spark, sf_dir):
    keyed = changelog(spark, sf_dir).where("document_key IS NOT NULL")
    return S.pre_image(keyed, ["collection", "document_key"]).select("event_id", "full_document", "full_document_before_change")


@query(CHG + "SELECT event_id, collection FROM chg WHERE collection IN ('users', 'orders', 'products')")
def q_union_workers(spark, sf_dir):
    log = changelog(spark, sf_dir)
    workers = [at_level(log, "collection", "testdb", [c]) for c in ("users", "orders", "products")]
    return reduce(lambda a, b: a.unionByName(b), workers).select("event_id", "collection")
