"""Queries that write with a sink and read back, and reads of a written tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelake import schema
from changelake.functions import keys as K
from changelake.plans.batches import batched
from changelake.plans.changelog import CHG, changelog, workspace
from changelake.plans.events import COMPACT_SQL, FLAT_SQL
from changelake.plans.registry import query
from changelake.sinks import files


def _back(df):
    return df.select(*schema.FLAT7).withColumn("cluster_time", F.col("cluster_time").cast("timestamp_ntz"))


def _written(spark, sf_dir, fmt, **options):
    path = workspace(spark)
    files.write(changelog(spark, sf_dir), path, fmt, time=F.col("cluster_time"), **options)
    return path


@query(CHG + COMPACT_SQL)
def q_sink_json(spark, sf_dir):
    return _back(files.read(spark, _written(spark, sf_dir, "json", layout="date", compression="gzip"), "json"))


@query(CHG + FLAT_SQL)
def q_sink_csv(spark, sf_dir):
    return _back(files.read(spark, _written(spark, sf_dir, "csv", layout="date", compression="gzip"), "csv"))


@query(CHG + FLAT_SQL)
def q_sink_parquet(spark, sf_dir):
    return _back(files.read(spark, _written(spark, sf_dir, "parquet", layout="date", compression="zstd"), "parquet"))


@query(CHG + FLAT_SQL)
def q_sink_avro(spark, sf_dir):
    keys = ["collection", "tick", "chunk"]
    name = K.object_key("hive", "data", "collection", F.timestamp_micros(F.col("tick") * 86_400_000_000), "avro")
    return _back(files.from_text(files.decoded_avro(files.objects(batched(spark, sf_dir), keys, name))))


def _messy(spark, sf_dir, fmt, **options):
    """Documents spread over lines, with quotes and commas in a text, and spaces at the end."""
    path = workspace(spark)
    document = F.concat(F.lit('{\n  "k": '), F.get_json_object("full_document", "$.k"), F.lit(',\r\n  "note": "a, \\"b\\" c"\n} '))
    files.write(changelog(spark, sf_dir).withColumn("full_document", document), path, fmt, time=F.col("cluster_time"), **options)
    return _back(files.read(spark, path, fmt))


@query(CHG + """SELECT operation, database, collection, cluster_time, document_key, '{"k":' || json_extract_string(full_document, '$.k') || ',"note":"a, \\"b\\" c"}' AS full_document, resume_token FROM chg""")
def q_sink_json_over_lines(spark, sf_dir):
    return _messy(spark, sf_dir, "json", layout="date", compression="gzip")


@query(CHG + """SELECT operation, database, collection, cluster_time, document_key, '{' || chr(10) || '  "k": ' || json_extract_string(full_document, '$.k') || ',' || chr(13) || chr(10) || '  "note": "a, \\"b\\" c"' || chr(10) || '} ' AS full_document, resume_token FROM chg""")
def q_sink_csv_over_lines(spark, sf_dir):
    return _messy(spark, sf_dir, "csv", layout="collection")


@query(CHG + "SELECT operation, collection, resume_token FROM chg WHERE collection = 'users' AND strftime(cluster_time, '%Y-%m-%d') = '2024-01-02'")
def q_partition_pruned(spark, sf_dir):
    tree = files.read(spark, _written(spark, sf_dir, "parquet", layout="date"), "parquet")
    return tree.where("collection = 'users' AND year = 2024 AND month = 1 AND day = 2").select("operation", "collection", "resume_token")


@query(CHG + "SELECT operation, collection, resume_token FROM chg WHERE operation = 'insert' AND collection = 'users'")
def q_scan_pushdown(spark, sf_dir):
    tree = files.read(spark, _written(spark, sf_dir, "parquet", layout="collection"), "parquet")
    return tree.where("operation = 'insert' AND collection = 'users'").select("operation", "collection", "resume_token")


@query(CHG + "SELECT collection, resume_token FROM chg WHERE cluster_time > TIMESTAMP '2024-01-10 00:00:00'")
def q_time_range(spark, sf_dir):
    tree = files.read(spark, _written(spark, sf_dir, "parquet", layout="collection"), "parquet")
    return tree.where("cluster_time > TIMESTAMP '2024-01-10 00:00:00'").select("collection", "resume_token")
