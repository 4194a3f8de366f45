"""A corpus pipeline over ``documents``: five stages, each one operator.

Every stage takes all rows its predecessor kept, and all but the last return the
columns of ``documents``.  Nulls in any column pass; a null or empty text is kept
by every stage but the last, which takes only documents with words.  The join
stage tells rows apart by doc_id and text; of rows alike in both one stays, and a
row without a doc_id stays only if none of its group has one.  Further columns of the input are carried along, whatever their names; only where
the last stage has a result of that name, the result stands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.llm import decontaminate, mixing, ngram_join, secret_scan, tokens, toxicity
from changelake.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    tokens.small_batches(spark)
    return toxicity.clean(docs, toxicity.fit_documents(spark, docs, sf_dir), "toxic")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one with the smallest doc_id stays.

    Documents go by a name made of doc_id, in its order, and the text's digest; so
    rows that share a doc_id are judged by their own texts.  Rows alike in both are
    copies, of which the first in the order of their other columns stays.
    """
    tokens.small_batches(spark)
    name = tokens.free_name(docs.columns, "__name")
    # The sign bit turned makes hexadecimal digits sort like the numbers; no doc_id sorts last.
    key = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    named = docs.withColumn(name, F.concat(F.coalesce(key, F.lit("~")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))))
    scratch = Scratch(spark)
    groups = ngram_join.join(named.select(name, "text"), name).where("n_shingles > 0")
    # A row for each name that goes, or that several rows have: those rows are counted here, without their texts.
    marks = scratch.save(groups.groupBy(name).agg(F.min("component_id").alias("stays"), F.count(F.lit(1)).alias("rows")).select(name, (F.col(name) == F.col("stays")).alias("stays"), "rows").where("NOT stays OR rows > 1"))
    # Most rows are ruled out by a table of places that marked names hash to (at most 4 MB), and are not shuffled.
    slots = min(1 << 22, max(1 << 12, 1 << int(4 * marks.count()).bit_length()))
    place = F.pmod(F.xxhash64(name), F.lit(slots)).cast("int")
    table = np.unpackbits(ngram_join._bloom(marks.select(place.alias("place")), slots).view(np.uint8), bitorder="little").tobytes()
    marked = F.substring(F.lit(table), place + 1, F.lit(1)) == F.lit(b"\x01")
    kept = named.where(~marked).unionByName(named.where(marked).join(marks.select(name), name, "left_anti")).select(*docs.columns)
    again = marks.where("stays").select(name)
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    firsts = named.where(marked).join(again, name, "left_semi").groupBy(name).agg(F.min_by(row, F.to_json(row)).alias("first")).select("first.*")
    return kept.unionByName(firsts)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    tokens.small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts; n_chars follows."""
    tokens.small_batches(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with words taken and training position, in training order."""
    return mixing.mix(docs, keep=docs.columns).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]
#: A trained classifier and a random field can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        new = scratch.save(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        docs = last = new
    return STAGES[-1][1](spark, docs, sf_dir)
