"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Every stage takes all that its predecessor kept and returns the columns of the documents; the last one
adds the ids of the text. Near duplicates are groups of documents whose fingerprints link, by the SimHash operator
with its own shingle length and distance; the row with the least id of each group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.llm import decontaminate, language, pieces, pii, simhash
from flowguard.llm.common import materialize, spare, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages; the declared language and the source are evidence too."""
    into = spare(docs, "found")
    found = language.identify(docs, into, language.fit(docs), "text", "lang", F.col("source").cast("string"))
    return found.where(F.col(into).lang != language.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id (null ids last).

    Rows are told apart by a number of their own, as ids may be null or repeat.
    """
    number, key = spare(docs, "row_number"), spare(docs, "row_key")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(number).alias("row"))
    found = simhash.groups(rows.select(order.alias(key), "text"), key)
    kept = found.where(F.col("doc_id")["row"] == F.col("component_id")["row"]).select(F.col("doc_id")["row"].alias(number))
    return rows.join(kept, number, "left_semi").select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate."""
    into = spare(docs, "found")
    found = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), into)
    return found.where(~F.col(into).contaminated).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows the text."""
    into = spare(docs, "found")
    found = pii.mark(docs, pii.fit(docs), into)
    text = pii.redacted(F.col("text"), F.col(into)["spans"])
    changed = F.size(F.col(into)["spans"]) > 0
    rows = found.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their text, which decode to it."""
    into = spare(docs, "coded")
    coded = pieces.encode(docs, into)
    c = F.col(into)
    return coded.select(*docs.columns, c.ids.alias("ids"), F.size(c.ids).cast("long").alias("n_tokens"), c.round_trip.alias("round_trip"))


STAGES = [
    ("language", languages),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark_free),
    ("pii", private),
    ("tokens", tokens),
]

#: The language model, the fingerprints, the trees and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
