"""Exact duplicates: grouped by a 128-bit content hash, told apart by their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _body() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, hashed=content_hash, largest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when their bytes are; null counts as empty. The grouping is by
    (hash, text): rows meet by hash and are told apart by their bytes, so that a
    collision gives two groups. Copies fold together before the shuffle, and each
    different text crosses it once. keep_id is the smallest doc_id of a group (the
    largest if so asked); null ids count only where a group has no other. Of rows
    with the same doc_id and text one is kept. Other columns are ignored; an empty
    table gives no rows. The way back to the rows is a join on hashes alone, whose
    hot keys adaptive execution splits.
    """
    base = docs.select(F.col("doc_id").alias("doc_id"), _body().alias("text")).withColumn("h", hashed(F.col("text")))
    best = F.max("doc_id") if largest else F.min("doc_id")
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    groups = base.groupBy("h", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("h", sha, "keep_id", "group_size")
    rows = base.select("doc_id", "h", sha).groupBy("doc_id", "h", "sha").agg(F.count(F.lit(1)).alias("n"))
    met = rows.join(groups, ["h", "sha"]).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, largest: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows equal in doc_id and text the first by its other columns."""
    names = docs.columns
    null_id = F.lit(-(1 << 63))  # joins and windows then share one way of dealing out rows
    verdict = exact_groups(docs, largest=largest).where("kept").select(F.coalesce("doc_id", null_id).alias("__k"), F.col("text_sha256").alias("__s"))
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.coalesce("doc_id", null_id).alias("__k"), F.sha2(_body(), 256).alias("__s"))
    others = [F.col(f"__row.`{c}`").cast("string") for c in names if c not in ("doc_id", "text")] or [F.lit(0)]
    met = mine.join(verdict, ["__k", "__s"], "left_semi").withColumn("__i", F.row_number().over(Window.partitionBy("__k", "__s").orderBy(*others)))
    return met.where("__i = 1").select(*[F.col(f"__row.`{c}`").alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), largest=True)


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
"""
