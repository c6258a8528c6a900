"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import scratch


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links every neighbour (those above a node, or those below and the node itself) to the least of its neighbourhood."""
    if larger:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def label(links: DataFrame) -> DataFrame:
    """a, b long (any direction, repeats and loops allowed) -> node, label: the least node of its component.

    Alternates the two star operations until nothing changes; the number of rounds
    follows the logarithm of the number of nodes. Only two numbers a round reach
    the driver. Every round is a table in the shared folder.
    """
    pairs = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        pairs = scratch.keep(_stars(_stars(pairs, True), False), "stars")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
