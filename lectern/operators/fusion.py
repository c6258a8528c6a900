"""Ranked lists: fusion, removal of copies, diversity, neighbours, parents and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

RRF_K = 60


def fuse(hits: DataFrame, query: str, key: str, digits: int = 9) -> DataFrame:
    """query, key, score, first of hits (query, list_ix, rank, weight, key).

    Each occurrence adds weight / (60 + rank), also when a list names a key twice.
    first orders ties by first insertion: lists in turn, ranks inside them.
    """
    seat = F.col("list_ix") * 1_000_000 + F.col("rank")
    return hits.groupBy(query, key).agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), digits).alias("score"), F.min(seat).cast("long").alias("first"))


def rank_fused(fused: DataFrame, query: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("score"), "first", key)
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def merge_copies(rows: DataFrame, group: list[str], ordinal: str, lowest: list[str] = (), highest: list[str] = (), first: list[str] = ()) -> DataFrame:
    """One row for each group: ranks and distances take their minimum, other scores their maximum, the rest the first value by ordinal."""
    return rows.groupBy(*group).agg(F.min(ordinal).alias(ordinal), *[F.min(c).alias(c) for c in lowest], *[F.max(c).alias(c) for c in highest], *[F.min_by(c, ordinal).alias(c) for c in first])


def text_key(text: Column) -> Column:
    """Copies are texts with the same lexical tokens; all texts without any are one."""
    return F.array_join(T.lexical_tokens(text), " ")


def diverse(rows: DataFrame, query: str, parent: str, kind: str, rank: str) -> DataFrame:
    """At most two rows of each parent: the first, and the first of another kind or else the second. Rows without a parent stay."""
    w = Window.partitionBy(query, parent).orderBy(rank)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.withColumn("__i", F.row_number().over(w)).withColumn("__first", F.first(kind).over(whole))
    other = F.min(F.when(F.col(kind) != F.col("__first"), F.col("__i"))).over(Window.partitionBy(query, parent))
    chosen = seen.withColumn("__second", F.coalesce(other, F.lit(2)))
    return chosen.where((F.coalesce(F.col(parent).cast("string"), F.lit("")) == "") | (F.col("__i") == 1) | (F.col("__i") == F.col("__second"))).drop("__i", "__first", "__second")


def interleave(rows: DataFrame, query: str, part: str, key: str, rank: str, k: int) -> DataFrame:
    """Round robin over a query's parts by depth, the first place of a key counting; the first k."""
    deep = rows.withColumn("depth", F.row_number().over(Window.partitionBy(query, part).orderBy(rank, key)))
    seat = F.struct("depth", part)
    once = deep.groupBy(query, key).agg(F.min(seat).alias("seat"), F.array_sort(F.collect_set(part)).alias("parts"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("seat.depth", f"seat.{part}", key))
    return once.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def neighbours(hits: DataFrame, chunks: DataFrame, query: str, parent: str, index: str) -> DataFrame:
    """hits and the chunks just before and after each, with the hit's score and their relation; a chunk named twice keeps its best."""
    seeds = hits.select(query, parent, index, "score")
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(n).alias("relation")) for s, n in ((0, "seed"), (-1, "previous"), (1, "next"))])).alias("x")
    wanted = seeds.select("*", steps).select(query, parent, (F.col(index) + F.col("x.step")).alias(index), "score", "x.relation")
    met = wanted.join(chunks.select(parent, index).distinct(), [parent, index])
    return met.groupBy(query, parent, index).agg(F.max("score").alias("score"), F.max(F.when(F.col("relation") == "seed", 1).otherwise(0)).alias("is_seed"))


def parents(hits: DataFrame, query: str, parent: str) -> DataFrame:
    """One row for each parent of a query's hits: its best rank and score, and how many hits led to it."""
    return hits.groupBy(query, parent).agg(F.min("rank").alias("best_rank"), F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_hits"))
