"""Request logs as streams: rate sessions, single use, first owners, memory of conversations.

Each function takes a DataFrame that may be a stream or a table and gives the same
rows for both; state is kept by Spark, bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "60 seconds"
LATE = "10 minutes"


def stamped(events: DataFrame) -> DataFrame:
    """ts as a timestamp with a zone, which watermarks ask for, and the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def rate_sessions(events: DataFrame, key: str = "user_id", gap: str = GAP) -> DataFrame:
    """key, begin, n, total: a counter goes on while requests come within gap of each other, and then starts anew."""
    return stamped(events).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("begin"), "n", "total")


def single_use(requests: DataFrame, key: str) -> DataFrame:
    """The first of the requests with one key, within the watermark."""
    rows = stamped(requests)
    return rows.dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def first_owner(claims: DataFrame, thread: str, owner: str, ttl_seconds: int) -> DataFrame:
    """thread, owner, granted for every claim of a stream, in order of time.

    The first owner keeps a thread while that owner claims it again within the time
    to live; others are refused until it has run out.
    """
    names = [thread, owner, "granted"]

    def grant(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        holder, until = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for r in rows.itertuples():
            at = r.ts.timestamp()
            if holder is None or at >= until or r.owner == holder:
                holder, until, ok = r.owner, at + ttl_seconds, True
            else:
                ok = False
            out.append((key[0], r.owner, ok))
        state.update((holder, until))
        yield pd.DataFrame(out, columns=names)

    kinds = dict(claims.dtypes)
    rows = claims.select(thread, F.col(owner).alias("owner"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy(thread).applyInPandasWithState(grant, f"{thread} {kinds[thread]}, {owner} {kinds[owner]}, granted boolean", f"owner {kinds[owner]}, until double", "append", "NoTimeout")


def memory(turns: DataFrame) -> DataFrame:
    """conv_id and how many turns and characters a conversation holds so far."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
