"""Mixing sources to target weights by minimum-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import scratch

#: A document is taken at most so often.
MOST = 3
#: What the second and third taking of a pattern cost more than the first: convex, so that repeats spread.
TIER_COST = (0, 1, 4)
SEED = 17
#: Rows of the summary that the driver holds at most; more is an error, never a cut.
MAX_PATTERNS = 200_000
#: First hex digits of a document's seeded hash that name its bucket (4,096 of them).
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = MOST, total: int | None = None) -> list[float]:
    """Shares of total (the sum of sizes, if not given) by weight, none above most times its size; the excess goes to the others by weight."""
    total, weight = sum(sizes) if total is None else total, sum(weights)
    level = 0.0
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        level = total / weight
        if level <= most * sizes[i] / weights[i]:
            break
        total, weight = total - most * sizes[i], weight - weights[i]
    return [float(min(most * n, level * w)) for n, w in zip(sizes, weights, strict=True)]


def route(supply: Sequence[int], member: Sequence[Sequence[int]], quota: Sequence[int], tier_cost: Sequence[int] = TIER_COST) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources: a flow of least cost among the largest.

    supply: words of each pattern, which it can give once for each tier; member:
    the sources of each pattern; quota: words that each source asks for. Solved by
    successive shortest paths.
    """
    p, s = len(supply), len(quota)
    start, end = p + s, p + s + 1
    to, room, cost, arcs = [], [], [], [[] for _ in range(p + s + 2)]

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(w)

    for i in range(p):
        for price in tier_cost:
            arc(start, i, supply[i], price)
    first = len(to)
    for i in range(p):
        for j in member[i]:
            arc(i, p + j, supply[i] * len(tier_cost), 0)
    for j in range(s):
        arc(p + j, end, quota[j], 0)
    while True:
        far, came, queue, inside = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            inside.discard(a)
            for k in arcs[a]:
                if room[k] > 0 and far[a] + cost[k] < far.get(to[k], 1 << 60):
                    far[to[k]], came[to[k]] = far[a] + cost[k], k
                    if to[k] not in inside:
                        inside.add(to[k])
                        queue.append(to[k])
        if end not in far:
            break
        path, at = [], end
        while at != start:
            path.append(came[at])
            at = to[came[at] ^ 1]
        push = min(room[k] for k in path)
        for k in path:
            room[k] -= push
            room[k ^ 1] += push
    given: list[dict[int, int]] = [{} for _ in range(p)]
    k = first
    for i in range(p):
        for j in member[i]:
            if room[k ^ 1]:
                given[i][j] = given[i].get(j, 0) + room[k ^ 1]
            k += 2
    return given


def mix(docs: DataFrame, sources: Column, weights: Sequence[int] = (1, 2, 3), size: Column | None = None, seed: int = SEED) -> DataFrame:
    """docs with __size, __pattern (JSON of its sources), __source_size, __target and __taken.

    sources: array of the sources that a document belongs to; the array's order
    and repeats don't matter, null is a source of its own, an empty array belongs
    to none and is never taken. Sources by code point, null last, get the weights
    in turn. Documents are summed up by pattern and seeded bucket; the flow sets
    how many words a pattern gives. Whole rounds take every document; of the rest
    documents are taken in seeded order, and the one at the border in part, so that
    a source's words meet its quota. __source_size and __target are those of the
    first source. The one sort is of the border's bucket, 1/4096 of a pattern.
    Rows with the same doc_id follow each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = docs.columns
    pattern = F.to_json(F.array_sort(F.array_distinct(sources)))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), pattern.alias("__pattern"), (words(F.col("text")) if size is None else size).alias("__size"), key.alias("__key"))
    bucket = F.substring("__key", 1, BUCKET_DIGITS).alias("__bucket")
    summed = scratch.keep(sized.groupBy("__pattern", bucket).agg(F.sum("__size").alias("n")), "mix-sums")

    totals = summed.groupBy("__pattern").agg(F.sum("n").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    import json

    totals.sort(key=lambda r: r["__pattern"])
    of = [json.loads(r["__pattern"]) for r in totals]
    known = sorted({x for p in of for x in p if x is not None}) + [None] * any(None in p for p in of)
    place = {x: j for j, x in enumerate(known)}
    member, supply = [[place[x] for x in p] for p in of], [r["n"] for r in totals]
    source_size = [0] * len(known)
    for m, n in zip(member, supply, strict=True):
        for j in m:
            source_size[j] += n
    weight = [weights[j % len(weights)] for j in range(len(known))]
    # Sizes of overlapping sources count shared documents once in what is shared out.
    asked = targets(source_size, weight, total=sum(supply))
    quota = [int(t + 0.5) for t in asked]
    given = [sum(g.values()) for g in route(supply, member, quota)]
    plan = [(r["__pattern"], g // n if n else 0, g % n if n else 0, source_size[m[0]] if m else 0, asked[m[0]] if m else 0.0) for r, g, n, m in zip(totals, given, supply, member, strict=True)]
    plans = spark.createDataFrame(plan, "__pattern string, __full long, __rest long, __source_size long, __target double")

    running = Window.partitionBy("__pattern").orderBy("__bucket")
    reached = summed.join(F.broadcast(plans.select("__pattern", "__rest")), "__pattern").withColumn("upto", F.sum("n").over(running))
    border = reached.where((F.col("__rest") > 0) & (F.col("upto") >= F.col("__rest")) & (F.col("upto") - F.col("n") < F.col("__rest")))
    border = border.select("__pattern", F.col("__bucket").alias("__edge"), (F.col("upto") - F.col("n")).alias("__before"))
    whole = plans.join(border, "__pattern", "left")  # one row for each pattern

    met = sized.withColumn("__bucket", bucket).join(F.broadcast(scratch.keep(whole, "mix-plan")), "__pattern")
    base = F.col("__full") * F.col("__size")
    clear = met.where("__edge IS NULL OR __bucket <> __edge").withColumn("__taken", base + F.when(F.col("__bucket") < F.col("__edge"), F.col("__size")).otherwise(0))
    ordered = Window.partitionBy("__pattern").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__size").over(ordered), F.lit(0))
    edge = met.where("__bucket = __edge").withColumn("__taken", base + F.greatest(F.lit(0), F.least("__size", left)))
    out = ["__pattern", "__size", "__source_size", "__target", "__taken"]
    return clear.select("__row", *out).unionByName(edge.select("__row", *out))


def repeat(docs: DataFrame, sources: Column, **how) -> DataFrame:
    """The mix as documents: each row of docs as often as it is taken, the one at a border when at least half of it is."""
    mixed = mix(docs, sources, **how)
    times = F.when(F.col("__size") > 0, F.floor((2 * F.col("__taken") + F.col("__size")) / (2 * F.col("__size")))).otherwise(0).cast("int")
    rows = mixed.withColumn("__times", times).where("__times > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), "__times"))).select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix(docs, F.array("source"))
    return mixed.select(F.col("__row.doc_id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST({MOST} * source_size AS DOUBLE) / CAST(w AS DOUBLE) AS ratio, row_number() OVER (ORDER BY CAST({MOST} * source_size AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST) AS pos
  FROM s),
l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum({MOST} * source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
          / CAST((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lam
  FROM r),
t AS (
  SELECT source, source_size,
         least(CAST({MOST} * source_size AS DOUBLE), (SELECT lam FROM l WHERE lam <= ratio ORDER BY pos LIMIT 1) * w) AS target
  FROM s),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS rounds,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest
  FROM t),
o AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.rounds, q.rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o
"""
