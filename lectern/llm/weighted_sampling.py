"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

For a term with weight w and for each of SAMPLES draws, r and c come from
Gamma(2, 1) and b from the unit interval, all from a hash of term and draw alone.
With t = floor(ln w / r + b) and ln y = r (t - b), the draw keeps the term with the
least ln c - ln y - r, together with t. Two documents keep the same (term, t) with a
chance equal to their generalised Jaccard similarity, the sum of smaller weights over
the sum of larger ones. Terms are words, and a term's weight is how often it comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import scratch

SAMPLES = 32
#: Ranges of doc_id within which neighbours are looked up; their bounds are all that the driver sees.
RANGES = 256
_NULL_ID = -(1 << 63)
_SPACE = r"[\x20\x09-\x0D]+"


def runs(text: Column) -> Column:
    """The words of a text in order, each once, repeated as often as it comes: "b a b" gives "a ", "b b "."""
    joined = F.concat(F.array_join(F.sort_array(F.split(text, _SPACE)), " "), F.lit(" "))
    return F.regexp_extract_all(joined, F.lit(r"(\S+ )\1*"), F.lit(0))


def _draw(h: Column, log_weight: Column, d: int) -> Column:
    """Rank of a term in draw d in the upper half of a long, what the draw would keep in the lower."""
    a, b = F.xxhash64(h, F.lit(2 * d)), F.xxhash64(h, F.lit(2 * d + 1))
    part = lambda x, shift, bits: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))
    r = -F.log(part(a, 0, 21) * part(a, 21, 21))
    beta = part(a, 42, 22)
    c = -F.log(part(b, 0, 32) * part(b, 32, 32))
    t = F.floor(log_weight / r + beta)
    rank = F.log(c) - r * (t - beta) - r
    place = F.greatest(F.lit(0).cast("long"), F.floor((rank + F.lit(100.0)) * F.lit(float(1 << 24))))
    kept = h.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(place, 32).bitwiseOR(kept)


def _fingerprint(prefix: str, samples: int) -> Column:
    """Eight hex digits for each draw; dashes where a text has no words."""
    one = lambda i: F.coalesce(F.lower(F.lpad(F.hex(F.col(f"{prefix}{i}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("--------"))
    return F.concat(*[one(i) for i in range(samples)])


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of draws in which two fingerprints agree."""
    same = [(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("int") for i in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def signatures(texts: DataFrame, keys: list[str], sides: dict[str, Column], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each name in sides, the fingerprint of that text; keys tell the rows of texts apart.

    Words are sorted and run together inside their row, so that counting needs no
    shuffle; the minimum over a document's terms is the one aggregate, and stays in
    place where the rows are already dealt by one of the keys.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), c.alias("text")) for n, c in sides.items()]))
    terms = texts.select(*keys, each.alias("__t")).select(*keys, "__t.side", F.explode_outer(runs(F.col("__t.text"))).alias("run"))
    word = F.substring_index("run", " ", 1)
    weighed = terms.select(*keys, "side", F.when(F.col("run").isNotNull(), F.xxhash64(word)).alias("h"), F.log(F.octet_length("run") / (F.octet_length(word) + 1)).alias("lw"))
    drawn = weighed.groupBy(*keys, "side").agg(*[F.min(_draw(F.col("h"), F.col("lw"), d)).alias(f"d{d}") for d in range(samples)])
    marked = drawn.select(*keys, "side", _fingerprint("d", samples).alias("f"))
    return marked.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == n, F.col("f"))).alias(n) for n in sides])


def followers(keys: DataFrame) -> DataFrame:
    """k and next: for each different k the next one in descending order, for the last the first.

    Bounds of RANGES parts come from approximate quantiles; inside a part a window
    finds the next, and between parts a table of one row for each part.
    """
    own = keys.select("k").distinct()
    cuts = own.agg(F.percentile_approx("k", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda b: b <= F.col("k"))) if cuts else F.lit(0)
    dealt = own.withColumn("part", part)
    heads = dealt.groupBy("part").agg(F.max("k").alias("head"))
    down = Window.orderBy(F.desc("part"))
    heads = heads.select("part", F.coalesce(F.lead("head").over(down), F.max("head").over(Window.partitionBy())).alias("head"))
    inside = F.lead("k").over(Window.partitionBy("part").orderBy(F.desc("k")))
    return dealt.withColumn("__n", inside).join(F.broadcast(heads), "part").select("k", F.coalesce("__n", "head").alias("next"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The contract's row for each row of docs (doc_id, text; other columns are ignored).

    Null text is empty; texts without words agree with each other alone. A null
    doc_id is the smallest. Rows that share a doc_id have the same next document;
    where the next doc_id has several rows, the one whose beginning is smallest
    (for the edited text) or whose fingerprint is smallest (for near_next) stands
    for them. An empty table gives no rows.
    """
    base = docs.select(F.coalesce(F.col("doc_id"), F.lit(_NULL_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    next_of = scratch.keep(followers(base), "cws-next")
    half = base.groupBy("k").agg(F.floor(F.max(F.length("text")) / 2).cast("int").alias("half"))
    asked = next_of.join(half, "k").select(F.col("next").alias("__d"), F.col("k").alias("__p"), "half")
    lent = base.join(asked, base["k"] == asked["__d"]).select("__p", F.expr("substring(text, 1, half)").alias("lent"))
    lent = lent.groupBy("__p").agg(F.min("lent").alias("lent"))
    n, cut = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.expr("concat(substring(text, 1, n_chars - cut), substring(lent, 1, cut))")
    both = base.join(lent, base["k"] == lent["__p"], "left").select("k", "text", F.coalesce("lent", F.lit("")).alias("lent"), n.cast("int").alias("n_chars"), cut.alias("cut"))
    both = both.select("k", F.monotonically_increasing_id().alias("uid"), "n_chars", "text", edited.alias("edited")).withColumn("sha", F.unhex(F.sha2("edited", 256)))
    made = signatures(both, ["k", "uid", "n_chars", "sha"], {"fingerprint": F.col("text"), "edited_fingerprint": F.col("edited")}, samples)
    table = scratch.keep(made.drop("uid"), "cws")
    others = table.groupBy("k").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("k", "next")
    met = table.join(next_of.join(others, "next"), "k", "left")
    return met.select(
        F.when(F.col("k") != _NULL_ID, F.col("k")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "next_fingerprint", samples).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
