"""Secret scans over a ledger of content-addressed blobs. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import scratch


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts when its group has at least ``least`` characters. ``needs`` matches any text with such a match."""

    kind: str
    version: int
    pattern: str
    needs: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_KEYWORD = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
#: The order of kinds in joined spans. A run of one class of characters may ask for its length in the pattern itself.
RULES = (
    Rule("assign", 1, _ASSIGN % "+", _ASSIGN % "{12,}", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16,}", "[0-9a-f]{16,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\."),
)
BASE = 3

_HIT = "array<struct<k:int,i:int,gap:int,n:int,secret:int>>"
_ENTRY = "blob string, rules array<string>, spans array<struct<start:bigint,k:int,end:bigint,rule:string>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(k: int, rule: Rule, wanted: Column) -> Column:
    """Each match with the length of the gap in front of it; lengths are code points."""
    size = lambda x: F.length(x)
    text = F.col("text")
    gaps = F.transform(F.split(text, rule.pattern, -1), size)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), size)
    secret = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), size) if rule.group else whole
    made = F.transform(F.arrays_zip(gaps.alias("a"), whole.alias("b"), secret.alias("c")), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["a"].alias("gap"), x["b"].alias("n"), x["c"].alias("secret")))
    return F.when(wanted & text.rlike(rule.needs), made).otherwise(F.array().cast(_HIT))


def _seen(spark: SparkSession, ledger: str) -> DataFrame | None:
    try:
        return spark.read.schema(_ENTRY).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger up to date with versions and returns its findings: blob, spans.

    versions: text (null: empty) of every version of every file; other columns are
    ignored. A text's address is its SHA-256. Equal texts fold before the shuffle,
    each blob crosses it once, and a blob is scanned for those rules alone whose
    (blob, rule, version) the ledger lacks. An entry is appended for each blob
    scanned, also when nothing was found. Findings are those of the rules given,
    at their versions, one row for each blob with any. An empty table adds nothing.
    """
    spark = versions.sparkSession
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    past = _seen(spark, ledger)
    if past is None:
        todo = blobs.withColumn("rules", names)
    else:
        known = past.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        todo = blobs.join(known, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("known", F.array().cast("array<string>")))).where("size(rules) > 0")
    hits = F.concat(*[_hits(k, r, F.array_contains("rules", r.name)) for k, r in enumerate(rules)])
    rows = todo.select("blob", "rules", F.explode_outer(hits).alias("h")).select("blob", "rules", "h.*")
    upto = Window.partitionBy("blob", "k").orderBy("i")
    ends = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.coalesce("n", F.lit(0))).over(upto))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("k") + 1)
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "k", "end", F.get(names, F.col("k")).alias("rule"))
    entries = ends.groupBy("blob", "rules").agg(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull() & (F.col("secret") >= least), span))).alias("spans"))
    entries.write.mode("append").parquet(ledger)
    now = spark.read.schema(_ENTRY).parquet(ledger).select("blob", F.filter("spans", lambda s: F.array_contains(names, s["rule"])).alias("spans")).where("size(spans) > 0")
    return now.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: doc_id, n_<kind> of the base kinds, base_sha256, spans, n_spans."""
    found = scan(docs, ledger, rules)
    rows = docs.select(F.col("doc_id").alias("doc_id"), blob_of(F.col("text")).alias("blob"))
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,k:int,end:bigint,rule:string>>"))
    met = rows.join(found, "blob", "left").withColumn("spans", spans)
    base = F.filter("spans", lambda s: s["k"] < BASE)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:BASE])]
    return met.select("doc_id", *counts, F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.place(spark, "blob-ledger"))
