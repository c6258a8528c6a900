"""Queries of answers: bonuses, figures, routes, excerpts, extractive answers, diagrams, caches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import fusion
from lectern.plans import sql as S
from lectern.plans.search_queries import _BM25, _TOP12, _search, _top12
from lectern.plans.text_queries import literal, values
from lectern.registry import query, table

ENTITIES = ("license", "token", "idiot", "apache")


_BONUS = " + ".join(f"CASE WHEN contains(lower(text || ' ' || source), '{e}') THEN 0.0003 ELSE 0 END" for e in ENTITIES)


@query(f"SELECT doc_id, CAST(least(0.0009, {_BONUS}) + CASE WHEN contains(lower(source), 'src1') THEN 0.0004 ELSE 0 END AS DOUBLE) AS bonus FROM documents")
def ranking_bonus(spark, d):
    """What named entities and a preferred source add to a fused score."""
    text = F.lower(F.concat("text", F.lit(" "), "source"))
    hits = sum((F.when(F.contains(text, F.lit(e)), F.expr("0.0003BD")).otherwise(F.expr("0.0000BD")) for e in ENTITIES[1:]), F.when(F.contains(text, F.lit(ENTITIES[0])), F.expr("0.0003BD")).otherwise(F.expr("0.0000BD")))
    liked = F.when(F.contains(F.lower("source"), F.lit("src1")), F.expr("0.0004BD")).otherwise(F.expr("0.0000BD"))
    return table(spark, d, "documents").select("doc_id", (F.least(F.expr("0.0009BD"), hits) + liked).cast("double").alias("bonus"))


@query(f"""WITH {_BM25},
v AS (SELECT item_id // 2 AS request, item_id % 2 AS ix, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 18),
f AS (SELECT request, doc_id, round(sum(CASE WHEN ix = 0 THEN 1.15 ELSE 1.0 END / (60 + rank)), 9) AS score, min(ix * 1000000 + rank) AS first FROM v GROUP BY request, doc_id)
SELECT request, doc_id, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, first, doc_id) AS rank FROM f QUALIFY rank <= 18""")
def multi_query_fusion(spark, d):
    """Two passages as one request's question and its variation: the question's list weighs 1.15."""
    lists = _search(spark, d, 18)
    ix = F.col("item_id") % 2
    hits = lists.select(F.floor(F.col("item_id") / 2).cast("long").alias("request"), "doc_id", "rank", ix.alias("list_ix"), F.when(ix == 0, 1.15).otherwise(1.0).alias("weight"))
    return fusion.rank_fused(fusion.fuse(hits, "request", "doc_id"), "request", "doc_id", 18).select("request", "doc_id", "score", "rank")


FIGURES = [(1, "a.pdf", 1, 100), (2, "a.pdf", 1, 3_000_000), (3, "a.pdf", 2, 500), (4, "b.pdf", 1, 70), (5, "../etc", 1, 10), (6, "a.pdf", 1, 90), (7, "a.pdf", 1, 80), (8, "a.pdf", 1, 60)]
CITED = [(1, "a.pdf", 1), (1, "../etc", 1), (2, "b.pdf", 1), (3, "c.pdf", 1)]


@query(f"""SELECT answer, figure FROM {values(CITED, 'answer, cited_file, cited_page')} JOIN {values(FIGURES, 'figure, file, page, size').replace('AS t(', 'AS t2(')} ON cited_file = file AND cited_page = page
WHERE size <= 2000000 AND NOT contains(file, '..') QUALIFY row_number() OVER (PARTITION BY answer ORDER BY figure) <= 3""")
def figure_lookup(spark, d):
    """Figures of the pages that an answer cites: three at most, none above 2 MB, none outside the folder."""
    figures = literal(spark, "figure long, file string, page long, size long", FIGURES).where((F.col("size") <= 2_000_000) & ~F.contains("file", F.lit("..")))
    met = literal(spark, "answer long, file string, page long", CITED).join(figures, ["file", "page"])
    return met.withColumn("i", F.row_number().over(Window.partitionBy("answer").orderBy("figure"))).where("i <= 3").select("answer", "figure")


CAPTIONS = [(1, 10.0, "Figure 1 shows the flow"), (1, 90.0, "Workflow diagram of the cell"), (1, 55.0, "plain text"), (2, 5.0, "An illustration")]
DRAWN = [(1, 1, 80.0), (2, 1, 12.0), (3, 2, 500.0)]


@query(f"""SELECT figure, arg_min(text, gap) AS caption FROM (SELECT figure, text, abs(y - at_y) AS gap FROM {values(DRAWN, 'figure, page, at_y')} JOIN {values(CAPTIONS, 'block_page, y, text').replace('AS t(', 'AS t2(')} ON page = block_page
WHERE regexp_matches(text, '(?i)\\b(?:figure|diagram|illustration|flow[ -]?chart)\\b')) GROUP BY figure""")
def figure_captions(spark, d):
    """The nearest block of a figure's page that speaks of a figure."""
    blocks = literal(spark, "page long, y double, text string", CAPTIONS).where(T.is_match(F.col("text"), r"\b(?:figure|diagram|illustration|flow[ -]?chart)\b"))
    met = literal(spark, "figure long, page long, at_y double", DRAWN).join(blocks, "page")
    return met.groupBy("figure").agg(F.min_by("text", F.abs(F.col("y") - F.col("at_y"))).alias("caption"))


@query("SELECT lang AS release, min(doc_id) AS first_doc, count(*) AS docs, count(*) OVER () > 1 AS several FROM documents GROUP BY lang")
def release_inventory(spark, d):
    """Distinct releases (here languages) with the first source of each, and whether an answer has to warn of several."""
    by = table(spark, d, "documents").groupBy(F.col("lang").alias("release")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs"))
    return by.crossJoin(F.broadcast(by.agg((F.count(F.lit(1)) > 1).alias("several"))))


STATES = [(1, "sufficient", 0, True, True), (2, "retry", 0, False, False), (3, "retry", 1, False, False), (4, "partial", 1, True, False), (5, "out_of_scope", 0, False, False), (6, "in_scope_insufficient", 1, False, True)]
_STATES = "(VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{s}', CAST({r} AS BIGINT), {str(g).lower()}, {str(x).lower()})" for i, s, r, g, x in STATES) + ") AS t(id, status, retries, grounded, diagram)"


@query(f"""SELECT id, CASE WHEN status = 'retry' AND retries < 1 THEN 'broaden' WHEN status IN ('sufficient', 'partial') THEN 'answer' ELSE 'fallback' END AS after_grade,
  CASE WHEN grounded AND diagram THEN 'diagram' ELSE 'end' END AS after_verify FROM {_STATES}""")
def routes(spark, d):
    """Where a request goes after grading and after verification."""
    rows = literal(spark, "id long, status string, retries long, grounded boolean, diagram boolean", STATES)
    grade = F.when((F.col("status") == "retry") & (F.col("retries") < 1), "broaden").when(F.col("status").isin("sufficient", "partial"), "answer").otherwise("fallback")
    return rows.select("id", grade.alias("after_grade"), F.when(F.col("grounded") & F.col("diagram"), "diagram").otherwise("end").alias("after_verify"))


FAILURES = [(1, 429, "rate limit"), (2, 413, "too large"), (3, 500, "oops"), (4, 401, "key"), (5, 400, "context length exceeded"), (6, 400, "bad json"), (7, 404, "no model"), (8, 503, "busy")]


@query(f"""SELECT id, CASE WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 403) THEN 'auth' WHEN status = 413 OR contains(detail, 'context length') THEN 'too_large' WHEN status >= 500 THEN 'server' WHEN status = 404 THEN 'model' ELSE 'request' END AS kind FROM {values(FAILURES, 'id, status, detail')}""")
def error_kinds(spark, d):
    s = F.col("status")
    kind = F.when(s == 429, "rate_limit").when(s.isin(401, 403), "auth").when((s == 413) | F.contains("detail", F.lit("context length")), "too_large").when(s >= 500, "server").when(s == 404, "model").otherwise("request")
    return literal(spark, "id long, status long, detail string", FAILURES).select("id", kind.alias("kind"))


@query(f"""{_TOP12} SELECT item_id, string_agg('S' || CAST(rank AS VARCHAR) || ': ' || source || ' ' || CAST(doc_id AS VARCHAR), '; ' ORDER BY rank) AS sources, max(lead) AS answer FROM (
  SELECT b.item_id, b.doc_id, rank, source, CASE WHEN rank = 1 THEN s[1] || ' [S1]' END AS lead FROM b JOIN (SELECT doc_id, source, {S.sentences('text')} AS s FROM documents) USING (doc_id) WHERE rank <= 3) GROUP BY item_id""")
def extractive_answer(spark, d):
    """The first sentence of the best document with its citation, and the sources: the default where no model is at hand."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.get(T.sentences(F.col("text")), F.lit(0)).alias("lead"))
    rows = _top12(spark, d).where("rank <= 3").select("item_id", "doc_id", "rank").join(docs, "doc_id")
    line = F.concat(F.lit("S"), F.col("rank").cast("string"), F.lit(": "), "source", F.lit(" "), F.col("doc_id").cast("string"))
    sources = F.array_join(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))["line"], "; ")
    return rows.groupBy("item_id").agg(sources.alias("sources"), F.max(F.when(F.col("rank") == 1, F.concat("lead", F.lit(" [S1]")))).alias("answer"))


@query(f"""{_TOP12}, s AS (SELECT item_id // 4 AS request, item_id, source AS manual, doc_id, rank FROM b JOIN documents USING (doc_id)),
p AS (SELECT *, CASE WHEN rank = 1 THEN 0 WHEN row_number() OVER (PARTITION BY request, manual ORDER BY rank, item_id, doc_id) = 1 THEN 1 ELSE 2 END AS class FROM s),
u AS (SELECT request, doc_id, min(class * 1000000 + rank * 10000 + item_id) AS seat FROM p GROUP BY request, doc_id)
SELECT request, doc_id, row_number() OVER (PARTITION BY request ORDER BY seat, doc_id) AS place FROM u QUALIFY place <= 8""")
def answer_sources(spark, d):
    """Eight sources of a request: the best of each aspect, then one of each manual, then the rest by rank."""
    rows = _top12(spark, d).select("item_id", "doc_id", "rank").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("manual")), "doc_id").withColumn("request", F.floor(F.col("item_id") / 4).cast("long"))
    first = F.row_number().over(Window.partitionBy("request", "manual").orderBy("rank", "item_id", "doc_id")) == 1
    seat = F.when(F.col("rank") == 1, 0).when(first, 1).otherwise(2) * 1_000_000 + F.col("rank") * 10_000 + F.col("item_id")
    once = rows.withColumn("seat", seat).groupBy("request", "doc_id").agg(F.min("seat").alias("seat"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("seat", "doc_id")).cast("long")).where("place <= 8").select("request", "doc_id", "place")


@query("SELECT source, count(DISTINCT lang) AS families, bool_or(lang = 'en') AS has_en, bool_or(lang = 'de') AS has_de FROM documents GROUP BY source")
def manual_coverage(spark, d):
    """Which families (here languages) a source's documents cover."""
    seen = F.collect_set("lang")
    by = table(spark, d, "documents").groupBy("source").agg(seen.alias("s"))
    return by.select("source", F.size("s").cast("long").alias("families"), F.array_contains("s", "en").alias("has_en"), F.array_contains("s", "de").alias("has_de"))


@query("""SELECT user_id, event_type, count(*) AS asked, count(*) FILTER (WHERE hit) AS hits FROM (
  SELECT user_id, event_type, coalesce(ts < lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 3600 SECOND, false) AS hit FROM events) GROUP BY user_id, event_type""")
def cache_hits(spark, d):
    """How many requests find what the one before them put into a cache whose entries live for an hour after each use."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hit = F.coalesce(F.col("ts") < F.lag("ts").over(w) + F.expr("INTERVAL 3600 SECONDS"), F.lit(False))
    return table(spark, d, "events").select("user_id", "event_type", hit.alias("hit")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("asked"), F.count_if("hit").alias("hits"))


@query("""SELECT minute, n, least(n, 4) AS running, least(greatest(n - 4, 0), 32) AS waiting, greatest(n - 36, 0) AS rejected FROM (SELECT date_trunc('hour', ts) AS minute, count(*) AS n FROM events GROUP BY 1)""")
def gate_admission(spark, d):
    """Of the requests of an hour taken as one burst: four run, thirty-two wait, the rest is turned away."""
    n = table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    four, room = F.lit(4).cast("long"), F.lit(32).cast("long")
    return n.select("minute", "n", F.least("n", four).alias("running"), F.least(F.greatest(F.col("n") - 4, F.lit(0).cast("long")), room).alias("waiting"), F.greatest(F.col("n") - 36, F.lit(0).cast("long")).alias("rejected"))


SPANS = [(1, "The role group and the role of a user group member"), (2, "user group"), (3, "nothing"), (4, "group role role group")]
PHRASES = ["role", "group", "role group", "user group", "user group member"]


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'role group, role, user group member'), (2, 'user group'), (3, ''), (4, 'group, role, role group')) AS t(id, matched)")
def alias_longest(spark, d):
    """Phrases of a catalogue in a text, longer ones first, none inside another, in the text's order."""
    ordered = sorted(PHRASES, key=lambda p: (-len(p), p))
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, ordered)) + r")\b", re.I)

    @F.pandas_udf("string")
    def longest(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            taken: list[tuple[int, int]] = []
            for phrase in ordered:
                for m in re.finditer(rf"\b{re.escape(phrase)}\b", text, re.I):
                    if all(m.end() <= a or m.start() >= b for a, b in taken):
                        taken.append(m.span())
            return ", ".join(text[a:b].lower() for a, b in sorted(taken)) if pattern.search(text) else ""

        return texts.map(one)

    return literal(spark, "id long, text string", SPANS).select("id", longest("text").alias("matched"))


GRAPHS = [
    (1, 'digraph G { a [label="A [S1]"]; b [label="B [S2]"]; a -> b; }', True), (2, "digraph G { a; b; a -> b; }", False), (3, 'graph { a [label="A [S1]"]; }', False),
    (4, 'digraph G { a [label="<b>A</b> [S1]"]; b [label="B [S1]"]; a -> b; }', False), (5, 'digraph G { a [label="A [S1]" URL="http://x"]; b [label="B [S1]"]; a -> b; }', False), (6, 'digraph G { a [label="A [S1]"]; }', False),
]
_NODE = r'(\w+)\s*\[label="([^"]*)"'


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), true), (2, false), (3, false), (4, false), (5, false), (6, false)) AS t(id, valid)")
def diagram_validate(spark, d):
    """A graph counts when it nests rightly, has 2 to 20 nodes that each cite, and neither markup nor addresses."""
    dot = F.col("dot")
    labels = F.regexp_extract_all(dot, F.lit(_NODE), F.lit(2))
    cites = F.forall(labels, lambda x: x.rlike(r"\[S\d+\]"))
    shape = dot.rlike(r"^\s*digraph\b") & (F.length(dot) <= 20_000) & T.balanced(dot)
    clean = ~dot.rlike(r"(?i)<[a-z/]|https?:|\bhref\b|\burl\s*=")
    return literal(spark, "id long, dot string, expected boolean", GRAPHS).select("id", (shape & F.size(labels).between(2, 20) & cites & clean).alias("valid"))


STEPS = [(1, "1. Open it [S1]\n2. Step in [S2]\n3. Close it [S1]"), (2, "No steps [S1]"), (3, "1. Alone [S1]")]


@query("""SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'digraph G { n1 [label="Open it [S1]"]; n2 [label="Step in [S2]"]; n3 [label="Close it [S1]"]; n1 -> n2; n2 -> n3; }'), (2, ''), (3, '')) AS t(id, dot)""")
def diagram_from_steps(spark, d):
    """A graph of an answer's cited steps, where there are two at least."""
    steps = F.filter(T.procedure_steps(F.col("answer")), lambda s: s.rlike(r"\[S\d+\]"))
    node = lambda s, i: F.concat(F.lit("n"), (i + 1).cast("string"), F.lit(' [label="'), F.regexp_replace(s, r"^\d{1,3}[.)]\s*", ""), F.lit('"]; '))
    edge = lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit(" -> n"), (i + 1).cast("string"), F.lit("; "))
    drawn = F.concat(F.lit("digraph G { "), F.array_join(F.transform("s", node), ""), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), edge), ""), F.lit("}"))
    return literal(spark, "id long, answer string", STEPS).withColumn("s", steps).select("id", F.when(F.size("s") >= 2, drawn).otherwise("").alias("dot"))


ROWS = [(1, "which rights does a role have", [["Name", "Meaning"], ["Role", "has rights"], ["Spec", "a step"], ["Right", "what a role may do"]]), (2, "unknown words", [["Name", "Meaning"], ["a", "b"]])]


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), '0,2'), (2, '0')) AS t(id, chosen)")
def table_excerpt(spark, d):
    """The rows of a table that share most terms with a question, six at most and in order; else the first."""
    rows = literal(spark, "id long, question string, cells array<array<string>>", ROWS)
    asked = T.compression_terms(F.col("question"))
    data = F.slice("cells", 2, F.size("cells"))
    scored = F.transform(data, lambda r, i: F.struct((-F.size(F.array_intersect(asked, T.compression_terms(F.array_join(r, " "))))).alias("o"), i.alias("i")))
    best = F.slice(F.array_sort(scored), 1, 6)
    hits = F.array_sort(F.transform(F.filter(best, lambda x: x["o"] < 0), lambda x: x["i"]))
    return rows.select("id", F.array_join(F.transform(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.get(best, F.lit(0))["i"])), lambda i: i.cast("string")), ",").alias("chosen"))
