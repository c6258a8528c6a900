"""Queries of planning, evidence, conversations and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans import sql as S
from lectern.plans.search_queries import _top12, _TOP12
from lectern.plans.text_queries import literal, values
from lectern.registry import query, table

# ---------------------------------------------------------------- questions

# Phrases that are answered without looking anything up.
GREETINGS = ("hi", "hii", "hello", "hellow", "hey", "hi there", "hello there", "hey there", "good morning", "good afternoon", "good evening", "good night")
THANKS = ("thanks", "thank you", "thankyou", "thx", "thanks a lot", "many thanks")
FAREWELLS = ("bye", "goodbye", "see you", "see you later", "talk to you later")
STATES = ("how are you", "how are you doing", "how is it going", "how s it going")
HELP = ("help", "please help", "can you help me", "how can you help me", "what can you do", "who are you", "what is your name", "are you a bot", "tell me about yourself", "what should i ask")
ASSENT = ("ok", "okay", "great", "nice", "cool", "got it", "understood")
SORRY = ("sorry", "my mistake", "no problem")
CHAT = {"greeting": GREETINGS, "thanks": THANKS, "farewell": FAREWELLS, "state": STATES, "help": HELP, "assent": ASSENT, "sorry": SORRY}
# Patterns of the question classes, in order.
INTENTS = (("procedure", r"\b(?:how do|how to|procedure|steps?|step-by-step)\b"), ("comparison", r"\b(?:compare|difference|versus|vs\.?\b)"), ("troubleshooting", r"\b(?:cannot|failed?|issue|problem|stuck)\b"))
OUTPUTS = (
    ("likely_reasons", r"\b(?:cannot|can't|fails?|problem|issue|stuck|troubleshoot)\b"), ("checks", r"\b(?:cannot|can't|fails?|problem|issue|stuck|troubleshoot)\b"),
    ("comparison_table", r"\b(?:compare|comparison|difference|distinguish|versus|vs\.? )\b"), ("procedure", r"\b(?:procedure|how do|how to|steps?|step-by-step)\b"),
    ("diagram", r"\b(?:hierarch\w*|process|workflow|architecture|relationship)\b"), ("cross_manual_synthesis", r"\b(?:cross[- ]manual|across manuals)\b"),
)
EXPLICIT = r"\b(?:diagrams?|flow[ -]?charts?|visuali[sz]e|draw|relationship map|tree diagram)\b"
DIAGRAMS = (
    ("decision", r"\bdecision(?:[ -]+flow)?(?:[ -]+diagram|[ -]+flow[ -]?chart)\b"), ("process", r"\b(?:flow[ -]?chart|process(?:[ -]+flow)?[ -]+diagram|process[ -]+flow)\b"),
    ("hierarchy", r"\b(?:hierarch\w*[ -]+diagram|tree[ -]+diagram)\b"), ("relationship", r"\brelationship(?:[ -]+diagram|[ -]+map)\b"), ("architecture", r"\barchitecture[ -]+diagram\b"),
    ("decision", r"\bdecision\b"), ("process", r"\bprocess\b"), ("hierarchy", r"\bhierarchy\b"), ("relationship", r"\brelationship\b"), ("architecture", r"\barchitecture\b"),
)
RELATION = r"\b(?:related|relationships?|hierarch\w*|parent[- ]child|contains?|references?|depends?\s+on|dependencies|associated|connect(?:ed|s|ion)?|architecture)\b"
COMPOUND = r"\b(?:and|or|compare|difference|how|why|across|hierarch\w*|workflow|process|relationship)\b"
UNRELATED = r"\b(?:bake|cake|weather|forecast|poem|ocean|stock price|sports score|football|cricket|movie review|restaurant|vacation|capital of|president of)\b"
WEIGHTS = ((5, r"\bparent[- ]child\b"), (5, r"\bparent resource\b"), (4, r"\bchild resources?\b"), (2, r"\bcontains?\b"), (2, r"\breferences?\b"), (2, r"\bbelongs?\b"), (1, r"\bassigned\b"), (1, r"\boptional\b"), (1, r"\brequired\b"), (1, r"\bfield\b"))

QUESTIONS = [
    (1, "How do I add a role?"), (2, "Compare a role versus a group"), (3, "The move failed, what is the problem?"), (4, "What is a container"), (5, "Draw the process flow diagram of a move"),
    (6, "hello there!"), (7, "Thanks a lot."), (8, "What's the weather forecast"), (9, "Explain the relationship between spec and resource"), (10, "Show a tree diagram of the hierarchy"),
    (11, "OK"), (12, "please help"), (13, "Visualize the decision flowchart"), (14, "Define a field"), (15, "bake a cake with the container"), (16, "See you later"),
]
_Q = values(QUESTIONS, "id, question")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The literal questions, and every user turn of the conversations."""
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.lit(1000) + F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("id"), F.col("text").alias("question"))
    return literal(spark, "id long, question string", QUESTIONS).unionByName(turns)


_QS = f"(SELECT * FROM {_Q} UNION ALL SELECT CAST(1000 + conv_id * 100 + turn AS BIGINT), text FROM conversations WHERE role = 'user')"


def _first(rules, text: Column, default: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(T.is_match(text, pattern), name)
    return out.otherwise(default)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _first_sql(rules, text: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_quoted('(?i)' + p)}) THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


@query(f"SELECT id, {_first_sql(INTENTS, 'question', 'explanation')} AS intent FROM {_QS}")
def intent_classify(spark, d):
    return _questions(spark, d).select("id", _first(INTENTS, F.col("question"), "explanation").alias("intent"))


_OUT = "list_filter([" + ", ".join(["'explanation'", *[f"CASE WHEN regexp_matches(question, {_quoted('(?i)' + p)}) THEN '{n}' END" for n, p in OUTPUTS]]) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT id, array_to_string({_OUT}, ',') AS outputs FROM {_QS}")
def required_output(spark, d):
    made = F.array(F.lit("explanation"), *[F.when(T.is_match(F.col("question"), p), n) for n, p in OUTPUTS])
    return _questions(spark, d).select("id", F.array_join(F.filter(made, lambda x: x.isNotNull()), ",").alias("outputs"))


@query(f"SELECT id, regexp_matches(question, {_quoted('(?i)' + EXPLICIT)}) AS requested, CASE WHEN regexp_matches(question, {_quoted('(?i)' + EXPLICIT)}) THEN {_first_sql(DIAGRAMS, 'question', 'auto')} ELSE 'auto' END AS kind FROM {_QS}")
def diagram_detect(spark, d):
    asked = T.is_match(F.col("question"), EXPLICIT)
    return _questions(spark, d).select("id", asked.alias("requested"), F.when(asked, _first(DIAGRAMS, F.col("question"), "auto")).otherwise("auto").alias("kind"))


_CHATTED = "trim(regexp_replace(regexp_replace(lower(question), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT id, CASE " + " ".join(f"WHEN {_CHATTED} IN {S.names(w)} THEN '{n}'" for n, w in CHAT.items()) + f" ELSE 'question' END AS reply FROM {_QS}")
def basic_chat(spark, d):
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("question"), r"[^a-z0-9\s]", " "), r"\s+", " "))
    out = F.when(F.lit(False), "")
    for name, phrases in CHAT.items():
        out = out.when(key.isin(*phrases), name)
    return _questions(spark, d).select("id", out.otherwise("question").alias("reply"))


@query(f"""SELECT id, len(list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda x: x <> '')) <= 14 AND regexp_matches(trim(question), '(?i)^(?:what is|define|explain)\\b') AND NOT regexp_matches(question, {_quoted('(?i)' + COMPOUND)}) AS simple,
  regexp_matches(question, {_quoted('(?i)' + RELATION)}) AS relationship FROM {_QS}""")
def question_shape(spark, d):
    q = F.col("question")
    words = F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda x: x != ""))
    return _questions(spark, d).select("id", ((words <= 14) & T.is_match(F.trim(q), r"^(?:what is|define|explain)\b") & ~T.is_match(q, COMPOUND)).alias("simple"), T.is_match(q, RELATION).alias("relationship"))


DOMAIN = [("Container", "container"), ("Role", "role"), ("Role", "group"), ("Resource", "resource"), ("Resource", "equipment"), ("Spec", "spec"), ("Move", "move")]
_ASKED = "' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"""SELECT q.id, coalesce(string_agg(DISTINCT canonical, ',' ORDER BY canonical), '') AS concepts, count(canonical) = 0 AND regexp_matches(any_value(q.question), {_quoted('(?i)' + UNRELATED)}) AS out_of_scope
FROM {_QS} q LEFT JOIN {values(DOMAIN, 'canonical, alias')} ON contains({_ASKED}, ' ' || alias || ' ') GROUP BY q.id""")
def domain_scope(spark, d):
    """Concepts that a question names, and whether it names none and is about something else."""
    asked = _questions(spark, d).withColumn("p", F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("question"), "[^a-z0-9]+", " ")), F.lit(" ")))
    named = asked.join(F.broadcast(literal(spark, "canonical string, alias string", DOMAIN)), F.contains("p", F.concat(F.lit(" "), F.col("alias"), F.lit(" "))), "left")
    return named.groupBy("id", "question").agg(F.array_join(F.array_sort(F.collect_set("canonical")), ",").alias("concepts")).select("id", "concepts", ((F.col("concepts") == "") & T.is_match(F.col("question"), UNRELATED)).alias("out_of_scope"))


@query(f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS place, query FROM (
  SELECT id, min(pos) AS pos, arg_min(query, pos) AS query FROM (
    SELECT id, 0 AS pos, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS query FROM {_Q} UNION ALL SELECT id, 1, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) FROM {_Q}
    UNION ALL SELECT id, 2, trim(regexp_replace(question, '\\s+', ' ', 'g')) || ' related sections' FROM {_Q} UNION ALL SELECT id, 3, trim(regexp_replace(question, '\\s+', ' ', 'g')) || ' manual' FROM {_Q})
  GROUP BY id, lower(query)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 4""")
def query_list(spark, d):
    """A question's search queries without repeats in other case, at most four."""
    q = F.trim(F.regexp_replace("question", r"\s+", " "))
    rows = literal(spark, "id long, question string", QUESTIONS).select("id", F.posexplode(F.array(q, F.lower(q), F.concat(q, F.lit(" related sections")), F.concat(q, F.lit(" manual")))).alias("pos", "query"))
    once = rows.groupBy("id", F.lower("query").alias("k")).agg(F.min("pos").alias("pos"), F.min_by("query", "pos").alias("query"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("long")).where("place <= 4").select("id", "place", "query")


# ---------------------------------------------------------------- evidence

_EV = f"""{_TOP12}, e AS (SELECT item_id, doc_id, rank, b2.text AS question, d.text AS body, d.source, d.lang FROM b JOIN documents d USING (doc_id) JOIN benchmark b2 USING (item_id) WHERE rank <= 3)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    best = _top12(spark, d).where("rank <= 3").select("item_id", "doc_id", "rank")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), "source", "lang")
    return best.join(docs, "doc_id").join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")


@query(f"""{_EV}, s AS (SELECT item_id, doc_id, {S.distinct_terms('question', T.COMPRESSION_STOPWORDS)} AS q, {S.sentences('body')} AS s FROM e),
x AS (SELECT item_id, doc_id, i - 1 AS ix, s[i] AS sentence, len(list_intersect(q, {S.distinct_terms('s[i]', T.COMPRESSION_STOPWORDS)})) AS overlap FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY overlap DESC, ix) AS place, count(*) FILTER (WHERE overlap > 0) OVER (PARTITION BY item_id, doc_id) AS hits FROM x),
p AS (SELECT * FROM r WHERE (overlap > 0 AND place <= 3) OR (hits = 0 AND ix = 0)),
t AS (SELECT item_id, doc_id, arg_min(ix, place) AS best, count(*) AS n FROM p GROUP BY item_id, doc_id),
z AS (SELECT r.item_id, r.doc_id, r.ix, r.sentence FROM r JOIN t USING (item_id, doc_id)
      WHERE EXISTS (SELECT 1 FROM p WHERE p.item_id = r.item_id AND p.doc_id = r.doc_id AND p.ix = r.ix)
         OR (abs(r.ix - t.best) = 1 AND (t.n = 1 OR regexp_matches(r.sentence, '(?i)\\b(?:after|before|except|if|only|required|unless|until|warning|when)\\b'))))
SELECT item_id, doc_id, string_agg(CAST(ix AS VARCHAR), ',' ORDER BY ix) AS selected FROM z GROUP BY item_id, doc_id""")
def compress_sentences(spark, d):
    """The sentences that a question's view of a document keeps: three that share most terms, and conditions beside the best."""
    rows = _evidence(spark, d).select("item_id", "doc_id", T.compression_terms(F.col("question")).alias("q"), F.posexplode(T.sentences(F.col("body"))).alias("ix", "sentence"))
    seen = rows.withColumn("overlap", F.size(F.array_intersect("q", T.compression_terms(F.col("sentence")))))
    doc = Window.partitionBy("item_id", "doc_id")
    ranked = seen.withColumn("place", F.row_number().over(doc.orderBy(F.desc("overlap"), "ix"))).withColumn("hits", F.count(F.when(F.col("overlap") > 0, 1)).over(doc))
    direct = ((F.col("overlap") > 0) & (F.col("place") <= 3)) | ((F.col("hits") == 0) & (F.col("ix") == 0))
    marked = ranked.withColumn("direct", direct).withColumn("best", F.min_by("ix", F.when(F.col("direct"), F.col("place"))).over(doc)).withColumn("n", F.count(F.when(F.col("direct"), 1)).over(doc))
    beside = (F.abs(F.col("ix") - F.col("best")) == 1) & ((F.col("n") == 1) | F.col("sentence").rlike(T.CONDITION_WORDS))
    kept = marked.where(F.col("direct") | beside)
    return kept.groupBy("item_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ix")), lambda i: i.cast("string")), ",").alias("selected"))


_GRADE = f"""
g AS (SELECT item_id, max(len(a)) AS terms, max(len(list_intersect(a, t))) AS overlap, bool_or(contains({S.fold("body")}, {S.fold("regexp_extract(question, '^[^.]*')")})) AS exact
      FROM (SELECT *, {S.distinct_terms('question', T.CONTENT_STOPWORDS)} AS a, {S.distinct_terms('body', T.CONTENT_STOPWORDS)} AS t FROM e) GROUP BY item_id),
grade AS (SELECT item_id, overlap, exact, CASE WHEN exact AND overlap >= greatest(1, terms // 2) THEN 'sufficient' WHEN exact OR overlap >= greatest(1, terms - 1) THEN 'partial' ELSE 'retry' END AS status FROM g)"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d).withColumn("a", F.array_distinct(T.content_terms(F.col("question")))).withColumn("t", F.array_distinct(T.content_terms(F.col("body"))))
    exact = F.contains(T.fold(F.col("body")), T.fold(F.regexp_extract("question", "^[^.]*", 0)))
    seen = rows.groupBy("item_id").agg(F.max(F.size("a")).alias("terms"), F.max(F.size(F.array_intersect("a", "t"))).alias("overlap"), F.bool_or(exact).alias("exact"))
    half, most = F.greatest(F.lit(1), F.floor(F.col("terms") / 2)), F.greatest(F.lit(1), F.col("terms") - 1)
    status = F.when(F.col("exact") & (F.col("overlap") >= half), "sufficient").when(F.col("exact") | (F.col("overlap") >= most), "partial").otherwise("retry")
    return seen.select("item_id", F.col("overlap").cast("long").alias("overlap"), "exact", status.alias("status"))


@query(f"{_EV}, {_GRADE} SELECT item_id, overlap, exact, status FROM grade")
def grade_overlap(spark, d):
    """Whether a passage's three best documents answer it: in full, in part or not yet."""
    return _graded(spark, d)


@query(f"""{_EV}, {_GRADE} SELECT item_id // 4 AS request, CASE WHEN bool_and(status = 'sufficient') THEN 'sufficient' WHEN bool_or(status = 'retry') THEN 'retry' ELSE 'partial' END AS first_pass,
  CASE WHEN bool_and(status = 'sufficient') THEN 'sufficient' WHEN bool_or(status IN ('sufficient', 'partial')) THEN 'partial' ELSE 'in_scope_insufficient' END AS last_pass FROM grade GROUP BY item_id // 4""")
def coverage_rollup(spark, d):
    """Passages four by four as the aspects of a request: its status while a retry is left and after it."""
    by = _graded(spark, d).groupBy(F.floor(F.col("item_id") / 4).cast("long").alias("request"))
    whole, some, again = F.bool_and(F.col("status") == "sufficient"), F.bool_or(F.col("status").isin("sufficient", "partial")), F.bool_or(F.col("status") == "retry")
    return by.agg(F.when(whole, "sufficient").when(again, "retry").otherwise("partial").alias("first_pass"), F.when(whole, "sufficient").when(some, "partial").otherwise("in_scope_insufficient").alias("last_pass"))


@query("SELECT doc_id, CAST(" + " + ".join(f"{w} * len(regexp_extract_all(lower(text), '{p}'))" for w, p in WEIGHTS) + " AS BIGINT) AS score FROM documents")
def relationship_score(spark, d):
    total = F.lit(0)
    for w, p in WEIGHTS:
        total = total + w * F.regexp_count(F.lower("text"), F.lit(p))
    return table(spark, d, "documents").select("doc_id", total.cast("long").alias("score"))


@query(f"""WITH a AS (SELECT item_id, {S.distinct_terms("regexp_extract(text, '^[^.]*')", T.CONTENT_STOPWORDS)} AS a FROM benchmark)
SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS aspects FROM (SELECT doc_id, {S.distinct_terms('text', T.CONTENT_STOPWORDS)} AS t FROM documents), a
WHERE len(a) > 0 AND len(list_intersect(a, t)) = len(a) GROUP BY doc_id""")
def aspect_tags(spark, d):
    """The aspects (first sentences of passages) whose terms a document all has: as many common terms as the aspect has."""
    asked = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.content_terms(F.regexp_extract("text", "^[^.]*", 0))).alias("a")).where("size(a) > 0")
    told = table(spark, d, "documents").select("doc_id", F.array_distinct(T.content_terms(F.col("text"))).alias("t"))
    asked = asked.select("item_id", F.size("a").alias("n"), F.explode("a").alias("term"))
    met = told.select("doc_id", F.explode("t").alias("term")).join(asked, "term").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n")).where("both = n")
    return met.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda i: i.cast("string")), ",").alias("aspects"))


@query()
def greedy_cover(spark, d):
    """Documents chosen one by one for the most aspects (passages four by four) not yet covered, eight at most for each request."""
    import pandas as pd

    hits = _top12(spark, d).select(F.floor(F.col("item_id") / 4).cast("long").alias("request"), "item_id", "doc_id", "rank")

    def cover(rows: pd.DataFrame) -> pd.DataFrame:
        left, of, out = set(rows.item_id), rows.groupby("doc_id").item_id.agg(set), []
        first = rows.groupby("doc_id")["rank"].min()
        for place in range(1, 9):
            rest = [k for k in of.index if k not in {o[1] for o in out}]
            if not rest:
                break
            k = min(rest, key=lambda k: (-len(of[k] & left), first[k], k))
            out.append((int(rows.request.iloc[0]), int(k), place, len(of[k] & left)))
            left -= of[k]
        return pd.DataFrame(out, columns=["request", "doc_id", "place", "adds"])

    return hits.groupBy("request").applyInPandas(cover, "request long, doc_id long, place long, adds long")


# ---------------------------------------------------------------- conversations


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn)) AS text FROM conversations GROUP BY conv_id")
def latest_user_turn(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))), F.max_by("text", "turn")).alias("text"))


@query(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
q AS (SELECT conv_id, {S.distinct_terms('text', T.CONTENT_STOPWORDS)} AS q FROM h WHERE back = 1),
r AS (SELECT h.conv_id, turn, len(list_intersect(q, {S.distinct_terms('text', T.CONTENT_STOPWORDS)})) AS overlap FROM h JOIN q USING (conv_id) WHERE back BETWEEN 2 AND 13)
SELECT conv_id, turn FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn DESC) <= 6""")
def relevant_history(spark, d):
    """Of the twelve turns before the last, the six that share most terms with it."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, d, "conversations").withColumn("back", F.row_number().over(back)).withColumn("t", F.array_distinct(T.content_terms(F.col("text"))))
    asked = rows.withColumn("q", F.first("t").over(back)).where("back BETWEEN 2 AND 13").withColumn("overlap", F.size(F.array_intersect("q", "t")))
    return asked.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("overlap"), F.desc("turn")))).where("place <= 6").select("conv_id", "turn")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def conversation_render(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns["line"], "\n").alias("rendered"))


# ---------------------------------------------------------------- evaluation


@query(f"""{_TOP12} SELECT count(*) AS cases, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN top THEN 1.0 ELSE 0.0 END), 6) AS top_rate
FROM (SELECT item_id, bool_or(contains(d.text, x.text)) AS hit, bool_or(rank = 1 AND contains(d.text, x.text)) AS top FROM b JOIN documents d USING (doc_id) JOIN benchmark x USING (item_id) GROUP BY item_id)""")
def eval_hit_rates(spark, d):
    """How often a passage's text stands in one of its twelve documents, and in the first."""
    rows = _top12(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("body")), "doc_id").join(table(spark, d, "benchmark"), "item_id")
    each = rows.groupBy("item_id").agg(F.bool_or(F.contains("body", "text")).alias("hit"), F.bool_or((F.col("rank") == 1) & F.contains("body", "text")).alias("top"))
    rate = lambda c: F.round(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 6)
    return each.agg(F.count(F.lit(1)).alias("cases"), rate("hit").alias("hit_rate"), rate("top").alias("top_rate"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(max(CASE WHEN i = seat THEN value END), 6) AS p95
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, 1 + CAST(round_even((count(*) OVER (PARTITION BY event_type) - 1) * 0.95, 0) AS BIGINT) AS seat FROM events) GROUP BY event_type""")
def eval_p95(spark, d):
    """Mean, median and the nearest rank (rounded to even) of 95 % for each kind of event."""
    by = Window.partitionBy("event_type")
    ranked = table(spark, d, "events").withColumn("i", F.row_number().over(by.orderBy("value"))).withColumn("at", 1 + F.bround((F.count(F.lit(1)).over(by) - 1) * 0.95).cast("long"))
    return ranked.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.max(F.when(F.col("i") == F.col("at"), F.col("value"))), 6).alias("p95"))


@query("SELECT source, count(*) AS docs, count(quality) AS labelled, coalesce(sum(quality), 0)::BIGINT AS good, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def eval_label_join(spark, d):
    met = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return met.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("quality").alias("labelled"), total("quality").alias("good"), total("toxic").alias("toxic"))


@query("SELECT event_type, user_id % 10 AS shard, count(*) AS n, round(sum(value), 4) AS total, round(arg_max(value, event_id), 6) AS last_value FROM events GROUP BY event_type, user_id % 10")
def metrics_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max_by("value", "event_id"), 6).alias("last_value"))


@query("""SELECT 'events_total{type="' || event_type || '",shard="' || CAST(user_id % 10 AS VARCHAR) || '"} ' || CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type, user_id % 10""")
def metrics_text(spark, d):
    """Counters in the text form that scrapers read."""
    n = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.concat(F.lit('events_total{type="'), "event_type", F.lit('",shard="'), F.col("shard").cast("string"), F.lit('"} '), F.col("n").cast("string")).alias("line"))


@query("""SELECT user_id % 20 AS client, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM events GROUP BY user_id % 20""")
def status_pivot(spark, d):
    is_type = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("client")).agg(is_type("click").alias("clicks"), is_type("purchase").alias("purchases"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("success_rate"))
