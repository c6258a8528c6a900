"""Queries of decision lists, heading states and selections, mostly over literal rows."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import evidence, vectors
from lectern.plans.search_queries import _CHUNKS, _chunks
from lectern.plans.text_queries import literal, values
from lectern.registry import query, table

_FLAGS = ("in_scope", "relationship_mode", "relation_words", "event_asked", "exact", "event_found", "definition_words", "event_in_section", "control_asked", "control_found", "list_field_asked", "object_reference", "list_types", "procedure_asked", "procedure_found", "table_asked", "table_found", "definition_asked", "security_asked")
_COUNTS = ("section_overlap", "overlap", "canonical", "terms")
#: Every bit pattern of a simple rule, so that all rules decide some rows.
_FEATURES = [(i, i % 3 > 0, *[(i * p // 7) % 3 == 0 and (n != "in_scope" or i % 11 > 0) if n != "in_scope" else i % 11 > 0 for n, p in zip(_FLAGS, itertools.count(3, 2))], i % 2, i % 4, i // 3 % 2, 1 + i % 3) for i in range(400)]


def _flag(x) -> str:
    return str(x).lower() if isinstance(x, bool) else f"CAST({x} AS BIGINT)"


_ROWS = "(VALUES " + ", ".join("(" + ", ".join(map(_flag, r)) + ")" for r in _FEATURES) + ") AS t(id, retries_left, " + ", ".join((*_FLAGS, *_COUNTS)) + ")"


@query("SELECT id, CASE " + " ".join(f"WHEN {rule} THEN " + ("CASE WHEN retries_left THEN 'retry' ELSE 'in_scope_insufficient' END" if s == "weak" else f"'{s}'") for s, rule in evidence.RULES) + f" END AS status FROM {_ROWS}")
def grade_rules(spark, d):
    schema = "id long, retries_left boolean, " + ", ".join(f"{f} boolean" for f in _FLAGS) + ", " + ", ".join(f"{c} long" for c in _COUNTS)
    return literal(spark, schema, _FEATURES).select("id", evidence.grade(F.col("retries_left")).alias("status"))


BLOCKS = [(1, 1, "chapter", "Basics"), (1, 2, "text", "a"), (1, 3, "section", "Roles"), (1, 4, "text", "b"), (1, 5, "subsection", "Rights"), (1, 6, "text", "c"), (1, 7, "section", "Groups"), (1, 8, "text", "d"), (1, 9, "chapter", "More"), (1, 10, "text", "e"), (2, 1, "text", "f")]
_B = values(BLOCKS, "doc, pos, kind, body")
_LAST = "last_value(CASE WHEN kind = '{0}' THEN pos END IGNORE NULLS) OVER w AS {0}_at, last_value(CASE WHEN kind = '{0}' THEN body END IGNORE NULLS) OVER w AS {0}"


@query(f"""SELECT doc, pos, coalesce(chapter, '') AS chapter, coalesce(CASE WHEN section_at > coalesce(chapter_at, 0) THEN section END, '') AS section,
  coalesce(CASE WHEN subsection_at > greatest(coalesce(chapter_at, 0), coalesce(section_at, 0)) THEN subsection END, '') AS subsection
FROM (SELECT *, {_LAST.format('chapter')}, {_LAST.format('section')}, {_LAST.format('subsection')} FROM {_B} WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE kind = 'text'""")
def heading_states(spark, d):
    """Chapter, section and subsection that each block stands under: a heading ends those below its level."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.struct("pos", "body")), ignorenulls=True).over(w)
    rows = literal(spark, "doc long, pos long, kind string, body string", BLOCKS)
    state = rows.select("doc", "pos", "kind", last("chapter").alias("c"), last("section").alias("s"), last("subsection").alias("u")).where("kind = 'text'")
    at = lambda x: F.coalesce(F.col(f"{x}.pos"), F.lit(0))
    name = lambda x, ok: F.coalesce(F.when(ok, F.col(f"{x}.body")), F.lit(""))
    return state.select("doc", "pos", name("c", F.lit(True)).alias("chapter"), name("s", at("s") > at("c")).alias("section"), name("u", at("u") > F.greatest(at("c"), at("s"))).alias("subsection"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS shared FROM (SELECT 's_' || doc_id || '_' || ix AS id FROM chunks INTERSECT SELECT 'r_' || doc_id || '_' || ix FROM chunks)")
def index_disjoint(spark, d):
    """Ids of segments and of representations must have nothing in common."""
    made = lambda p: _chunks(spark, d).select(F.concat(F.lit(p), F.col("doc_id").cast("string"), F.lit("_"), F.col("ix").cast("string")).alias("id"))
    return made("s_").intersect(made("r_")).agg(F.count(F.lit(1)).alias("shared"))


CASES = [(1, "A role has rights [S1]", "role,right", "Guide", "Guide A", "S1"), (2, "Nothing [S2]", "role", "Guide,Plan", "Guide A", "S1"), (3, "Free text", "", "", "Guide", ""), (4, "Step [S1] [S2]", "step", "plan", "The Plan", "S1,S2")]
_C = values(CASES, "id, answer, terms, manuals, told, sources")


@query(rf"""SELECT id, CASE WHEN terms = '' THEN 'none' WHEN len(list_filter(string_split(terms, ','), lambda x: contains(lower(answer), x))) > 0 THEN 'hit' ELSE 'miss' END AS output,
  CASE WHEN manuals = '' THEN 'none' WHEN len(list_filter(string_split(lower(manuals), ','), lambda x: NOT contains(lower(told), x))) = 0 THEN 'hit' ELSE 'miss' END AS manual,
  sources <> '' AND array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[S(\d+)\]', 1), lambda x: 'S' || x))), ',') = sources AS cited FROM {_C}""")
def output_hits(spark, d):
    """Whether an answer has an expected term, all expected manuals, and cites just its sources."""
    rows = literal(spark, "id long, answer string, terms string, manuals string, told string, sources string", CASES)
    output = F.when(F.col("terms") == "", "none").when(F.exists(F.split("terms", ","), lambda x: F.contains(F.lower("answer"), x)), "hit").otherwise("miss")
    manual = F.when(F.col("manuals") == "", "none").when(F.forall(F.split(F.lower("manuals"), ","), lambda x: F.contains(F.lower("told"), x)), "hit").otherwise("miss")
    cited = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: F.concat(F.lit("S"), x)))), ",")
    return rows.select("id", output.alias("output"), manual.alias("manual"), ((F.col("sources") != "") & (cited == F.col("sources"))).alias("cited"))


TIERS = [(1, 3, 0, 0.0, False, False, 0.0, False, 0.0), (2, 0, 2, 0.6, True, True, 1.0, True, 1.0), (3, 0, 0, 0.7, True, False, 0.0, False, 0.0), (4, 0, 0, 0.0, True, True, 0.0, False, 0.0), (5, 0, 0, 0.0, False, True, 0.0, False, 0.0), (6, 0, 0, 0.0, False, False, 0.8, False, 0.0), (7, 0, 0, 0.0, False, False, 0.0, True, 0.0), (8, 0, 0, 0.0, False, False, 0.0, False, 0.5), (9, 0, 0, 0.1, False, False, 0.2, False, 0.3)]


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(23.0 AS DOUBLE), CAST(1.0 AS DOUBLE)), (2, 17.0, 0.99), (3, 10.0, 0.7), (4, 4.0, 0.98), (5, 3.0, 0.96), (6, 2.0, 0.8), (7, 2.0, 0.9), (8, 1.0, 0.5)) AS t(id, tier, score)")
def concept_tiers(spark, d):
    names = ("alias_weight", "component_weight", "alias_similarity", "target_exact", "in_query", "target_similarity", "input_exact", "similarity")
    kinds = ("long", "long", "double", "boolean", "boolean", "double", "boolean", "double")
    rows = literal(spark, "id long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)), TIERS)
    return rows.select("id", evidence.concept_tier(*[F.col(n) for n in names]).alias("t")).where("t IS NOT NULL").select("id", "t.tier", "t.score")


LINKS = [(1, 1, 0, 0, "a"), (1, 1, 0, 1, "b"), (1, 2, 0, 0, "a"), (1, 2, 0, 1, "c"), (1, 1, 1, 0, "d"), (1, 2, 1, 0, "c"), (1, 1, 3, 0, "z"), (2, 1, 0, 0, "q")]


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'a', CAST(1 AS BIGINT)), (1, 2, 'c', 2), (1, 1, 'd', 3), (2, 1, 'q', 1)) AS t(query, rank, segment, place)")
def linked_results(spark, d):
    """Segments of a question's records, in rounds over their units; what lies behind an empty round is never reached."""
    return evidence.linked(literal(spark, "query long, rank long, depth long, `order` long, segment string", LINKS), 8)


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 6) AS likeness
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.label <> q.label
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 6) DESC, e.vec_id) <= 8""")
def semantic_fallback(spark, d):
    """The eight vectors most alike to each of a stated set, leaving out those already matched (here: of the same label)."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("wanted"), F.col("label").alias("known"))
    return vectors.likest(e, "vec_id", "embedding", asked, "query_id", "wanted", 8, apart=("label", "known")).drop("rank")
