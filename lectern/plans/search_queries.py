"""Queries of retrieval: lexical and dense search, fusion, headings, aliases, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import fusion, lexical, vectors
from lectern.plans import sql as S
from lectern.plans.text_queries import literal, values
from lectern.registry import query, table

_BM25 = f"""
d AS (SELECT doc_id, source, {S.tokens('text')} AS t FROM documents),
size AS (SELECT doc_id, source, CAST(len(t) AS DOUBLE) AS len FROM d),
post AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS r FROM df),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT item_id, term, CAST(count(*) AS DOUBLE) AS times FROM (SELECT item_id, unnest({S.tokens('text')}) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, source, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM size))))), 6) AS score
           FROM asked JOIN stats USING (term) JOIN post USING (term) JOIN size USING (doc_id) GROUP BY item_id, doc_id, source HAVING round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM size))))), 6) > 0)"""
_TOP12 = f"WITH {_BM25}, b AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 12)"
_LIKE = f"""
l AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT b.item_id, b.doc_id, round(CASE WHEN least(len(q), len(t)) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, t)) AS DOUBLE) / least(len(q), len(t)) * CASE WHEN least(len(q), len(t)) = 1 THEN 0.7 ELSE 1.0 END END, 6) AS score
  FROM b JOIN (SELECT item_id, list_distinct(list_filter({S.tokens('text')}, lambda t: t NOT IN {S.names(T.STOPWORDS)})) AS q FROM benchmark) USING (item_id)
         JOIN (SELECT doc_id, list_distinct(list_filter({S.tokens('text')}, lambda t: t NOT IN {S.names(T.STOPWORDS)})) AS t FROM documents) USING (doc_id)))"""


def _search(spark: SparkSession, d: str, k: int, among: DataFrame | None = None) -> DataFrame:
    found = lexical.search(lexical.index(table(spark, d, "documents"), "doc_id"), table(spark, d, "benchmark"), "item_id", k, among)
    return found.select("item_id", "doc_id", "score", "rank")


def _top12(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, 12)


def _reranked(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """hits ordered anew by overlap of terms, the scorer that needs no model."""
    asked = table(spark, d, "benchmark").select("item_id", T.similarity_terms(F.col("text")).alias("q"))
    told = table(spark, d, "documents").select("doc_id", T.similarity_terms(F.col("text")).alias("t"))
    met = hits.select("item_id", "doc_id").join(asked, "item_id").join(told, "doc_id")
    scored = met.select("item_id", "doc_id", F.round(T.term_overlap(F.col("q"), F.col("t")), 6).alias("score"))
    return lexical.top(scored, ["item_id"], "doc_id", 12)


@query(f"{_TOP12} SELECT * FROM b")
def bm25_topk(spark, d):
    return _top12(spark, d)


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE contains(lower(source), 'src1') QUALIFY rank <= 4")
def bm25_preferred_source(spark, d):
    """The four best among preferred sources; scores are those of the whole corpus."""
    liked = table(spark, d, "documents").where(F.contains(F.lower("source"), F.lit("src1"))).select("doc_id")
    return _search(spark, d, 4, liked)


@query(f"WITH {_BM25} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM stats")
def term_stats(spark, d):
    stats = lexical.index(table(spark, d, "documents"), "doc_id").terms
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


_DIST = "round(list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))), 6)"


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("wanted"))


@query(f"SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 12")
def knn_topk(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _asked_vectors(spark, d), "query_id", "wanted", 12)


@query(f"SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE label IN (2, 3)) e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 12")
def knn_filtered(spark, d):
    return vectors.nearest(table(spark, d, "embeddings").where("label IN (2, 3)"), "vec_id", "embedding", _asked_vectors(spark, d), "query_id", "wanted", 12)


@query(f"SELECT q.vec_id AS query_id, e.label, e.vec_id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 4")
def knn_per_group(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _asked_vectors(spark, d), "query_id", "wanted", 4, within=["label"])


@query(f"{_TOP12}, {_LIKE} SELECT item_id, doc_id, score, rank FROM l")
def overlap_rerank(spark, d):
    return _reranked(spark, d, _top12(spark, d)).select("item_id", "doc_id", "score", "rank")


_FUSED = """
f AS (SELECT item_id, doc_id, round(sum(w / (60 + rank)), 9) AS score, min(ix * 1000000 + rank) AS first
      FROM (SELECT item_id, doc_id, rank, 0 AS ix, CAST({0} AS DOUBLE) AS w FROM b UNION ALL SELECT item_id, doc_id, rank, 1, CAST({1} AS DOUBLE) FROM l) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first, doc_id) AS rank FROM f QUALIFY rank <= 18"""


def _lists(spark: SparkSession, d: str, one: float, two: float) -> DataFrame:
    best = _top12(spark, d)
    told = lambda h, ix, w: h.select("item_id", "doc_id", "rank", F.lit(ix).alias("list_ix"), F.lit(w).alias("weight"))
    return told(best, 0, one).unionByName(told(_reranked(spark, d, best), 1, two))


@query(f"{_TOP12}, {_LIKE}, {_FUSED.format(1.0, 1.0)}")
def rrf_two_lists(spark, d):
    return fusion.rank_fused(fusion.fuse(_lists(spark, d, 1.0, 1.0), "item_id", "doc_id"), "item_id", "doc_id", 18).select("item_id", "doc_id", "score", "rank")


@query(f"{_TOP12}, {_LIKE}, {_FUSED.format(1.15, 0.65)}")
def rrf_weighted_multi(spark, d):
    return fusion.rank_fused(fusion.fuse(_lists(spark, d, 1.15, 0.65), "item_id", "doc_id"), "item_id", "doc_id", 18).select("item_id", "doc_id", "score", "rank")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS k FROM documents) GROUP BY k")
def exact_text_dedup(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", fusion.text_key(F.col("text")).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query(f"{_TOP12}, {_LIKE} SELECT item_id, doc_id, min(rank) AS rank, max(score) AS score, arg_min(path, ix) AS path FROM (SELECT item_id, doc_id, rank, score, 'bm25' AS path, 0 AS ix FROM b UNION ALL SELECT item_id, doc_id, rank, score, 'overlap', 1 FROM l) GROUP BY item_id, doc_id")
def id_dedup_merge(spark, d):
    best = _top12(spark, d)
    both = best.select("item_id", "doc_id", "rank", "score", F.lit("bm25").alias("path"), F.lit(0).alias("ix")).unionByName(_reranked(spark, d, best).select("item_id", "doc_id", "rank", "score", F.lit("overlap").alias("path"), F.lit(1).alias("ix")))
    return fusion.merge_copies(both, ["item_id", "doc_id"], "ix", lowest=["rank"], highest=["score"], first=["path"]).drop("ix")


@query(f"""{_TOP12}, r AS (SELECT b.*, source AS parent, lang AS kind FROM b JOIN documents USING (doc_id)),
s AS (SELECT *, row_number() OVER w AS i, first_value(kind) OVER w AS k1 FROM r WINDOW w AS (PARTITION BY item_id, parent ORDER BY rank)),
o AS (SELECT *, coalesce(min(CASE WHEN kind <> k1 THEN i END) OVER (PARTITION BY item_id, parent), 2) AS second FROM s)
SELECT item_id, parent, doc_id, rank FROM o WHERE i = 1 OR i = second""")
def diversity_cap(spark, d):
    rows = _top12(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("source").alias("parent"), F.col("lang").alias("kind")), "doc_id")
    return fusion.diverse(rows, "item_id", "parent", "kind", "rank").select("item_id", "parent", "doc_id", "rank")


@query(f"""{_TOP12}, {_LIKE}, u AS (SELECT item_id, doc_id, rank, 0 AS part FROM b UNION ALL SELECT item_id, doc_id, rank, 1 FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id, part ORDER BY rank, doc_id) AS depth FROM u),
g AS (SELECT item_id, doc_id, min(depth * 10 + part) AS seat, count(DISTINCT part) AS parts FROM p GROUP BY item_id, doc_id)
SELECT item_id, doc_id, parts, row_number() OVER (PARTITION BY item_id ORDER BY seat, doc_id) AS place FROM g QUALIFY place <= 8""")
def round_robin_merge(spark, d):
    best = _top12(spark, d)
    both = best.select("item_id", "doc_id", "rank", F.lit(0).alias("part")).unionByName(_reranked(spark, d, best).select("item_id", "doc_id", "rank", F.lit(1).alias("part")))
    return fusion.interleave(both, "item_id", "part", "doc_id", "rank", 8).select("item_id", "doc_id", F.size("parts").cast("long").alias("parts"), "place")


CHUNK = 150
_CHUNKS = f"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
chunks AS (SELECT doc_id, ix, array_to_string(w[(ix * {CHUNK} + 1):(ix * {CHUNK} + {CHUNK})], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / {CHUNK}.0) AS BIGINT))) AS ix FROM words))"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    cut = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / CHUNK).cast("int"))).alias("i"))
    return cut.select("doc_id", F.col("i").cast("long").alias("ix"), F.array_join(F.slice("w", F.col("i") * CHUNK + 1, F.lit(CHUNK)), " ").alias("text"))


_HITS = f"""
hits AS (SELECT item_id, doc_id, ix, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, ix) AS rank FROM (
  SELECT item_id, doc_id, ix, CAST(len(list_intersect(q, {S.distinct_terms('c.text', T.COMPRESSION_STOPWORDS)})) AS BIGINT) AS score
  FROM chunks c, (SELECT item_id, {S.distinct_terms('text', T.COMPRESSION_STOPWORDS)} AS q FROM benchmark WHERE item_id % 100 = 0)) WHERE score > 0 QUALIFY rank <= 6)"""


def _chunk_hits(spark: SparkSession, d: str) -> DataFrame:
    """The six chunks that share most terms with each hundredth passage, a stated set of questions."""
    asked = table(spark, d, "benchmark").where("item_id % 100 = 0").select("item_id", F.explode(T.compression_terms(F.col("text"))).alias("t"))
    told = _chunks(spark, d).select("doc_id", "ix", F.explode(T.compression_terms(F.col("text"))).alias("t"))
    scored = told.join(asked, "t").groupBy("item_id", "doc_id", "ix").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "ix")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 6")


@query(f"""WITH {_CHUNKS}, {_HITS} SELECT item_id, doc_id, ix, max(score) AS score, max(seed) AS is_seed FROM (
  SELECT h.item_id, h.doc_id, h.ix + s AS ix, h.score, CAST(CASE WHEN s = 0 THEN 1 ELSE 0 END AS INT) AS seed FROM hits h, (VALUES (0), (-1), (1)) AS v(s))
  WHERE (doc_id, ix) IN (SELECT doc_id, ix FROM chunks) GROUP BY item_id, doc_id, ix""")
def neighbour_expand(spark, d):
    return fusion.neighbours(_chunk_hits(spark, d), _chunks(spark, d), "item_id", "doc_id", "ix")


@query(f"WITH {_CHUNKS}, {_HITS} SELECT item_id, doc_id, min(rank) AS best_rank, max(score) AS best_score, count(*) AS n_hits FROM hits GROUP BY item_id, doc_id")
def parent_resolve(spark, d):
    return fusion.parents(_chunk_hits(spark, d), "item_id", "doc_id")


_HEADING = "trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\\s+', ' ', 'g'))"


def _page_headings(spark: SparkSession, d: str) -> DataFrame:
    h = F.trim(F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), r"\s+", " "))
    host = F.regexp_extract("url", "//([^/]*)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), h.alias("heading")).where("heading <> ''")


@query(f"SELECT page_id, {_HEADING} AS heading FROM pages WHERE {_HEADING} <> ''")
def page_headings(spark, d):
    return _page_headings(spark, d).select("page_id", "heading")


@query(f"""
SELECT host, key, min(page_id) AS first_page, arg_min(heading, page_id) AS heading, array_to_string(list_sort(list(page_id)), ',') AS pages
FROM (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, {_HEADING} AS heading, {S.lookup_key(S.clean(_HEADING))} AS key FROM pages WHERE {_HEADING} <> '') GROUP BY host, key""")
def heading_index(spark, d):
    """One record for each heading of a host, with the first page's wording and all its pages in order."""
    keyed = _page_headings(spark, d).withColumn("key", T.heading_key(F.col("heading")))
    pages = F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda p: p.cast("string")), ",")
    return keyed.groupBy("host", "key").agg(F.min("page_id").alias("first_page"), F.min_by("heading", "page_id").alias("heading"), pages.alias("pages"))


_ASKED = f"(SELECT page_id AS query_id, {S.lookup_key(S.clean(_HEADING))} AS key, list_distinct(list_filter({S.tokens(_HEADING)}, lambda t: t NOT IN {S.names(T.STOPWORDS)})) AS q FROM pages WHERE page_id % 100 = 0 AND {_HEADING} <> '')"
_TOLD = f"(SELECT page_id, {S.lookup_key(S.clean(_HEADING))} AS key, list_distinct(list_filter({S.tokens(_HEADING)}, lambda t: t NOT IN {S.names(T.STOPWORDS)})) AS t FROM pages WHERE {_HEADING} <> '')"


def _asked_headings(spark: SparkSession, d: str) -> DataFrame:
    return _page_headings(spark, d).where("page_id % 100 = 0").select(F.col("page_id").alias("query_id"), T.heading_key(F.col("heading")).alias("asked"), T.similarity_terms(F.col("heading")).alias("q"))


@query(f"SELECT a.query_id, b.page_id FROM {_ASKED} a JOIN {_TOLD} b ON a.key = b.key")
def heading_exact(spark, d):
    told = _page_headings(spark, d).select("page_id", T.heading_key(F.col("heading")).alias("key"))
    return told.join(_asked_headings(spark, d), F.col("key") == F.col("asked")).select("query_id", "page_id")


@query(f"""SELECT query_id, page_id, tier, score, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, score DESC, page_id) AS rank FROM (
  SELECT query_id, page_id, CAST(CASE WHEN same THEN 2 ELSE 1 END AS BIGINT) AS tier, CASE WHEN same THEN 1.0 ELSE s END AS score FROM (
    SELECT query_id, page_id, a.key = b.key AS same, round(CASE WHEN least(len(q), len(t)) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, t)) AS DOUBLE) / least(len(q), len(t)) * CASE WHEN least(len(q), len(t)) = 1 THEN 0.7 ELSE 1.0 END END, 6) AS s
    FROM {_ASKED} a, {_TOLD} b) WHERE same OR s >= 0.5) QUALIFY rank <= 8""")
def heading_fuzzy(spark, d):
    """Exact keys first, then headings whose terms overlap by half at least; eight for each of a stated set of questions."""
    told = _page_headings(spark, d).select("page_id", T.heading_key(F.col("heading")).alias("key"), T.similarity_terms(F.col("heading")).alias("t"))
    asked = _asked_headings(spark, d)
    same = told.join(asked, F.col("key") == F.col("asked")).select("query_id", "page_id", F.lit(True).alias("same"), F.lit(1.0).alias("s"))
    words = told.select("page_id", F.size("t").alias("nt"), F.explode("t").alias("w")).join(asked.select("query_id", F.size("q").alias("nq"), F.explode("q").alias("w")), "w")
    least = F.least(F.first("nt"), F.first("nq"))
    alike = words.groupBy("query_id", "page_id").agg(F.round(F.count(F.lit(1)) / least * F.when(least == 1, 0.7).otherwise(1.0), 6).alias("s")).where("s >= 0.5")
    both = same.unionByName(alike.select("query_id", "page_id", F.lit(False).alias("same"), "s"))
    scored = both.groupBy("query_id", "page_id").agg(F.bool_or("same").alias("same"), F.max("s").alias("s"))
    ranked = scored.select("query_id", "page_id", F.when(F.col("same"), 2).otherwise(1).cast("long").alias("tier"), F.when(F.col("same"), 1.0).otherwise(F.col("s")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("tier"), F.desc("score"), "page_id")
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 8")


ALIASES = [("Licence", "apache license"), ("Licence", "licensed under"), ("Secret", "token"), ("Insult", "moron"), ("Insult", "idiot"), ("Insult", "clown"), ("Contact", "email"), ("Contact", "phone")]
_PADDED = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"SELECT doc_id, canonical, string_agg(alias, ',' ORDER BY alias) AS aliases FROM (SELECT doc_id, {_PADDED} AS p FROM documents), {values(ALIASES, 'canonical, alias')} WHERE contains(p, ' ' || alias || ' ') GROUP BY doc_id, canonical")
def alias_match(spark, d):
    """Concepts whose aliases stand in a text as whole words; the catalogue is small by definition and goes to every task."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), F.lit(" "))
    catalogue = literal(spark, "canonical string, alias string", ALIASES)
    met = table(spark, d, "documents").select("doc_id", padded.alias("p")).join(F.broadcast(catalogue), F.contains("p", F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    return met.groupBy("doc_id", "canonical").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


@query("""SELECT name, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '([A-Za-z]+)', 1), lambda t: regexp_matches(t, '^[A-Z][a-z]+$'))) AS name FROM documents) GROUP BY name HAVING count(*) >= 3""")
def concept_index(spark, d):
    """Capitalised terms that come three times or more, with how often and in how many documents."""
    found = table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), lambda t: t.rlike("^[A-Z][a-z]+$"))).alias("name"))
    each = found.groupBy("name", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy("name").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs")).where("n >= 3")


OUTLINE = [(1, 1, "Intro"), (1, 3, "Roles"), (2, 3, "Rights"), (2, 6, "Events"), (1, 8, "End")]


@query(f"""SELECT page, (SELECT arg_max(title, start) FROM {values(OUTLINE, 'level, start, title')} WHERE level = 1 AND start <= page) AS chapter,
  (SELECT arg_max(title, start) FROM {values(OUTLINE, 'level, start, title')} WHERE level = 2 AND start <= page
     AND start >= (SELECT max(start) FROM {values(OUTLINE, 'level, start, title')} WHERE level = 1 AND start <= page)) AS section
FROM (SELECT unnest(range(1, 10)) AS page)""")
def outline_asof(spark, d):
    """The last bookmark at or before each page, a section only inside its chapter: rows side by side and filled forward."""
    marks = literal(spark, "level int, page long, title string", OUTLINE)
    rows = marks.unionByName(spark.range(1, 10).select(F.lit(9).alias("level"), F.col("id").alias("page"), F.lit(None).cast("string").alias("title")))
    w = Window.orderBy("page", "level").rowsBetween(Window.unboundedPreceding, 0)  # one document's outline
    chapter = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(w)
    at = F.last(F.when(F.col("level") == 1, F.col("page")), ignorenulls=True).over(w)
    section = F.last(F.when(F.col("level") == 2, F.struct("title", "page")), ignorenulls=True).over(w)
    filled = rows.select("level", "page", chapter.alias("chapter"), F.when(section["page"] >= at, section["title"]).alias("section"))
    return filled.where("level = 9").select("page", "chapter", "section")


BOXES = [(1, "a", 0.0, 0.0, 10.0, 10.0), (1, "b", 0.0, 8.0, 10.0, 12.0), (1, "c", 20.0, 20.0, 30.0, 30.0), (2, "d", 0.0, 0.0, 5.0, 5.0)]
AREAS = [(1, 0.0, 0.0, 12.0, 10.0), (2, 50.0, 50.0, 60.0, 60.0)]


@query(f"""SELECT page, name FROM {values(BOXES, 'page, name, x0, y0, x1, y1')} WHERE NOT EXISTS (
  SELECT 1 FROM {values(AREAS, 'p, a0, b0, a1, b1')} AS t2 WHERE p = page
  AND greatest(0.0, least(x1, a1) - greatest(x0, a0)) * greatest(0.0, least(y1, b1) - greatest(y0, b0)) / greatest(1.0, (x1 - x0) * (y1 - y0)) >= 0.45)""".replace(") AS t(p, a0, b0, a1, b1) AS t2", ") AS t2(p, a0, b0, a1, b1)"))
def blocks_outside_tables(spark, d):
    """Blocks of which less than 45 % lie inside a table of their page."""
    blocks = literal(spark, "page long, name string, x0 double, y0 double, x1 double, y1 double", BOXES)
    areas = literal(spark, "p long, a0 double, b0 double, a1 double, b1 double", AREAS)
    side = lambda lo, hi, a, b: F.greatest(F.lit(0.0), F.least(hi, b) - F.greatest(lo, a))
    inside = side(F.col("x0"), F.col("x1"), F.col("a0"), F.col("a1")) * side(F.col("y0"), F.col("y1"), F.col("b0"), F.col("b1"))
    area = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return blocks.join(F.broadcast(areas), (F.col("page") == F.col("p")) & (inside / area >= 0.45), "left_anti").select("page", "name")
