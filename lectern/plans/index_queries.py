"""Queries of ingestion, index integrity and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import structure
from lectern.plans import sql as S
from lectern.plans.search_queries import _CHUNKS, _chunks
from lectern.plans.text_queries import literal, values
from lectern.registry import query, table
from lectern.sources import files
from lectern.streaming import requests


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def integrity_anti(spark, d):
    """Ids that one of two tables lacks."""
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id")
    return a.join(b, "doc_id", "left_anti").unionByName(b.join(a, "doc_id", "left_anti"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'documents' WHEN x.doc_id IS NULL THEN 'labels' ELSE 'both' END AS side, count(*) AS n FROM documents x FULL OUTER JOIN labels l USING (doc_id) GROUP BY 1")
def id_reconcile(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.lit(1).alias("x"))
    met = a.join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("y")), "doc_id", "full_outer")
    return met.groupBy(F.when(F.col("y").isNull(), "documents").when(F.col("x").isNull(), "labels").otherwise("both").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT name, CASE WHEN a IS NULL THEN 'removed' WHEN b IS NULL THEN 'new' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS a FROM documents WHERE doc_id % 7 <> 0) FULL OUTER JOIN (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS b FROM documents WHERE doc_id % 11 <> 0) USING (name)""")
def manifest_diff(spark, d):
    """Two made states of a folder: each lacks some files, and some have changed."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    now = docs.where("doc_id % 7 <> 0").select("name", F.sha2("text", 256).alias("sha256"))
    before = docs.where("doc_id % 11 <> 0").select("name", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return files.manifest_diff(now, before)


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""SELECT source, CAST(count(*) AS BIGINT) AS units, CAST(sum(n) AS BIGINT) AS words, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round_even(avg(n), 2) AS mean, count(*) FILTER (WHERE chars < 40) AS low_text, count(DISTINCT lang) AS langs
FROM (SELECT source, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, length(text) AS chars FROM documents) GROUP BY source""")
def audit_rollup(spark, d):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long")
    rows = table(spark, d, "documents").select("source", "lang", n.alias("n"), F.length("text").alias("chars"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("words"), F.min("n").alias("least"), F.max("n").alias("most"), F.bround(F.avg("n"), 2).alias("mean"), F.count_if(F.col("chars") < 40).alias("low_text"), F.countDistinct("lang").alias("langs"))


_LINES = rf"(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)"
_MARGIN = rf"regexp_replace(regexp_replace(lower({S.clean('line')}), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')"


@query(f"""SELECT source, k, docs FROM (SELECT source, k, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, source, {_MARGIN} AS k FROM {_LINES}) WHERE k <> '' GROUP BY source, k)
JOIN (SELECT source, greatest(3, CAST(ceil(count(*) * 0.15) AS BIGINT)) AS least FROM documents GROUP BY source) USING (source) WHERE docs >= least""")
def boilerplate_lines(spark, d):
    """Lines that come in at least three documents of a source and in 15 % of them, whatever numbers they hold."""
    docs = table(spark, d, "documents")
    keyed = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", T.margin_key(F.col("line")).alias("k")).where("k <> ''").distinct()
    least = docs.groupBy("source").agg(F.greatest(F.lit(3), F.ceil(F.count(F.lit(1)) * 0.15)).alias("least"))
    return keyed.groupBy("source", "k").agg(F.count(F.lit(1)).alias("docs")).join(least, "source").where("docs >= least").select("source", "k", "docs")


@query("SELECT page_id, (len(html) - len(replace(html, '<p>', ''))) // 3 AS paragraphs, (len(html) - len(replace(html, '<li>', ''))) // 4 AS items, (len(html) - len(replace(html, '<h1>', ''))) // 4 AS headings FROM pages")
def page_blocks(spark, d):
    n = lambda tag: F.regexp_count("html", F.lit(f"<{tag}>")).cast("long")
    return table(spark, d, "pages").select("page_id", n("p").alias("paragraphs"), n("li").alias("items"), n("h1").alias("headings"))


@query("""SELECT source, doc_id, lang, CAST(sum(new) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS run FROM (
  SELECT source, doc_id, lang, CASE WHEN lag(lang) OVER (PARTITION BY source ORDER BY doc_id) IS NOT DISTINCT FROM lang AND row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 THEN 0 ELSE 1 END AS new FROM documents)""")
def section_runs(spark, d):
    """A source's documents in order, numbered by runs of one language."""
    return structure.section_runs(table(spark, d, "documents").select("source", "doc_id", "lang"), "source", "doc_id", "lang")


@query()
def packed_segments(spark, d):
    return structure.segments(table(spark, d, "documents"), "doc_id", prefix_words=6).select("doc_id", "segment_index", "words")


ELEMENTS = [
    (1, 0, "warning", "hot", 1, None), (1, 1, "text", "a b c.", 1, None), (1, 2, "text", "d e.", 1, None), (1, 3, "note", "mind", 1, None), (1, 4, "table", "T", 2, [["h", "i"], ["1", "2"]]),
    (1, 5, "table", "T", 3, [["h", "i"], ["3", "4"]]), (1, 6, "table", "T", 5, [["h", "i"], ["5", "6"]]), (1, 7, "procedure", "1. do", 6, None), (2, 0, "warning", "alone", 1, None),
]


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS BIGINT), 'text', CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), 'hot | mind'), (1, 1, 'table', 2, 3, 3, ''), (1, 2, 'table', 5, 5, 2, ''), (1, 3, 'procedure', 6, 6, 0, '')) AS t(doc, unit, kind, page, end_page, n_rows, notes)")
def evidence_units(spark, d):
    rows = literal(spark, "doc long, pos long, kind string, text string, page long, cells array<array<string>>", ELEMENTS)
    return structure.units(rows).drop("text")


@query(f"WITH {_CHUNKS} SELECT doc_id, kind, k, min(ix) AS first_ix FROM (SELECT doc_id, ix, 'body' AS kind, regexp_replace(lower(substr(text, 1, 20)), '[0-9]+', '#', 'g') AS k FROM chunks UNION ALL SELECT doc_id, ix, 'lead', regexp_replace(lower(regexp_extract(text, '^[^ ]*')), '[0-9]+', '#', 'g') FROM chunks) GROUP BY doc_id, kind, k")
def representations(spark, d):
    """Two short views of each chunk, and of views of a document that differ in numbers alone the first. The whole of X8 and X9 is table_of_representations."""
    chunks = _chunks(spark, d)
    view = lambda name, c: chunks.select("doc_id", "ix", F.lit(name).alias("kind"), F.regexp_replace(F.lower(c), "[0-9]+", "#").alias("k"))
    both = view("body", F.substring("text", 1, 20)).unionByName(view("lead", F.regexp_extract("text", "^[^ ]*", 0)))
    return both.groupBy("doc_id", "kind", "k").agg(F.min("ix").alias("first_ix"))


@query()
def table_of_representations(spark, d):
    """What the units of all pages are found by. A page is one unit: its heading, and the text of its article by paragraphs."""
    inner = F.coalesce(F.regexp_extract("html", r"(?is)<article\b[^>]*>(.*)</article>", 1), F.lit(""))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#x27;"), F.lit("'")), F.lit("&amp;"), F.lit("&")), "[ \t]*\n[ \t]*", "\n"), r"^\s+|\s+$", "")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)</?(?:p|h[1-6]|ul|ol|li)\b[^>]*>", "\n\n"), "<[^>]*>", " ")
    head = r"(?is)<h1\b[^>]*>(.*?)</h1>"
    rows = table(spark, d, "pages").select("page_id", inner.alias("x"))
    section, body = plain(bare(F.regexp_extract("x", head, 1))), plain(bare(F.regexp_replace("x", head, "")))
    units = rows.select(F.col("page_id").alias("doc"), F.lit(0).cast("long").alias("unit"), section.alias("section"), body.alias("text"))
    units = units.withColumns({"kind": T.section_type(F.col("section")), "title": F.lit(None).cast("string"), "headers": F.lit(None).cast("array<string>"), "rows": F.lit(None).cast("array<array<string>>")})
    return structure.representations(units)


@query("""SELECT user_id, min(ts) AS begin, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 60 SECOND OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, g""")
def rate_sessions(spark, d):
    found = requests.rate_sessions(table(spark, d, "events"))
    return found.select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id AS thread, arg_min(event_type, event_id) AS owner, count(*) FILTER (WHERE event_type <> o) AS refused FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events) GROUP BY user_id")
def thread_owner_first(spark, d):
    """The first to claim a thread owns it; how many claims of others were refused. (No time to live: the table's view of it.)"""
    e = table(spark, d, "events")
    owner = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("owner"))
    return e.join(owner, "user_id").groupBy(F.col("user_id").alias("thread"), "owner").agg(F.count_if(F.col("event_type") != F.col("owner")).alias("refused"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def request_dedup(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversation_memory(spark, d):
    return requests.memory(table(spark, d, "conversations"))


@query("SELECT 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def event_frames(spark, d):
    """Events framed as a server sends them."""
    return table(spark, d, "events").select(F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n")).alias("frame"))
