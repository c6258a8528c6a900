"""Queries of page layout, catalogues, request checks and ordered lists, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import blocks
from lectern.plans import sql as S
from lectern.registry import query, table

#: The given documents have no layout. Each line of a document is a block whose place, font and (for some lines) text follow from doc_id and position.
_BLOCKS = r"""blocks AS (SELECT doc_id, source, CAST((pos - 1) // 9 + 1 AS BIGINT) AS page, CAST(pos AS BIGINT) AS pos,
  trim(CASE (doc_id + pos) % 13 WHEN 0 THEN 'Chapter ' || pos WHEN 1 THEN 'How to ' || substr(line, 1, 30) WHEN 2 THEN CAST(pos AS VARCHAR) WHEN 3 THEN CASE WHEN doc_id % 5 = 0 THEN 'Table of contents' ELSE 'Plan' END
    WHEN 4 THEN substr(line, 1, 40) || ' .... ' || pos WHEN 5 THEN '- ' || substr(line, 1, 30) WHEN 6 THEN 'Figure ' || pos || ': ' || substr(line, 1, 150) WHEN 7 THEN 'Field names and values'
    WHEN 8 THEN 'Site manual ' || pos WHEN 9 THEN 'List of tables' WHEN 10 THEN 'Chapter plan ' || pos ELSE substr(line, 1, 200) END, ' ') AS text,
  CAST(8 + (doc_id * 3 + pos * 5) % 8 AS DOUBLE) + 0.5 AS size, (doc_id + pos) % 3 = 0 AS bold, CAST((pos * 83) % 780 AS DOUBLE) AS y0, CAST((pos * 83) % 780 + 15 AS DOUBLE) AS y1, CAST(800 AS DOUBLE) AS height
  FROM (SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)))"""


def _blocks(spark, d):
    lines = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("doc_id", "source", (F.col("at") + 1).cast("long").alias("pos"), "line")
    p, head = F.col("pos").cast("string"), lambda n: F.substring("line", 1, n)
    made = {
        0: F.concat(F.lit("Chapter "), p), 1: F.concat(F.lit("How to "), head(30)), 2: p, 3: F.when(F.col("doc_id") % 5 == 0, "Table of contents").otherwise("Plan"), 4: F.concat(head(40), F.lit(" .... "), p), 5: F.concat(F.lit("- "), head(30)),
        6: F.concat(F.lit("Figure "), p, F.lit(": "), head(150)), 7: F.lit("Field names and values"), 8: F.concat(F.lit("Site manual "), p), 9: F.lit("List of tables"), 10: F.concat(F.lit("Chapter plan "), p),
    }
    kind, text = (F.col("doc_id") + F.col("pos")) % 13, head(200)
    for k, c in made.items():
        text = F.when(kind == k, c).otherwise(text)
    y = ((F.col("pos") * 83) % 780).cast("double")
    size = (8 + (F.col("doc_id") * 3 + F.col("pos") * 5) % 8).cast("double") + 0.5
    return lines.select("doc_id", "source", (F.floor((F.col("pos") - 1) / 9) + 1).alias("page"), "pos", F.trim(text).alias("text"), size.alias("size"), ((F.col("doc_id") + F.col("pos")) % 3 == 0).alias("bold"), y.alias("y0"), (y + 15).alias("y1"), F.lit(800.0).alias("height"))


@query(f"WITH {_BLOCKS} SELECT doc_id, median(size) AS body_size FROM blocks GROUP BY doc_id")
def body_font_size(spark, d):
    return blocks.body_size(_blocks(spark, d))


_TOC = r"regexp_matches(text, '(?i)^.{2,120}?(?:\.{2,}|\s{2,})\s*(?:[A-Z]-)?\d+(?:-\d+)?$')"
_NUMBERED = r"regexp_matches(text, '^.{2,100}\s+(?:[A-Z]-)?\d+(?:-\d+)?$')"


@query(f"""WITH {_BLOCKS}, told AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS r FROM blocks WHERE text <> '')
SELECT doc_id, page, regexp_matches(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE r <= 8), '(?i)\\b(table of contents|contents|index|list of figures|list of tables)\\b')
  OR (count(*) >= 8 AND greatest(count(*) FILTER (WHERE {_TOC}), count(*) FILTER (WHERE {_NUMBERED})) >= 0.6 * count(*)) AS toc FROM told GROUP BY doc_id, page""")
def toc_pages(spark, d):
    return blocks.contents_pages(_blocks(spark, d))


_KEY = rf"regexp_replace(regexp_replace(lower({S.clean('text')}), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')"
_REASONS = rf"""{_BLOCKS}, keyed AS (SELECT *, {_KEY} AS k FROM blocks),
often AS (SELECT doc_id, k FROM keyed JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM blocks GROUP BY doc_id) USING (doc_id) WHERE k <> '' GROUP BY doc_id, k HAVING count(DISTINCT page) >= greatest(3, ceil(any_value(pages) * 0.15))),
reasons AS (SELECT b.*, CASE WHEN y0 >= 704 AND regexp_matches(text, '(?i)^([A-Z]-)?[0-9]+-[0-9]+$|^[ivxlcdm]{{1,12}}$|^[0-9]+$') THEN 'page_number'
  WHEN (doc_id, k) IN (SELECT doc_id, k FROM often) AND y1 <= 96 THEN 'repeated_header' WHEN (doc_id, k) IN (SELECT doc_id, k FROM often) AND y0 >= 704 THEN 'repeated_footer' END AS reason FROM keyed b)"""


@query(f"WITH {_REASONS} SELECT doc_id, pos, reason FROM reasons WHERE reason IS NOT NULL")
def margin_exclusions(spark, d):
    return blocks.margin_reasons(_blocks(spark, d)).where("reason IS NOT NULL").select("doc_id", "pos", "reason")


@query(f"WITH {_REASONS} SELECT source, reason, count(*) AS n FROM (SELECT source, coalesce(reason, CASE WHEN length(text) <= 400 AND regexp_matches(text, '(?i)copyright|©|all rights reserved') THEN 'copyright' END) AS reason FROM reasons) WHERE reason IS NOT NULL GROUP BY source, reason")
def discard_counts(spark, d):
    rows = blocks.margin_reasons(_blocks(spark, d))
    reason = F.coalesce("reason", F.when(T.copyright_notice(F.col("text")), "copyright"))
    return rows.select("source", reason.alias("reason")).where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BLOCKS}, body AS (SELECT doc_id, median(size) AS m FROM blocks GROUP BY doc_id)
SELECT doc_id, pos, text FROM blocks JOIN body USING (doc_id) WHERE length(text) >= 3 AND length(text) <= 160 AND CASE
  WHEN regexp_matches(text, '(?i)^(how to\\b|procedure\\b|to\\s+\\w+)') THEN bold OR size >= greatest(10.5, m * 1.08)
  WHEN regexp_matches(text, '(?i)^(chapter\\s+\\d+|appendix\\s+[A-Z])\\b') THEN true
  WHEN text[1] IN ('•', '-') OR regexp_matches(text, '^\\d+[.)]\\s') OR text[-1] IN ('.', ';', ',') THEN false
  ELSE size >= greatest(11.5, m * 1.18) OR (bold AND size >= greatest(11.0, m * 1.1)) END""")
def heading_blocks(spark, d):
    rows = _blocks(spark, d)
    return rows.join(blocks.body_size(rows), "doc_id").where(blocks.is_heading(F.col("body_size"))).select("doc_id", "pos", "text")


@query(f"""WITH {_BLOCKS}, t AS (SELECT doc_id, pos, text AS title, coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY pos), '') AS header FROM blocks)
SELECT doc_id, pos, CASE WHEN regexp_matches(title || ' ' || header, '(?i)\\b(field|property|parameter|column|button)s?\\b') AND regexp_matches(header, '(?i)\\b(description|definition|meaning|value)s?\\b') THEN 'field_definition' ELSE 'table' END AS class FROM t""")
def table_classes(spark, d):
    after = F.lead("text", 1, "").over(Window.partitionBy("doc_id").orderBy("pos"))
    return _blocks(spark, d).select("doc_id", "pos", blocks.table_class(F.col("text"), after).alias("class"))


@query(f"WITH {_BLOCKS} SELECT doc_id, pos FROM blocks WHERE lower(text) IN ('table of contents', 'contents', 'index', 'list of figures', 'list of tables')")
def noncontent_sections(spark, d):
    return _blocks(spark, d).where(F.col("text").rlike(blocks.CONTENTS)).select("doc_id", "pos")


@query(rf"""WITH {_BLOCKS} SELECT doc_id, pos, CAST(len(string_split_regex(trim(text), '\s+')) AS BIGINT) AS words FROM blocks
WHERE regexp_matches(text, '(?i)^(figure|fig\.|image|illustration|screen(shot)?)\s+([A-Z]?\d[\w.-]*|[ivxlcdm]+)\b') AND len(string_split_regex(trim(text), '\s+')) <= 25""")
def image_captions(spark, d):
    return _blocks(spark, d).where(blocks.is_caption(F.col("text"))).select("doc_id", "pos", F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("words"))


@query(rf"""WITH {_BLOCKS} SELECT doc_id, page, coalesce(arg_max(text, pos) FILTER (WHERE y0 >= 688 AND regexp_matches(text, '(?i)^([A-Z]-)?[0-9]+-[0-9]+$|^[ivxlcdm]{{1,12}}$|^[0-9]+$')), 'Not listed') AS label FROM blocks GROUP BY doc_id, page""")
def printed_labels(spark, d):
    return blocks.printed_labels(_blocks(spark, d))


_RAW = "CASE doc_id % 6 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN '0' WHEN 2 THEN '-' || n_chars WHEN 3 THEN 'iv' WHEN 4 THEN n_chars || '-' END"


@query(f"SELECT doc_id, CASE WHEN try_cast({_RAW} AS BIGINT) > 0 THEN CAST(try_cast({_RAW} AS BIGINT) AS VARCHAR) END AS pdf_page, CASE WHEN coalesce({_RAW}, '') = '' OR suffix({_RAW}, '-') THEN 'Not listed' ELSE {_RAW} END AS printed_page FROM documents")
def safe_pages(spark, d):
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 6
    raw = F.when(k == 0, n).when(k == 1, "0").when(k == 2, F.concat(F.lit("-"), n)).when(k == 3, "iv").when(k == 4, F.concat(n, F.lit("-")))
    page = F.col("raw").try_cast("long")
    rows = table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.when(page > 0, page.cast("string")).alias("pdf_page"), F.when(F.coalesce("raw", F.lit("")).isin("") | F.col("raw").endswith("-"), "Not listed").otherwise(F.col("raw")).alias("printed_page"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 8000 THEN 'too long' WHEN NOT regexp_matches(text, '\S') THEN 'blank' WHEN (doc_id % 4 = 0) <> (doc_id % 6 = 0) THEN 'unpaired ids' WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') THEN 'unknown kind' ELSE 'valid' END AS verdict FROM documents WHERE text IS NOT NULL""")
def request_checks(spark, d):
    """Every text as a request: length, blankness, two ids that come together, and a closed list of kinds."""
    conversation, thread = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")), F.when(F.col("doc_id") % 6 == 0, F.col("doc_id"))
    kinds = [f"src{i}" for i in range(6)]
    verdict = F.when(F.length("text") > 8000, "too long").when(~F.col("text").rlike(r"\S"), "blank").when(conversation.isNull() != thread.isNull(), "unpaired ids").when(~F.col("source").isin(kinds), "unknown kind").otherwise("valid")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", verdict.alias("verdict"))


@query("SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS names, count(DISTINCT source) AS n FROM documents")
def source_names(spark, d):
    names = table(spark, d, "documents").select("source").where("source IS NOT NULL").distinct()
    return names.agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


_PREFERENCES = ("SRC1", " rc2 ", "", "nothing")


@query("SELECT source AS name, count(*) AS docs FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(source), 'rc2') OR contains(lower(source), 'nothing') GROUP BY source")
def name_expansion(spark, d):
    """Sources that hold one of the preferred names; blank preferences say nothing. Names are matched once each, not once a row."""
    asked = [p.strip().lower() for p in _PREFERENCES if p.strip()]
    counted = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("docs"))
    hit = F.lit(False)
    for p in asked:
        hit = hit | F.contains(F.lower("name"), F.lit(p))
    return counted.where(hit)


@query(f"WITH {_BLOCKS} SELECT doc_id, count(pos) AS n FROM documents LEFT JOIN (SELECT doc_id, pos FROM blocks WHERE length(text) > 100) USING (doc_id) GROUP BY doc_id")
def representation_counts(spark, d):
    """How many long blocks each document has, none included."""
    long = _blocks(spark, d).where(F.length("text") > 100).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "documents").select("doc_id").distinct().join(long, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH a AS (SELECT conv_id, list_distinct({S.terms('text', T.CONTENT_STOPWORDS)}) AS t FROM conversations WHERE turn = 0),
o AS (SELECT conv_id, turn, len(list_intersect(t, {S.distinct_terms('text', T.CONTENT_STOPWORDS)})) AS overlap FROM conversations JOIN a USING (conv_id) WHERE turn > 0)
SELECT conv_id, turn, CAST(overlap AS BIGINT) AS overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn) AS rank FROM o WHERE overlap > 0) WHERE rank <= 8""")
def relevant_terms(spark, d):
    """Later turns that share content words with the first, the eight with most of them, earlier ones first among equals."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.content_terms(F.col("text"))).alias("t"))
    asked = turns.where("turn = 0").select("conv_id", F.col("t").alias("a"))
    met = turns.where("turn > 0").join(asked, "conv_id").select("conv_id", "turn", F.size(F.array_intersect("t", "a")).cast("long").alias("overlap")).where("overlap > 0")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("overlap"), "turn"))
    return met.withColumn("rank", rank.cast("long")).where("rank <= 8")


_STRIP = r"trim(regexp_replace(regexp_replace(line, '^\s*([-*]|\d+[.)])\s*', ''), '\s+', ' ', 'g'))"


@query(rf"""WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
p AS (SELECT doc_id, pos, {_STRIP} AS line FROM l), u AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS k FROM p WHERE line <> '')
SELECT doc_id, rank, line FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM u WHERE k = 1) WHERE rank <= 3""")
def plain_lines(spark, d):
    """The first three different lines of each document, without bullets and numbers in front."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^\s*(?:[-*]|\d+[.)])\s*", ""))
    return blocks.first_distinct(lines, ["doc_id"], ["pos"], "line", 3)


@query(r"""SELECT conv_id, CASE WHEN n >= 2 THEN a ELSE regexp_replace(regexp_replace(a, 'cross[- ]manual(\s+(synthesis|view))?', 'supported evidence', 'gi'), 'across\s+(the\s+)?(cited\s+)?manuals', 'from the cited manual', 'gi') END AS answer
FROM (SELECT conv_id, count(DISTINCT role) AS n, 'A Cross-manual view of conversation ' || conv_id || ', as told across the cited manuals.' AS a FROM conversations WHERE turn <> 0 OR conv_id % 2 = 0 GROUP BY conv_id)""")
def label_sanitise(spark, d):
    """Claims to speak for several families go where the evidence is of one."""
    rows = table(spark, d, "conversations").where("turn <> 0 OR conv_id % 2 = 0").groupBy("conv_id").agg(F.countDistinct("role").alias("n"))
    answer = F.concat(F.lit("A Cross-manual view of conversation "), F.col("conv_id").cast("string"), F.lit(", as told across the cited manuals."))
    plain = F.regexp_replace(F.regexp_replace(answer, r"(?i)cross[- ]manual(?:\s+(?:synthesis|view))?", "supported evidence"), r"(?i)across\s+(?:the\s+)?(?:cited\s+)?manuals", "from the cited manual")
    return rows.select("conv_id", F.when(F.col("n") >= 2, answer).otherwise(plain).alias("answer"))


_SCORE = "CASE WHEN event_id % 997 = 0 THEN NULL WHEN event_id % 1009 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 1013 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END"


@query(f"SELECT user_id, count(*) AS expected, count(*) FILTER (WHERE s IS NOT NULL AND isfinite(s)) AS finite, count(*) = count(*) FILTER (WHERE s IS NOT NULL AND isfinite(s)) AS valid FROM (SELECT user_id, {_SCORE} AS s FROM events) GROUP BY user_id")
def finite_scores(spark, d):
    """Whether all scores of a group are there and finite; the events get some that aren't."""
    x = F.col("event_id")
    score = F.when(x % 997 == 0, None).when(x % 1009 == 0, F.lit(float("nan"))).when(x % 1013 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("user_id", score.alias("s"))
    finite = F.count_if(F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") != F.lit(float("inf"))))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("expected"), finite.alias("finite")).withColumn("valid", F.col("expected") == F.col("finite"))


@query("SELECT doc_id, CAST(lim AS BIGINT) AS token_limit, CAST((n_chars + 3) // 4 AS BIGINT) AS estimate, (n_chars + 3) // 4 <= lim AS fits FROM (SELECT doc_id, n_chars, CASE WHEN least(doc_id % 700, 512) - 8 < 16 THEN 16 ELSE least(doc_id % 700, 512) - 8 END AS lim FROM documents)")
def token_limits(spark, d):
    """The smaller of a model's and the configured limit, less a margin of 8 and at least 16, and whether a text's estimate keeps it."""
    limit = F.greatest(F.lit(16), F.least(F.col("doc_id") % 700, F.lit(512)) - 8).cast("long")
    estimate = F.ceil(F.col("n_chars") / 4).cast("long")
    return table(spark, d, "documents").select("doc_id", limit.alias("token_limit"), estimate.alias("estimate"), (estimate <= limit).alias("fits"))


@query(r"""WITH h AS (SELECT regexp_extract(url, '//([^/]*)', 1) AS host, page_id, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\s+', ' ', 'g')) AS section FROM pages),
u AS (SELECT *, row_number() OVER (PARTITION BY host, lower(section) ORDER BY page_id) AS k FROM h WHERE section <> '')
SELECT host, rank, section FROM (SELECT host, section, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rank FROM u WHERE k = 1) WHERE rank <= 8""")
def section_names(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("section"))
    return blocks.first_distinct(rows, ["host"], ["page_id"], "section", 8)


@query(r"""WITH u AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM conversations WHERE role = 'user'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(query) ORDER BY turn) AS k FROM u WHERE query <> '')
SELECT conv_id, rank, query FROM (SELECT conv_id, query, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM k WHERE k = 1) WHERE rank <= 4""")
def aspect_queries(spark, d):
    """At most four different questions of a conversation, in order."""
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return blocks.first_distinct(rows, ["conv_id"], ["turn"], "query", 4)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR trim(source) = '' OR source IS NULL THEN 'chunk-' || doc_id ELSE source END AS evidence_key FROM documents")
def evidence_keys(spark, d):
    evidence = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.trim("source"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(evidence, F.lit("")), F.concat(F.lit("chunk-"), F.col("doc_id").cast("string"))).alias("evidence_key"))


_ASKED = "lower(text || CASE conv_id % 4 WHEN 0 THEN ' Sampling by spec with a Move Transaction' WHEN 1 THEN ' sampling and movement' WHEN 2 THEN ' sampling spec, next workflow' ELSE ' spec' END)"


@query(f"SELECT conv_id, turn, contains(q, 'sampling') AND contains(q, 'spec') AND (contains(q, 'move transaction') OR contains(q, 'movement') OR contains(q, 'next workflow')) AS asked FROM (SELECT conv_id, turn, {_ASKED} AS q FROM conversations)")
def keyword_groups(spark, d):
    """Whether a question has a word of each group. The groups are fixed values."""
    groups = (("sampling",), ("spec",), ("move transaction", "movement", "next workflow"))
    k = F.col("conv_id") % 4
    more = F.when(k == 0, " Sampling by spec with a Move Transaction").when(k == 1, " sampling and movement").when(k == 2, " sampling spec, next workflow").otherwise(" spec")
    q = F.lower(F.concat("text", more))
    asked = F.lit(True)
    for words in groups:
        asked = asked & q.rlike("|".join(words))
    return table(spark, d, "conversations").select("conv_id", "turn", asked.alias("asked"))


@query(r"""SELECT source, CASE WHEN regexp_matches(source, '^src1[0-9]$') THEN 'Second' WHEN contains(source, '3') OR contains(source, '7') THEN 'Third' ELSE source END AS family, count(*) AS docs FROM documents GROUP BY 1, 2""")
def source_families(spark, d):
    """Sources by an ordered list of patterns; one that matches none is its own family."""
    rules = {"^src1[0-9]$": "Second", "[37]": "Third"}
    counted = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    return counted.select("source", blocks.class_by_words(F.col("source"), rules).alias("family"), "docs")


_BUILT_IN = (("Src1", "first"), ("Container", "box"))
_CATALOG = """catalog AS (SELECT lower(term) AS k, arg_min(term, o) AS term, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM (
  SELECT * FROM (VALUES (0, 'Src1', 'first'), (1, 'Container', 'box')) AS b(o, term, alias) UNION ALL SELECT 10 + row_number() OVER (ORDER BY source, lang), source, lang FROM (SELECT DISTINCT source, lang FROM documents)) GROUP BY lower(term))"""


def _catalog(spark, d):
    """Built-in terms first, then those of the table; a term's first spelling stands, aliases come together."""
    own = table(spark, d, "documents").select(F.col("source").alias("term"), F.col("lang").alias("alias")).distinct().withColumn("o", F.lit(1))
    fixed = spark.createDataFrame([(t, a, 0) for t, a in _BUILT_IN], "term string, alias string, o int")
    both = fixed.unionByName(own).groupBy(F.lower("term").alias("k"))
    return both.agg(F.min(F.struct("o", "term"))["term"].alias("term"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


@query(f"WITH {_CATALOG} SELECT term, aliases FROM catalog")
def concept_catalog(spark, d):
    return _catalog(spark, d).select("term", "aliases")


@query(f"WITH {_CATALOG} SELECT doc_id, term, aliases FROM documents JOIN catalog ON k = CASE WHEN doc_id % 2 = 0 THEN lower(source) ELSE 'container' END")
def catalog_lookup(spark, d):
    asked = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise("CONTAINER").alias("asked"))
    return asked.join(_catalog(spark, d), F.lower("asked") == F.col("k")).select("doc_id", "term", "aliases")


@query(f"WITH {_BLOCKS} SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(page) AS BIGINT) AS most_pages, sha256(string_agg(DISTINCT lpad(CAST(doc_id AS VARCHAR), 20, '0'), ',' ORDER BY lpad(CAST(doc_id AS VARCHAR), 20, '0'))) AS ids FROM blocks GROUP BY source")
def manifest_counts(spark, d):
    """What a build of the index holds, by source: counts, and one hash for its ids, by document first so that the hash sees each once."""
    one = _blocks(spark, d).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("b"), F.sum(F.length("text")).alias("c"), F.max("page").alias("p"))
    ids = F.sha2(F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("doc_id").cast("string"), 20, "0"))), ","), 256)
    return one.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("b").alias("blocks"), F.sum("c").cast("long").alias("chars"), F.max("p").cast("long").alias("most_pages"), ids.alias("ids"))
