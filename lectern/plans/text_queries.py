"""Queries over single texts: cleaning, tokens, keys, classes, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans import sql as S
from lectern.registry import query, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _long(c: Column) -> Column:
    return c.cast("long")


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES list of strings and numbers for the oracle."""

    def one(x) -> str:
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"CAST({x} AS BIGINT)" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])', 1)) AS BIGINT) AS n_tokens FROM documents")
def token_count(spark, d):
    return _docs(spark, d).select("doc_id", _long(F.size(T.word_tokens(F.col("text")))).alias("n_tokens"))


@query(f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(lower({S.clean('text')}), '[0-9]+', '#', 'g'), '\s+', ' ', 'g') AS key FROM documents")
def margin_normalize(spark, d):
    return _docs(spark, d).select("doc_id", T.margin_key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, CAST(len({S.tokens('text')}) AS BIGINT) AS len FROM documents")
def doc_lengths(spark, d):
    return _docs(spark, d).select("doc_id", _long(F.size(T.lexical_tokens(F.col("text")))).alias("len"))


@query("SELECT doc_id, length(text) <= 400 AND regexp_matches(text, '(?i)(\\bcopyright\\b|©|all rights reserved|licensed under)') AS notice FROM documents")
def copyright_filter(spark, d):
    return _docs(spark, d).select("doc_id", T.copyright_notice(F.col("text"), "licensed under").alias("notice"))


@query(f"SELECT doc_id, CAST(i AS BIGINT) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents))")
def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", _long(F.col("i") + 1).alias("pos"), "sentence")


@query(f"""
SELECT doc_id, CAST(len({S.terms('text', T.CONTENT_STOPWORDS)}) AS BIGINT) AS n_content,
       CAST(len({S.distinct_terms('text', T.COMPRESSION_STOPWORDS)}) AS BIGINT) AS n_compression,
       CAST(len(list_distinct(list_filter({S.tokens('text')}, lambda t: t NOT IN {S.names(T.STOPWORDS)}))) AS BIGINT) AS n_similarity
FROM documents""")
def term_sets(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", _long(F.size(T.content_terms(x))).alias("n_content"), _long(F.size(T.compression_terms(x))).alias("n_compression"), _long(F.size(T.similarity_terms(x))).alias("n_similarity"))


@query(f"""
SELECT item_id, other_id, round(CASE WHEN m = 0 THEN 0.0 ELSE o / m * CASE WHEN m = 1 THEN 0.7 ELSE 1.0 END END, 9) AS similarity
FROM (SELECT a.item_id, b.item_id AS other_id, CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) AS o, CAST(least(len(a.t), len(b.t)) AS DOUBLE) AS m
      FROM (SELECT item_id, list_distinct(list_filter({S.tokens('text')}, lambda t: t NOT IN {S.names(T.STOPWORDS)})) AS t FROM benchmark) a
      JOIN (SELECT item_id, list_distinct(list_filter({S.tokens('text')}, lambda t: t NOT IN {S.names(T.STOPWORDS)})) AS t FROM benchmark) b ON b.item_id = a.item_id + 1)""")
def token_similarity(spark, d):
    items = table(spark, d, "benchmark").select("item_id", T.similarity_terms(F.col("text")).alias("t"))
    later = items.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other_id"), F.col("t").alias("u"))
    return items.join(later, "item_id").select("item_id", "other_id", F.round(T.term_overlap(F.col("t"), F.col("u")), 9).alias("similarity"))


@query("SELECT doc_id, 'd_' || substr(sha256(CAST(doc_id AS VARCHAR) || ':' || source || ':' || text), 1, 24) AS record_id, sha256(text) AS content_hash FROM documents")
def content_hash_ids(spark, d):
    return _docs(spark, d).select("doc_id", T.record_id("d", F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("record_id"), F.sha2("text", 256).alias("content_hash"))


_CUT = f"{400 - len(T.TRUNCATED) - 1}"
_TRIM = f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, i, sum(length(lines[i]) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS used
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
k AS (SELECT doc_id, count(*) FILTER (WHERE used <= {_CUT}) AS kept FROM e GROUP BY doc_id)
SELECT l.doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
       CASE WHEN length(text) <= 400 THEN text
            ELSE trim(CASE WHEN kept > 0 THEN array_to_string(lines[1:kept], chr(10)) ELSE rtrim(regexp_replace(substr(text, 1, {_CUT}), ' [^ ]*$', '')) END || chr(10) || '{T.TRUNCATED}') END AS trimmed
FROM l JOIN k USING (doc_id)"""


@query(_TRIM)
def token_budget_trim(spark, d):
    return _docs(spark, d).select("doc_id", _long(T.token_estimate(F.col("text"))).alias("tokens"), T.truncate(F.col("text"), 400).alias("trimmed"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS cache_key FROM documents")
def cache_keys(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256).alias("cache_key"))


@query("SELECT item_id, CAST(i AS BIGINT) AS pos, c[i] AS chunk FROM (SELECT item_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '\\S+\\s*') AS c FROM benchmark))")
def stream_chunks(spark, d):
    """Words with the blanks behind them, as an answer is sent."""
    items = table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), F.lit(1))).alias("i", "chunk"))
    return items.select("item_id", _long(F.col("i") + 1).alias("pos"), "chunk")


@query("""
SELECT item_id, CAST(w AS BIGINT) AS part, array_to_string(words[(w * 12 + 1):(w * 12 + 12)], ' ') AS body,
       coalesce(lag(w) OVER (PARTITION BY item_id ORDER BY w), -1) AS previous, coalesce(lead(w) OVER (PARTITION BY item_id ORDER BY w), -1) AS next
FROM (SELECT item_id, words, unnest(range(0, CAST(ceil(len(words) / 12.0) AS BIGINT))) AS w
      FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM benchmark))""")
def word_chunks(spark, d):
    """Slices of twelve words with the numbers of the slices beside them, -1 at the ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("item_id").orderBy("part")
    items = table(spark, d, "benchmark").select("item_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("words"))
    cut = items.where(F.size("words") > 0).select("item_id", "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 12).cast("int"))).alias("p"))
    rows = cut.select("item_id", _long(F.col("p")).alias("part"), F.array_join(F.slice("words", F.col("p") * 12 + 1, F.lit(12)), " ").alias("body"))
    return rows.withColumn("previous", F.coalesce(F.lag("part").over(w), F.lit(-1))).withColumn("next", F.coalesce(F.lead("part").over(w), F.lit(-1)))


HEADINGS = [
    (1, "Defining Modelling Rules", None), (2, "How to Define a Role", None), (3, "What Is a Container", None), (4, "Field Descriptions", None),
    (5, "Before You Begin", None), (6, "Event Steps", None), (7, "Table of Contents", None), (8, "Straße  and   Roles", None), (9, "Chapter 3", None),
    (10, "NOTE: keep the cover closed", None), (11, "Warning. Hot surface", None), (12, "Figure 3-1: Overview of the line", None), (13, "1. Open\n2. Close", None), (14, "Tell me about defining patterns", None), (15, "please explain what is a spare parts", None),
]
_H = values([(i, h) for i, h, _ in HEADINGS], "id, heading")


def _headings(spark: SparkSession) -> DataFrame:
    return literal(spark, "id long, heading string", [(i, h) for i, h, _ in HEADINGS])


def _singular_sql(k: str, plurals) -> str:
    return f"CASE WHEN regexp_extract({k}, '[^ ]*$') IN {S.names(plurals)} THEN substr({k}, 1, length({k}) - 1) END"


_KEY = S.lookup_key(S.clean("heading"))
_SHORT = "CASE WHEN k LIKE 'defining %' THEN regexp_replace(k, '^defining ', '') END"


@query(f"""
SELECT id, k AS normalized, array_to_string(list_sort(list_distinct(list_filter([k, s, {_singular_sql('k', T.INDEX_PLURALS)}, {_singular_sql('s', T.INDEX_PLURALS)}], lambda x: x IS NOT NULL AND x <> ''))), '|') AS alternate,
       array_to_string(list_sort(list_distinct(list_filter([k, {_singular_sql('k', T.LOOKUP_PLURALS)}], lambda x: x IS NOT NULL AND x <> ''))), '|') AS lookup,
       array_to_string(list_sort(list_distinct(list_filter([k, b, CASE WHEN b LIKE 'defining %' THEN regexp_replace(b, '^defining ', '') END], lambda x: x IS NOT NULL AND x <> ''))), '|') AS asked
FROM (SELECT id, k, {_SHORT} AS s, trim(regexp_replace(k, '^(?:(?:please|tell me about|tell me|explain|describe|define|defining|what is|what are)\\s+)+', '')) AS b FROM (SELECT id, {_KEY} AS k FROM {_H}))""")
def heading_keys(spark, d):
    h = F.col("heading")
    return _headings(spark).select("id", T.heading_key(h).alias("normalized"), F.array_join(T.alternate_keys(h), "|").alias("alternate"), F.array_join(T.lookup_keys(h), "|").alias("lookup"), F.array_join(T.heading_query_keys(h), "|").alias("asked"))


@query(f"""
SELECT id,
  CASE WHEN regexp_matches(heading, '(?i)^(?:how to\\b|procedure\\b|to\\s+\\w+)') THEN 'procedure'
       WHEN regexp_matches(heading, '(?i)\\b(?:prerequisites?|before you (?:begin|start)|requirements?)\\b') THEN 'prerequisite'
       WHEN regexp_matches(heading, '(?i)\\b(?:field|property|parameter|column|button)s?\\b') AND regexp_matches(heading, '(?i)\\b(?:description|definition|meaning|value)s?\\b') THEN 'field_definition'
       WHEN regexp_matches(heading, '(?i)^(?:what is\\b|definitions?\\b|.+\\bdefinitions?\\b)') THEN 'definition' ELSE 'concept' END AS section_type,
  CASE WHEN regexp_matches(heading, '(?i)^(?:warning|caution|danger)\\s*[:.]?\\s*') THEN 'warning'
       WHEN regexp_matches(heading, '(?i)^(?:note|important)\\s*[:.]?\\s*') THEN 'note'
       WHEN regexp_matches(heading, '^1[.)]\\s+[^\\n]*\\n\\s*2[.)]\\s+') THEN 'procedure' ELSE 'text' END AS block_type,
  regexp_matches(heading, '(?i)^(?:table of )?contents$|^index$|^list of (?:figures|tables)$') AS noncontent,
  regexp_matches(heading, '(?i)^(?:figure|fig\\.|image|illustration|screen(?:shot)?)\\s+(?:[A-Z]?\\d[\\w.-]*|[ivxlcdm]+)\\b\\s*[:.-]?') AND len(string_split(heading, ' ')) <= 25 AS image_caption,
  regexp_matches(heading, '(?i)^(?:chapter\\s+\\d+|appendix\\s+[A-Z])\\b') AS chapter
FROM {_H}""")
def heading_classes(spark, d):
    h = F.col("heading")
    return _headings(spark).select(
        "id", T.section_type(h).alias("section_type"), T.block_type(h, F.lit("text")).alias("block_type"),
        T.is_match(h, r"^(?:table of )?contents$|^index$|^list of (?:figures|tables)$").alias("noncontent"),
        (T.is_match(h, r"^(?:figure|fig\.|image|illustration|screen(?:shot)?)\s+(?:[A-Z]?\d[\w.-]*|[ivxlcdm]+)\b\s*[:.-]?") & (F.size(F.split(h, " ")) <= 25)).alias("image_caption"),
        T.is_match(h, r"^(?:chapter\s+\d+|appendix\s+[A-Z])\b").alias("chapter"),
    )


LINES = [(1, "Overview .......... 12"), (2, "Roles and rights   3-4"), (3, "iv"), (4, "A-12-3"), (5, "The end."), (6, "Setup 14"), (7, "77"), (8, "Index entry....A-9")]
_L = values(LINES, "id, line")


@query(rf"""
SELECT id, {S.clean('line')} AS cleaned, regexp_matches(line, '(?i)^.{{2,120}}?(?:\.{{2,}}|\s{{2,}})\s*(?:[A-Z]-)?\d+(?:-\d+)?$') AS toc,
       regexp_matches(line, '^.{{2,100}}\s+(?:[A-Z]-)?\d+(?:-\d+)?$') AS numbered, regexp_matches(line, '(?i)^(?:[A-Z]-)?\d+-\d+$|^[ivxlcdm]{{1,12}}$|^\d+$') AS page_label
FROM {_L}""")
def toc_lines(spark, d):
    x = F.col("line")
    return literal(spark, "id long, line string", LINES).select("id", T.clean(x).alias("cleaned"), T.toc_line(x).alias("toc"), T.numbered_line(x).alias("numbered"), T.page_label(x).alias("page_label"))


ANSWERS = [
    (1, "A role has rights [S1, S3]. See 【S2】.", 3), (2, "Nothing cited.", 2), (3, "First [S2] then [S9] and [S2].", 4), (4, "Both [s1; S2] and [S4]", 3), (5, "【S1, S2】 [S0]", 2),
]
_A = values(ANSWERS, "id, answer, sources")
_NORMAL = r"""array_to_string(list_transform(string_split(regexp_replace(regexp_replace(answer, '(?i)【\s*(S\d+(?:\s*[,;]\s*S\d+)*)\s*】', '[\1]', 'g'), '(?i)(\[S\d+(?:\s*[,;]\s*S\d+)+\])', chr(1) || '\1' || chr(1), 'g'), chr(1)),
  lambda p: CASE WHEN regexp_matches(p, '(?i)^\[S\d+(?:\s*[,;]\s*S\d+)+\]$') THEN array_to_string(list_transform(regexp_extract_all(p, '([Ss]\d+)', 1), lambda s: '[' || upper(s) || ']'), ' ') ELSE p END), '')"""


@query(f"SELECT id, {_NORMAL} AS answer FROM {_A}")
def citation_normalize(spark, d):
    return literal(spark, "id long, answer string, sources long", ANSWERS).select("id", T.normalize_citations(F.col("answer")).alias("answer"))


@query(rf"""
SELECT id, array_to_string(list_filter(c, lambda n: n BETWEEN 1 AND sources), ',') AS cited, len(c) > 0 AND len(list_filter(c, lambda n: NOT n BETWEEN 1 AND sources)) = 0 AS grounded
FROM (SELECT id, sources, list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(a, '\[S(\d+)\]', 1), lambda x: CAST(x AS BIGINT)))), lambda x: x) AS c FROM (SELECT id, sources, {_NORMAL} AS a FROM {_A}))""")
def citation_validate(spark, d):
    """Cited source numbers in range, and whether an answer is grounded: it cites, and cites nothing else."""
    rows = literal(spark, "id long, answer string, sources long", ANSWERS).withColumn("a", T.normalize_citations(F.col("answer")))
    cited = F.array_sort(T.citation_numbers(F.col("a"), F.col("sources")))
    every = F.array_distinct(T.citation_numbers(F.regexp_replace("a", r"\[S0\]", "[S1000000]"), F.lit(1_000_000)))
    return rows.select("id", F.array_join(F.transform(cited, lambda n: n.cast("string")), ",").alias("cited"), ((F.size(every) > 0) & (F.size(every) == F.size(cited))).alias("grounded"))


@query(rf"""
SELECT id, array_to_string(list_filter(string_split(regexp_replace({_NORMAL}, '(\[S\d+\])', chr(1) || '\1' || chr(1), 'g'), chr(1)),
  lambda p: regexp_extract(p, '^\[S(\d+)\]$', 1) = '' OR coalesce(TRY_CAST(regexp_extract(p, '^\[S(\d+)\]$', 1) AS BIGINT) BETWEEN 1 AND sources, false)), '') AS answer FROM {_A}""")
def citation_clean(spark, d):
    return literal(spark, "id long, answer string, sources long", ANSWERS).select("id", T.drop_invalid_citations(T.normalize_citations(F.col("answer")), F.col("sources")).alias("answer"))


PROCEDURES = [(1, "Preface\n1. Open the door\nslowly\n2) Step in\n3. \nClose it", "x"), (2, "No steps here", "x"), (3, "10. Tenth\n11. Eleventh", "x")]
STEP_ROWS = [(1, 1, "1. Open the door slowly"), (1, 2, "2) Step in"), (1, 3, "3. Close it"), (3, 1, "10. Tenth"), (3, 2, "11. Eleventh")]


@query(rf"""
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY g) AS BIGINT) AS pos, step FROM (
  SELECT id, g, string_agg(line, ' ' ORDER BY i) AS step FROM (
    SELECT id, i, line, sum(CASE WHEN regexp_matches(line, '^(\d{{1,3}})[.)](\s+|$)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g
    FROM (SELECT id, i, trim(l[i]) AS line FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, string_split(body, chr(10)) AS l FROM {values(PROCEDURES, 'id, body, x')})))
    WHERE line <> '') WHERE g > 0 GROUP BY id, g)""")
def procedure_steps(spark, d):
    rows = literal(spark, "id long, body string, x string", PROCEDURES)
    return rows.select("id", F.posexplode(T.procedure_steps(F.col("body"))).alias("i", "step")).select("id", _long(F.col("i") + 1).alias("pos"), "step")


TABLES = [(1, "Fields", [["Name", "Meaning"], ["a|b", "first\nsecond"], ["c"]])]
_TABLE = "### Fields\\n| Name | Meaning |\\n| --- | --- |\\n| a\\\\|b | first<br>second |\\n| c |  |"


@query("SELECT CAST(1 AS BIGINT) AS id, '### Fields' || chr(10) || '| Name | Meaning |' || chr(10) || '| --- | --- |' || chr(10) || '| a\\|b | first<br>second |' || chr(10) || '| c |  |' AS rendered")
def markdown_table(spark, d):
    return literal(spark, "id long, title string, cells array<array<string>>", TABLES).select("id", T.markdown_table(F.col("title"), F.col("cells")).alias("rendered"))


ACRONYMS = [(1, "The Configurable Logic Flow (CLF) and a CDO (configurable data object) meet."), (2, "None here"), (3, "CLF (a flow) or Data Model (DM)")]


@query(r"""
SELECT id, array_to_string(list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(x, '(\b[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z][A-Za-z0-9-]*){1,7}\s+\([A-Z][A-Z0-9]{1,9}\))', 1), lambda m: regexp_extract(m, '\(([A-Z][A-Z0-9]{1,9})\)$', 1) || ': ' || trim(regexp_replace(m, '\s+\([A-Z][A-Z0-9]{1,9}\)$', ''))),
  list_transform(regexp_extract_all(x, '(\b[A-Z][A-Z0-9]{1,9}\s+\([A-Za-z][^()\n]{2,80}\))', 1), lambda m: regexp_extract(m, '^([A-Z][A-Z0-9]{1,9})', 1) || ': ' || regexp_extract(m, '\((.*)\)$', 1))))), '|') AS pairs
FROM """ + values(ACRONYMS, "id, x"))
def acronym_aliases(spark, d):
    return literal(spark, "id long, x string", ACRONYMS).select("id", F.array_join(T.acronym_pairs(F.col("x")), "|").alias("pairs"))


PATHS = [(1, "Guide", "Intro", "Intro", None), (2, "Guide", "Guide", "Roles", "Rights"), (3, "", "A", "A", "A")]


@query(f"""
SELECT id, array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: i = 1 OR p[i] <> p[i - 1]), lambda i: p[i]), ' / ') AS path
FROM (SELECT id, list_filter([coalesce(a, ''), coalesce(b, ''), coalesce(c, ''), coalesce(e, '')], lambda x: x <> '') AS p FROM {values(PATHS, 'id, a, b, c, e')})""")
def heading_path(spark, d):
    rows = literal(spark, "id long, a string, b string, c string, e string", PATHS)
    return rows.select("id", F.array_join(T.heading_path(*[F.col(c) for c in "abce"]), " / ").alias("path"))


GRAPHS = [(1, 'digraph G { a [label="x [S1]"]; a -> b; }', True), (2, "digraph G { a [label=(x]; }", False), (3, 'a "unclosed', False), (4, r'{"a \" ) b"}', True), (5, "", True), (6, "][", False)]


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), true), (2, false), (3, false), (4, true), (5, true), (6, false)) AS t(id, balanced)")
def balanced_delimiters(spark, d):
    return literal(spark, "id long, dot string, expected boolean", GRAPHS).select("id", T.balanced(F.col("dot")).alias("balanced"))


THOUGHTS = [(1, "<think>hmm</think> The answer."), (2, "Plain"), (3, "a</think>b</think> c ")]


@query(f"SELECT id, trim(string_split(x, '</think>')[-1]) AS answer FROM {values(THOUGHTS, 'id, x')}")
def reasoning_strip(spark, d):
    return literal(spark, "id long, x string", THOUGHTS).select("id", F.trim(F.element_at(F.split("x", "</think>"), -1)).alias("answer"))
