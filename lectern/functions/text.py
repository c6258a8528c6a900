"""Text functions as Column expressions: cleaning, tokens, keys, classes and citations.

All of them stay inside the JVM. Null in gives null out unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
STOPWORDS = ("a", "an", "and", "are", "for", "how", "in", "is", "of", "the", "to", "what", "with")
CONTENT_STOPWORDS = ("and", "the", "with", "from", "that", "this")
COMPRESSION_STOPWORDS = ("and", "are", "for", "from", "the", "this", "what", "with")
INDEX_PLURALS = ("rules", "fields", "models", "controls", "permissions", "roles", "resources", "containers", "patterns", "events", "steps")
LOOKUP_PLURALS = (*INDEX_PLURALS, "parts")
ASK_PHRASES = r"^(?:(?:please|tell me about|tell me|explain|describe|define|defining|what is|what are)\s+)+"
CONDITION_WORDS = r"(?i)\b(?:after|before|except|if|only|required|unless|until|warning|when)\b"
TRUNCATED = "[Evidence truncated at a line boundary.]"


def fold(text: Column) -> Column:
    """Lower case with the one folding of ß that lower() leaves out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def clean(text: Column) -> Column:
    """No-break spaces to spaces, no zero-width spaces, dot leaders before a last page number to a space, blanks and empty lines collapsed."""
    x = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    x = F.regexp_replace(x, r"\.{4,}(\s*([A-Z]-)?[0-9]+(-[0-9]+)?\s*)$", " $1")
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def margin_key(text: Column) -> Column:
    """Key under which margin lines that differ in numbers alone are equal."""
    return F.regexp_replace(F.regexp_replace(F.lower(clean(text)), "[0-9]+", "#"), r"\s+", " ")


def word_tokens(text: Column) -> Column:
    """Words, and every other visible character on its own."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))


def lexical_tokens(text: Column) -> Column:
    """Runs of a-z, 0-9 and underscore in folded text: the terms of the lexical index."""
    return F.regexp_extract_all(fold(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def terms(text: Column, stop: Sequence[str], longer_than: int = 2) -> Column:
    return F.filter(lexical_tokens(text), lambda t: (F.length(t) > longer_than) & ~t.isin(*stop))


def content_terms(text: Column) -> Column:
    return terms(text, CONTENT_STOPWORDS)


def compression_terms(text: Column) -> Column:
    return F.array_distinct(terms(text, COMPRESSION_STOPWORDS))


def similarity_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(lexical_tokens(text), lambda t: ~t.isin(*STOPWORDS)))


def term_overlap(left: Column, right: Column) -> Column:
    """Overlap of two sets of terms over the smaller one, 0.7 of it when that has one term; 0 when one is empty."""
    least = F.least(F.size(left), F.size(right))
    share = F.size(F.array_intersect(left, right)) / least
    return F.when(least == 0, F.lit(0.0)).otherwise(share * F.when(least == 1, 0.7).otherwise(1.0))


def lookup_key(text: Column) -> Column:
    x = F.replace(fold(text), F.lit("modelling"), F.lit("modeling"))
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def heading_key(text: Column) -> Column:
    return lookup_key(clean(text))


def _singular(key: Column, plurals: Sequence[str]) -> Column:
    return F.when(F.element_at(F.split(key, " "), -1).isin(*plurals), F.substring(key, F.lit(1), F.length(key) - 1))


def alternate_keys(text: Column) -> Column:
    """The heading's key, without a leading "defining", and both with a listed plural made singular; sorted."""
    key = heading_key(text)
    short = F.when(key.startswith("defining "), F.regexp_replace(key, "^defining ", ""))
    made = F.array(key, short, _singular(key, INDEX_PLURALS), _singular(short, INDEX_PLURALS))
    return F.array_sort(F.array_distinct(F.filter(made, lambda k: k.isNotNull() & (k != ""))))


def lookup_keys(text: Column) -> Column:
    key = lookup_key(text)
    return F.array_sort(F.array_distinct(F.filter(F.array(key, _singular(key, LOOKUP_PLURALS)), lambda k: k.isNotNull() & (k != ""))))


def heading_query_keys(text: Column) -> Column:
    """A question's key, the same without the phrases that ask, and that without "defining"."""
    key = lookup_key(text)
    bare = F.trim(F.regexp_replace(key, ASK_PHRASES, ""))
    short = F.when(bare.startswith("defining "), F.regexp_replace(bare, "^defining ", ""))
    return F.array_sort(F.array_distinct(F.filter(F.array(key, bare, short), lambda k: k.isNotNull() & (k != ""))))


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\n{2,}", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def record_id(prefix: str, *seed: Column) -> Column:
    """prefix_ and the first 24 hex digits of the SHA-256 of the seeds, joined by colons."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(":", *seed), 256), 1, 24))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def truncate(text: Column, limit: int) -> Column:
    """Whole lines up to limit characters with a marker; a first line that is too long is cut at a blank."""
    room = limit - len(TRUNCATED) - 1
    step = lambda a, line: F.when(a["done"] | (a["used"] + F.length(line) + F.when(a["n"] > 0, 1).otherwise(0) > room), F.struct(a["used"].alias("used"), a["n"].alias("n"), F.lit(True).alias("done"))).otherwise(
        F.struct((a["used"] + F.length(line) + F.when(a["n"] > 0, 1).otherwise(0)).alias("used"), (a["n"] + 1).alias("n"), F.lit(False).alias("done"))
    )
    lines = F.split(text, "\n")
    kept = F.aggregate(lines, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("done")), step, lambda a: a["n"])
    head = F.rtrim(F.regexp_replace(F.substring(text, 1, room), r" [^ ]*$", ""))
    cut = F.when(kept > 0, F.array_join(F.slice(lines, 1, F.greatest(kept, F.lit(1))), "\n")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.trim(F.concat(cut, F.lit("\n" + TRUNCATED))))


def is_match(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def section_type(heading: Column) -> Column:
    return (
        F.when(is_match(heading, r"^(?:how to\b|procedure\b|to\s+\w+)"), "procedure")
        .when(is_match(heading, r"\b(?:prerequisites?|before you (?:begin|start)|requirements?)\b"), "prerequisite")
        .when(is_match(heading, r"\b(?:field|property|parameter|column|button)s?\b") & is_match(heading, r"\b(?:description|definition|meaning|value)s?\b"), "field_definition")
        .when(is_match(heading, r"^(?:what is\b|definitions?\b|.+\bdefinitions?\b)"), "definition")
        .otherwise("concept")
    )


def block_type(text: Column, active: Column) -> Column:
    steps = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\d{1,3})[.)]\s+"), F.lit(1))
    starts = F.transform(F.slice(steps, 1, 2), lambda s: s.cast("int")) == F.array(F.lit(1), F.lit(2))
    return F.when(is_match(text, r"^(?:warning|caution|danger)\s*[:.]?\s*"), "warning").when(is_match(text, r"^(?:note|important)\s*[:.]?\s*"), "note").when(starts, "procedure").otherwise(active)


def copyright_notice(text: Column, names: str = "") -> Column:
    return (F.length(text) <= 400) & is_match(text, r"(?:\bcopyright\b|©|all rights reserved" + (f"|{names}" if names else "") + ")")


def toc_line(line: Column) -> Column:
    return line.rlike(r"(?i)^.{2,120}?(?:\.{2,}|\s{2,})\s*(?:[A-Z]-)?\d+(?:-\d+)?$")


def numbered_line(line: Column) -> Column:
    return line.rlike(r"^.{2,100}\s+(?:[A-Z]-)?\d+(?:-\d+)?$")


def page_label(line: Column) -> Column:
    return line.rlike(r"(?i)^(?:[A-Z]-)?\d+-\d+$|^[ivxlcdm]{1,12}$|^\d+$")


def normalize_citations(answer: Column) -> Column:
    """【S1, S2】 and [S1; S2] become [S1] [S2]."""
    plain = F.regexp_replace(answer, r"(?i)【\s*(S\d+(?:\s*[,;]\s*S\d+)*)\s*】", "[$1]")
    marked = F.regexp_replace(plain, r"(?i)(\[S\d+(?:\s*[,;]\s*S\d+)+\])", "\u0001$1\u0001")
    split = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"([Ss]\d+)"), F.lit(1)), lambda s: F.concat(F.lit("["), F.upper(s), F.lit("]"))), " ")
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.when(p.rlike(r"(?i)^\[S\d+(?:\s*[,;]\s*S\d+)+\]$"), split(p)).otherwise(p))
    return F.array_join(parts, "")


def citation_numbers(answer: Column, sources: Column) -> Column:
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda n: n.cast("long"))
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= sources)))


def drop_invalid_citations(answer: Column, sources: Column) -> Column:
    parts = F.split(F.regexp_replace(answer, r"(\[S\d+\])", "\u0001$1\u0001"), "\u0001")
    number = lambda p: F.regexp_extract(p, r"^\[S(\d+)\]$", 1)
    return F.array_join(F.filter(parts, lambda p: (number(p) == "") | F.coalesce(number(p).try_cast("long").between(1, sources), F.lit(False))), "")


def acronym_pairs(text: Column) -> Column:
    """"acronym: meaning" of both "Long Form (LF)" and "LF (long form)", sorted."""
    long_first = r"\b([A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z][A-Za-z0-9-]*){1,7})\s+\(([A-Z][A-Z0-9]{1,9})\)"
    short_first = r"\b([A-Z][A-Z0-9]{1,9})\s+\(([A-Za-z][^()\n]{2,80})\)"
    take = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    one = F.zip_with(take(long_first, 2), take(long_first, 1), lambda a, m: F.concat(a, F.lit(": "), clean(m)))
    two = F.zip_with(take(short_first, 1), take(short_first, 2), lambda a, m: F.concat(a, F.lit(": "), clean(m)))
    return F.array_sort(F.array_distinct(F.concat(one, two)))


def markdown_table(title: Column, rows: Column) -> Column:
    """A table of an array of rows; short rows are padded, pipes escaped, line breaks kept as <br>."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.array(F.concat(F.lit("### "), title), F.get(lines, F.lit(0)), rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")


def heading_path(*parts: Column) -> Column:
    """The parts that aren't empty, without one that repeats the one before."""
    kept = F.filter(F.array(*[clean(p) for p in parts]), lambda p: p != "")
    return F.filter(kept, lambda p, i: (i == 0) | (p != F.get(kept, i - 1)))


def procedure_steps(text: Column) -> Column:
    """Numbered steps; a line without a number goes on with the step before; text before the first step is left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    is_step = lambda s: s.rlike(r"^(\d{1,3})[.)](\s+|$)")
    fold_in = lambda acc, s: F.when(is_step(s), F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), s)))).otherwise(acc)
    return F.aggregate(lines, F.array().cast("array<string>"), fold_in)


def balanced(text: Column) -> Column:
    """Whether (), [] and {} nest rightly outside double quotes; a backslash in quotes hides the next character."""
    pairs = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])
    state = lambda stack, quoted, escaped, ok: F.struct(stack.alias("s"), quoted.alias("q"), escaped.alias("e"), ok.alias("ok"))
    no, yes = F.lit(False), F.lit(True)

    def step(a, c):
        inside = F.when(a["e"], state(a["s"], yes, no, a["ok"])).when(c == "\\", state(a["s"], yes, yes, a["ok"])).when(c == '"', state(a["s"], no, no, a["ok"])).otherwise(state(a["s"], yes, no, a["ok"]))
        opened = state(F.concat(a["s"], F.array(c)), no, no, a["ok"])
        fits = (F.size(a["s"]) > 0) & (F.try_element_at(a["s"], F.lit(-1)) == F.try_element_at(pairs, c))
        closed = state(F.slice(a["s"], 1, F.greatest(F.size(a["s"]) - 1, F.lit(0))), no, no, a["ok"] & F.coalesce(fits, no))
        return F.when(a["q"], inside).when(c == '"', state(a["s"], yes, no, a["ok"])).when(c.isin("(", "[", "{"), opened).when(c.isin(")", "]", "}"), closed).otherwise(a)

    return F.aggregate(F.split(text, ""), state(F.array().cast("array<string>"), no, no, yes), step, lambda a: a["ok"] & ~a["q"] & (F.size(a["s"]) == 0))
