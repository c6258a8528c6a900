"""Rules of page layout over a relation of text blocks: doc_id, page, pos, text, size, bold, y0, y1, height."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Shares of the page's height, font sizes and lengths that the rules go by.
TOP, BOTTOM, LABEL_ZONE = 0.12, 0.88, 0.86
BODY_SIZE = 10.0
CONTENTS = r"(?i)^(?:table of )?contents$|^index$|^list of (?:figures|tables)$"
CONTENTS_WORDS = r"(?i)\b(?:table of contents|contents|index|list of figures|list of tables)\b"
CAPTION = r"(?i)^(?:figure|fig\.|image|illustration|screen(?:shot)?)\s+(?:[A-Z]?\d[\w.-]*|[ivxlcdm]+)\b\s*[:.-]?"
CHAPTER = r"(?i)^(?:chapter\s+\d+|appendix\s+[A-Z])\b"
PROCEDURE = r"(?i)^(?:how to\b|procedure\b|to\s+\w+)"
FIELD, DESCRIPTION = r"(?i)\b(?:field|property|parameter|column|button)s?\b", r"(?i)\b(?:description|definition|meaning|value)s?\b"


def body_size(blocks: DataFrame) -> DataFrame:
    """doc_id, body_size: the exact median of its blocks' sizes."""
    return blocks.groupBy("doc_id").agg(F.coalesce(F.median("size"), F.lit(BODY_SIZE)).alias("body_size"))


def contents_pages(blocks: DataFrame) -> DataFrame:
    """doc_id, page, toc: a heading of contents among the first eight lines, or eight lines and more of which 60 % end in a page number.

    A page's lines are gathered in one row; pages are bounded by their size on paper.
    """
    line = F.col("text")
    of_page = blocks.where("text <> ''").groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("lines"), F.count_if(T.toc_line(line)).alias("led"), F.count_if(T.numbered_line(line)).alias("numbered"), F.count(F.lit(1)).alias("n")
    )
    head = F.array_join(F.transform(F.slice("lines", 1, 8), lambda x: x["text"]), " ")
    dense = (F.col("n") >= 8) & (F.greatest("led", "numbered") / F.col("n") >= 0.6)
    return of_page.select("doc_id", "page", (head.rlike(CONTENTS_WORDS) | dense).alias("toc"))


def margin_reasons(blocks: DataFrame) -> DataFrame:
    """blocks with reason: page_number, repeated_header or repeated_footer, else null. A text repeats when enough pages of its document have it.

    The repeated keys are few a document; they join on document and key.
    """
    keyed = blocks.withColumn("key", T.margin_key(F.col("text")))
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    often = keyed.where("key <> ''").groupBy("doc_id", "key").agg(F.countDistinct("page").alias("n")).join(pages, "doc_id")
    often = often.where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.15))).select("doc_id", "key", F.lit(True).alias("often"))
    top, bottom = F.col("y1") <= F.col("height") * TOP, F.col("y0") >= F.col("height") * BOTTOM
    reason = F.when(bottom & T.page_label(F.col("text")), "page_number").when(F.col("often") & top, "repeated_header").when(F.col("often") & bottom, "repeated_footer")
    return keyed.join(often, ["doc_id", "key"], "left").withColumn("reason", reason).drop("key", "often")


def is_heading(body: Column) -> Column:
    """Whether a block of one line is a heading, given its document's body size."""
    x, size, bold = F.col("text"), F.col("size"), F.col("bold")
    listed = x.rlike(r"^(?:[•-]|\d+[.)]\s)") | x.rlike(r"[.;,]$")
    large = (size >= F.greatest(F.lit(11.5), body * 1.18)) | (bold & (size >= F.greatest(F.lit(11.0), body * 1.1)))
    rule = F.when(x.rlike(PROCEDURE), bold | (size >= F.greatest(F.lit(10.5), body * 1.08))).when(x.rlike(CHAPTER), True).when(listed, False).otherwise(large)
    return F.length(x).between(3, 160) & rule


def table_class(title: Column, header: Column) -> Column:
    return F.when(F.concat_ws(" ", title, header).rlike(FIELD) & header.rlike(DESCRIPTION), "field_definition").otherwise("table")


def is_caption(x: Column) -> Column:
    """A caption that stands for an image alone: at most 25 words."""
    return x.rlike(CAPTION) & (F.size(F.split(F.trim(x), r"\s+")) <= 25)


def printed_labels(blocks: DataFrame) -> DataFrame:
    """doc_id, page, label: the last page label in the zone at the page's foot; "Not listed" where there is none or it ends in a dash."""
    found = F.when((F.col("y0") >= F.col("height") * LABEL_ZONE) & T.page_label(F.col("text")), F.struct("pos", "text"))
    label = F.max(found)["text"]
    return blocks.groupBy("doc_id", "page").agg(F.when(label.isNull() | label.endswith("-"), "Not listed").otherwise(label).alias("label"))


def class_by_words(x: Column, rules: Mapping[str, str]) -> Column:
    """The name of the first pattern that x matches; x itself where none does."""
    out = F
    for pattern, name in rules.items():
        out = out.when(x.rlike(pattern), name)
    return out.otherwise(x)


def first_distinct(rows: DataFrame, keys: list[str], order: list[str], value: str, most: int | None = None) -> DataFrame:
    """keys, rank, value: the first row of each value (case and white space aside) in order, numbered; at most so many."""
    plain = F.trim(F.regexp_replace(value, r"\s+", " "))
    told = rows.select(*keys, *order, plain.alias(value)).where(F.col(value) != "")
    once = told.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, F.lower(value)).orderBy(*order))).where("__r = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return (ranked.where(F.col("rank") <= most) if most else ranked).select(*keys, "rank", value)
