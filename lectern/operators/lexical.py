"""The lexical index and BM25: postings, statistics and top lists for many questions at once.

The index has one row for each chunk: its length and its terms with their counts,
counted inside the row, so that building it moves nothing. It is written once for the
files it was made of and read again by every query of the session. A search brings
the questions to the chunks: each task scores its chunks against a block of
questions and keeps its own best k, so that what is shuffled is k rows for each
question and task, however often a term comes.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources import files

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Digits that a score is rounded to before it is ranked, so that ties don't hang on the order of a sum.
DIGITS = 6
#: Pairs of question and term that go to the executors at once; more go in blocks. Questions and chunks that are multiplied together.
ASKED, QUESTIONS, CHUNKS = 1_000_000, 256, 512

_BUILT: dict[tuple[str, str, str], str] = {}


@dataclass(frozen=True)
class Index:
    """chunks: key, len, terms (term, tf); terms: term, df, idf; both are tables in the shared folder. key: the name of the chunks' key."""

    chunks: DataFrame
    terms: DataFrame
    key: str


def _files_of(chunks: DataFrame) -> str | None:
    """What tells the files of a table and their state; None where chunks isn't read from files."""
    try:
        marks = chunks.select(F.xxhash64("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").alias("h"))
    except AnalysisException:
        return None
    total = marks.distinct().agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"{total[0]}:{total[1]}"


def index(chunks: DataFrame, key: str, text: str = "text") -> Index:
    """The index of chunks (key, text). Null text has no terms. Written to the shared folder, and read from there while the files of chunks are the same."""
    spark, state = chunks.sparkSession, _files_of(chunks)
    name = (spark.sparkContext.applicationId, f"{key}:{text}", state or uuid.uuid4().hex)
    if name not in _BUILT:
        tokens = T.lexical_tokens(F.coalesce(F.col(text), F.lit("")))
        runs = F.regexp_extract_all(F.concat(F.array_join(F.sort_array("t"), " "), F.lit(" ")), F.lit(r"(\w+ )\1*"), F.lit(0))
        word = lambda run: F.substring_index(run, " ", 1)
        terms = F.transform(runs, lambda run: F.struct(word(run).alias("term"), (F.length(run) / (F.length(word(run)) + 1)).cast("int").alias("tf")))
        path = f"{files.shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
        chunks.select(F.col(key), tokens.alias("t")).select(key, F.size("t").cast("long").alias("len"), terms.alias("terms")).write.parquet(f"{path}/chunks")
        term_statistics(spark.read.parquet(f"{path}/chunks"), key).write.parquet(f"{path}/terms")
        _BUILT[name] = path  # named when both are whole
    return Index(spark.read.parquet(f"{_BUILT[name]}/chunks"), spark.read.parquet(f"{_BUILT[name]}/terms"), key)


def postings(indexed: DataFrame, key: str) -> DataFrame:
    """key, len, term, tf."""
    return indexed.select(key, "len", F.inline("terms"))


def term_statistics(indexed: DataFrame, key: str) -> DataFrame:
    """term, df, idf; a negative idf becomes FLOOR times the vocabulary's mean. Counts are combined before they move."""
    df = postings(indexed, key).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = indexed.agg(F.count(F.lit(1)).alias("n"))  # one row
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def search(indexed: Index, questions: DataFrame, question: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """question, key, score, rank: the k best chunks of each question by BM25 with a positive score, ties by key.

    questions (question, text; both keys are longs) are a stated set; a term that one
    has several times counts as often. Statistics are those of all chunks; a chunk without a key counts in them and is not found; among
    (key) are the chunks that may be found, all where it is None.
    """
    key = indexed.key
    asked = questions.select(F.col(question), F.explode(T.lexical_tokens(F.col("text"))).alias("term")).groupBy(question, "term").agg(F.count(F.lit(1)).alias("times"))
    weighed = asked.join(indexed.terms, "term").select(F.col(question).alias("q"), "term", (F.col("times") * F.col("idf")).alias("w"))
    chunks = indexed.chunks if among is None else indexed.chunks.join(among.select(key).distinct(), key, "left_semi")
    mean = indexed.chunks.agg(F.avg("len")).first()[0] or 1.0
    blocks = max(1, math.ceil(asked.count() / ASKED))
    found = None
    for i in range(blocks):
        own = weighed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow()
        some = _best(chunks.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), "len", "terms"), own, mean, k)
        found = some if found is None else found.unionByName(some)
    return top(found.select(F.col("q").alias(question), F.col("k").alias(key), "score"), [question], key, k)


def _best(chunks: DataFrame, weighed: pa.Table, mean: float, k: int) -> DataFrame:
    """q, k, score: each task's own k best for each question."""
    terms = pc.unique(weighed.column("term"))
    names, q = np.unique(np.asarray(weighed.column("q")), return_inverse=True)
    shared = chunks.sparkSession.sparkContext.broadcast((terms, names, q, np.asarray(pc.index_in(weighed.column("term"), terms)), np.asarray(weighed.column("w"))))

    def score(batches):
        terms, names, q, term, weight = shared.value
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # question, key, score
        for batch in batches if len(names) else ():
            for at in range(0, batch.num_rows, CHUNKS):
                part = batch.slice(at, CHUNKS)
                keys, length = np.asarray(part.column(0)), np.asarray(part.column(1), dtype=float)
                lists = part.column(2)
                flat = lists.flatten()
                chunk = np.repeat(np.arange(len(keys)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                known = pc.index_in(flat.field("term"), terms)
                seen = np.asarray(pc.is_valid(known))
                chunk, place, tf = chunk[seen], np.asarray(known.drop_null()), np.asarray(flat.field("tf"), dtype=float)[seen]
                gain = np.zeros((len(keys), len(terms)))
                gain[chunk, place] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[chunk] / mean))
                for first in range(0, len(names), QUESTIONS):
                    mine = (q >= first) & (q < first + QUESTIONS)
                    weights = np.zeros((len(terms), min(QUESTIONS, len(names) - first)))
                    weights[term[mine], q[mine] - first] = weight[mine]
                    made = np.round(gain @ weights, DIGITS)
                    i, j = np.nonzero(made > 0)
                    held = [np.concatenate(x) for x in zip(held, (j + first, keys[i], made[i, j]), strict=True)]
                held = best(held)
        yield pa.RecordBatch.from_pydict({"q": pa.array(names[held[0]] if len(names) else [], pa.int64()), "k": pa.array(held[1], pa.int64()), "score": pa.array(held[2], pa.float64())})

    def best(held):
        order = np.lexsort((held[1], -held[2], held[0]))
        own = held[0][order]
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(start, np.diff(np.concatenate((start, [len(own)]))))
        return [x[order[rank < k]] for x in held]

    return chunks.mapInArrow(score, "q long, k long, score double")


def top(scored: DataFrame, group: list[str], key: str, k: int, score: str = "score", ascending: bool = False, rank: str = "rank") -> DataFrame:
    """The first k of each group by score, ties by key, nulls last in both; the engine stops at k while it sorts."""
    order = F.col(score).asc_nulls_last() if ascending else F.col(score).desc()
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(order, F.col(key).asc_nulls_last())).cast("long")).where(F.col(rank) <= k)
