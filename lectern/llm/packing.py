"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import memory, scratch, tokens

CAPACITY = 4096
END_ID = 1
#: Rounds of multiplicative weights, and how strongly a covered length loses its price.
ROUNDS, RATE = 240, 0.5
#: Parts that the pieces of one length are dealt to while they are numbered.
BUCKETS = 256
#: Memo entries and bytes of text at a time of a task that cuts texts, which has its executor to itself.
MEMO, GROUP_CHARS = 1_500_000, 16_000_000

Plan = list[tuple[tuple[int, ...], int]]


def _best_pattern(lengths: np.ndarray, price: np.ndarray, capacity: int) -> list[int]:
    """Unbounded knapsack by dynamic programming over capacity: places in lengths, repeats included."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c], choice[c] = value[c - 1], -2
        k = upto[c]
        if k:
            gain = price[:k] + value[c - lengths[:k]]
            j = int(gain.argmax())
            if gain[j] > value[c]:
                value[c], choice[c] = gain[j], j
    items, c = [], capacity
    while c > 0 and choice[c] != -1:
        if choice[c] == -2:
            c -= 1
        else:
            items.append(int(choice[c]))
            c -= int(lengths[choice[c]])
    return items


def configurations(histogram: Mapping[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Patterns of lengths and how many sequences follow each: the linear program's part, rounded down.

    Minimise the sequences that cover the histogram. Multiplicative weights keep a
    price for each length; each round prices the best pattern by knapsack, uses it,
    and lowers the prices of the lengths by how far they are covered. The fractional
    uses are scaled so that no length is covered above its count, then rounded down.
    """
    lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    plan: Plan = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    if not len(lengths):
        return plan
    count = np.array([histogram[n] for n in lengths], float)
    price = lengths / capacity
    uses: dict[tuple[int, ...], float] = {}
    cover = np.zeros(len(lengths))
    for _ in range(rounds):
        items = _best_pattern(lengths, price, capacity)
        kinds, times = np.unique(items, return_counts=True)
        step = float((count[kinds] / times).min())
        uses[tuple(items)] = uses.get(tuple(items), 0) + step
        share = times * step / count[kinds]
        cover[kinds] += share
        price[kinds] *= np.exp(-RATE * share)
    scale = 1 / max(1.0, cover.max())
    left = count.astype(np.int64)
    for items, x in sorted(uses.items(), key=lambda u: -u[1]):
        kinds, times = np.unique(items, return_counts=True)
        n = int(min(np.floor(x * scale + 1e-9), (left[kinds] // times).min()))
        if n > 0:
            left[kinds] -= times * n
            plan.append((tuple(int(lengths[i]) for i in items), n))
    return plan


def best_fit(histogram: Mapping[int, int], plan: Plan, capacity: int = CAPACITY) -> Plan:
    """Adds what the plan leaves out, longest first, each to the fullest sequences that can take it.

    Sequences with the same content stay one entry with a count, so that the work
    follows the number of different lengths and not the number of pieces.
    """
    left = dict(histogram)
    for items, n in plan:
        for length in items:
            left[length] -= n
    held: dict[int, list[list]] = {}  # free room: [items, count]
    rooms: list[int] = []

    def put(items: tuple[int, ...], n: int) -> None:
        room = capacity - sum(items)
        if room not in held:
            held[room] = []
            insort(rooms, room)
        held[room].append([items, n])

    for items, n in plan:
        put(items, n)
    for length in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[length]
        while n > 0:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                if n >= fit:
                    put((length,) * fit, n // fit)
                    n %= fit
                else:
                    put((length,) * n, 1)
                    n = 0
                continue
            room = rooms[i]
            items, free = held[room].pop()
            if not held[room]:
                del held[room]
                rooms.pop(i)
            fit = room // length
            if n >= fit:
                used = min(free, n // fit)
                put(items + (length,) * fit, used)
                n -= used * fit
            else:
                used = 1
                put(items + (length,) * n, 1)
                n = 0
            if free > used:
                put(items, free - used)
    return [(tuple(items), n) for row in held.values() for items, n in row]


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of slots, its first sequence, its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for items, n in plan:
        at = 0
        for length in items:
            runs.setdefault(length, []).append((n, base, at))
            at += length
        base += n
    out = {}
    for length, own in runs.items():
        n, first, at = (np.array(x, np.int64) for x in zip(*own, strict=True))
        out[length] = (np.cumsum(n) - n, first, at)
    return out


def cut(docs: DataFrame, vocabulary: str, spaced: bool = False, end_id: int = END_ID, capacity: int = CAPACITY, memo: int = MEMO, group: int = GROUP_CHARS) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32. Null text is empty: its end id alone.

    memo, group: how many chunks a worker remembers and how many bytes of text it encodes at a time.
    """
    text = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def pieces(batches):
        enc = tokens.encoder(text.value, spaced, memo)
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in tokens.groups(texts, group):
                ids, at = enc.encode(texts.slice(a, b - a))
                rows = []
                for i in range(b - a):
                    own = np.concatenate((ids[at[i] : at[i + 1]], end))
                    rows += [(ids_of[a + i], k // capacity, k, min(capacity, len(own) - k), zlib.crc32(own[k : k + capacity].tobytes())) for k in range(0, len(own), capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(memory.tidy(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset.

    The driver gets the histogram alone, at most ``capacity`` rows. Pieces of one
    length are interchangeable: each gets its rank among them, in 256 buckets for
    each length so that no length is numbered in one task, and the rank names its
    slot. An empty table gives no rows; rows with equal (doc_id, piece) are packed
    like any others. pieces must give the same rows each time it is read.
    """
    spark = pieces.sparkSession
    mine = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    counted = scratch.keep(mine.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(best_fit(histogram, configurations(histogram, capacity, rounds), capacity)))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "piece")) - 1
    ranked = mine.withColumn("__r", within).join(bases, ["length", "__b"]).withColumn("__rank", F.col("__base") + F.col("__r"))

    def place(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("__rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts):
                if len(own):
                    first, base, at = shared.value[int(length[own[0]])]
                    k = np.searchsorted(first, rank[own], side="right") - 1
                    seq[own], offset[own] = base[k] + rank[own] - first[k], at[k]
            keep = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, **how: int) -> DataFrame:
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return pack(scratch.keep(cut(docs.select("doc_id", "text"), f.read(), **how), "pack-pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
