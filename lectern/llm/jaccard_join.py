"""Exact n-gram Jaccard join through a token-group matrix.

Two documents link when 100 |A and B| >= 75 |A or B| over their sets of five-word
shingles. Then the first |A| - ceil(0.75 |A|) + 1 shingles of A, in any order that
all documents share, and as many of B, have one in common: its prefix is all of a
document that the matrix has to know. The order goes by how many documents hold a
shingle, as a sketch of fixed size over all shingles tells it, and then by hash; it
decides how much work there is, never what links.

1. Documents with the same set are one node.
2. Nodes that share prefix shingles with the first node that holds them are compared
   with it, then with the one of which most shingles are held by others too; those
   that link are put into groups, which are connected. A round has at most a pair for
   each row.
3. The matrix has, for each shingle and group, the union of its members' prefixes,
   and bounds of the members' sizes. Shingles of one group need no more work. For the
   others a node's overlap with any member of a group is bounded, and the group is
   opened only where the bound allows a link: the node meets those members that hold
   the shingle, the same bound is taken for each, and what is left is compared by the
   whole sets.

The bound: of two prefixes one ends first in the common order. Up to there all common
shingles are common to the prefixes, and behind it that node has only the n - p
shingles left that its prefix of p leaves out. So two nodes have at most c + n - p in
common, where c counts common prefix shingles and n, p are those of the node whose
prefix ends first; and at most its reach, which has for c all its prefix shingles that
any other prefix holds. Their first common shingle leaves each of them room for the
others behind it: as many held shingles as its prefix has after it, so that c is at
most one more than the smaller room. What remains apart has no link: every pair that
could link in two groups was opened.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import components, memory, scratch, shingles, tokens

PERCENT = 75
#: Counters of the sketch, whatever the input.
COUNTERS, BLOCK = 1 << 22, 1 << 18
#: Pairs with one first node that are compared together.
TOGETHER = 512
#: Nodes of a block where many pairs lie among few nodes.
BLOCK_NODES = 128
#: Requests for one node's set that one row of the scan serves.
SERVED = 256
#: Bytes of text that a worker cuts into shingles at a time, bytes of sets that it hands on together, and rows of sets that it reads together. A worker's memory counts with its executor's.
SCANNED, SENT, READ = 1_000_000, 4_000_000, 256
_SET = "kind int, k long, h long, n long, node long, proof long, block int, counts binary"
_ROW = "token long, node long, n int, end long, pos int"
#: Rows that may be sent to every executor; beyond, the join shuffles.
FEW = 200_000


def _node(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The name of a set, and 64 bits more that tell sets of one name apart."""
    import xxhash

    data = s.tobytes()
    return (xxhash.xxh3_64_intdigest(data) >> (64 - bits)) - (1 << 63), xxhash.xxh64_intdigest(data, 7) - (1 << 63)


class Names:
    """Names of sets, with other names for those that clash."""

    def __init__(self, bits: int, renamed: dict[tuple[int, int], int]):
        self.bits, self.renamed, self.clashing = bits, renamed, {m for m, _ in renamed}

    def of(self, s: np.ndarray) -> int:
        m, proof = _node(s, self.bits)
        return self.renamed.get((m, proof), m) if m in self.clashing else m


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _count(counts: np.ndarray, shingles_: np.ndarray) -> None:
    """Adds to counts how many of the shingles have each low bits."""
    low, n = np.unique(shingles_ & np.uint64(len(counts) - 1), return_counts=True)
    counts[low.astype(np.int64)] += n.astype(np.uint32)


def _rows(batch: pa.RecordBatch):
    """The rows of a batch, READ of them as Python objects at a time."""
    for i in range(0, batch.num_rows, READ):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, READ).columns), strict=True)


def _batch(columns: dict, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in schema.items()], list(schema))


def sets(docs: DataFrame, bits: int = 64) -> DataFrame:
    """kind 0: k, h, n, node, proof of every row of docs (k, h, text); kind 1: blocks of counts of shingles by their low bits."""
    kinds = {"kind": pa.int32(), "k": pa.int64(), "h": pa.int64(), "n": pa.int64(), "node": pa.int64(), "proof": pa.int64(), "block": pa.int32(), "counts": pa.binary()}

    def scan(batches):
        counts, seen = np.zeros(COUNTERS, np.uint32), set()
        for batch in batches:
            ids, h, texts = batch.column(0), batch.column(1), batch.column(2)
            for a, b in tokens.groups(texts, SCANNED):
                own = shingles.distinct(texts.slice(a, b - a))
                marks = [_node(s, bits) if len(s) else (0, 0) for s in own]
                fresh = [s for s, m in zip(own, marks, strict=True) if len(s) and not (m in seen or seen.add(m))]
                if fresh:
                    _count(counts, np.concatenate(fresh))
                n = b - a
                yield _batch({"kind": [0] * n, "k": ids.slice(a, n), "h": h.slice(a, n), "n": [len(s) for s in own], "node": [m[0] for m in marks], "proof": [m[1] for m in marks], "block": [None] * n, "counts": [None] * n}, kinds)
        squeeze = zstandard.ZstdCompressor(level=1)
        for i in range(0, COUNTERS, BLOCK):
            if counts[i : i + BLOCK].any():
                yield _batch({c: [None] for c in kinds} | {"kind": [1], "block": [i // BLOCK], "counts": [squeeze.compress(counts[i : i + BLOCK].tobytes())]}, kinds)

    return docs.select("k", "h", "text").mapInArrow(memory.tidy(scan), _SET)


def _told_apart(table: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """table with names that no two sets share, and the new names by (node, proof).

    Names have 64 bits: of 10 billion sets about three clash, and only clashing ones come to the driver.
    """
    some = table.where("n > 0")
    twice = some.groupBy("node").agg(F.min("proof").alias("a"), F.max("proof").alias("b")).where("a <> b").select("node")
    clashing = sorted((r["node"], r["proof"]) for r in some.join(F.broadcast(twice), "node").select("node", "proof").distinct().collect())
    renamed: dict[tuple[int, int], int] = {}
    todo = [x for i, x in enumerate(clashing) if i and clashing[i - 1][0] == x[0]]
    salt = 0
    while todo:
        salt += 1
        made = {x: int(shingles.mix(np.array([x[0] ^ x[1]], np.int64).view(np.uint64) + np.uint64(salt)).view(np.int64)[0]) for x in todo}
        taken = {r["node"] for r in some.where(F.col("node").isin(list(made.values()))).select("node").distinct().collect()} | set(renamed.values())
        for x, name in made.items():
            if name not in taken:
                renamed[x] = name
                taken.add(name)
        todo = [x for x in todo if x not in renamed]
    if not renamed:
        return table, {}
    other = table.sparkSession.createDataFrame([(*x, name) for x, name in renamed.items()], "node long, proof long, other long")
    return table.join(F.broadcast(other), ["node", "proof"], "left").withColumn("node", F.coalesce("other", "node")).drop("other"), renamed


def _sketch(found: DataFrame) -> np.ndarray:
    """The sums of all counts: COUNTERS numbers, the one thing of the corpus that the driver holds."""

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")
                sums[block] = sums[block] + own if block in sums else own.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": [zstandard.ZstdCompressor().compress(np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes()) for x in sums.values()]})

    out = np.zeros(COUNTERS, np.uint32)
    blocks = found.where("kind = 1").select("block", "counts").repartition(COUNTERS // BLOCK, "block")
    for r in blocks.mapInArrow(total, "block int, counts binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), "<u4")
    return out


def _prefixes(docs: DataFrame, sketch: np.ndarray, names: Names) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    kinds = {"token": pa.int64(), "node": pa.int64(), "n": pa.int32(), "end": pa.int64(), "pos": pa.int32()}

    def scan(batches):
        counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0)
            for a, b in tokens.groups(texts, SCANNED):
                out: list[tuple[np.ndarray, int, int, int]] = []
                for s in shingles.distinct(texts.slice(a, b - a)):
                    if not len(s) or (m := names.of(s)) in seen:
                        continue
                    seen.add(m)
                    length = len(s) - math.ceil(PERCENT * len(s) / 100) + 1
                    held = counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    order = np.argsort(held, kind="stable")[:length]
                    # The place of the last one in the common order; ties of the shortened hash count as equal.
                    end = min(int(held[order[-1]]), (1 << 22) - 1) << 41 | int(s[order[-1]]) >> 23
                    out.append((s[order], m, len(s), end))
                if out:
                    sizes = np.array([len(x[0]) for x in out])
                    yield _batch({"token": _signed(np.concatenate([x[0] for x in out])), "node": np.repeat(np.array([x[1] for x in out], np.int64), sizes), "n": np.repeat(np.array([x[2] for x in out], np.int32), sizes), "end": np.repeat(np.array([x[3] for x in out], np.int64), sizes), "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])}, kinds)

    return docs.select("text").mapInArrow(memory.tidy(scan), _ROW)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose token several nodes hold, each with the first of these nodes. Rows come by token and node and pass by."""
    kinds = {"token": pa.int64(), "node": pa.int64(), "n": pa.int32(), "end": pa.int64(), "pos": pa.int32(), "head": pa.int64(), "head_n": pa.int32(), "head_end": pa.int64()}

    def walk(batches):
        held, told = None, False  # the first row of the last token, and whether it was put out
        for batch in batches:
            c = [np.asarray(batch.column(i)) for i in range(5)]
            if held is not None:
                c = [np.concatenate(([h], x)) for h, x in zip(held, c, strict=True)]
            if not len(c[0]):
                continue
            new = np.concatenate(([True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])))
            c = [x[new] for x in c]
            start = np.flatnonzero(np.concatenate(([True], c[0][1:] != c[0][:-1])))
            size = np.diff(np.concatenate((start, [len(c[0])])))
            first = np.repeat(start, size)
            out = np.repeat(size > 1, size)
            last = size[-1] > 1 or (len(start) == 1 and told)
            if told:
                out[0] = False
            held, told = [x[start[-1]] for x in c], last
            if out.any():
                yield _batch({"token": c[0][out], "node": c[1][out], "n": c[2][out], "end": c[3][out], "pos": c[4][out], "head": c[1][first][out], "head_n": c[2][first][out], "head_end": c[3][first][out]}, kinds)

    return rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(memory.tidy(walk), _ROW + ", head long, head_n int, head_end long")


def few(df: DataFrame, size: str = "1") -> DataFrame:
    """df, marked for broadcast where it has at most FEW rows, or where what size says of its rows adds up to that."""
    return F.broadcast(df) if (df.agg(F.expr(f"sum({size})")).first()[0] or 0) <= FEW else df


def _served(docs: DataFrame, table: DataFrame, asks: DataFrame, names: Names) -> DataFrame:
    """asks (node, x, y, b) -> x, y, b, s: the shingles of node, from one row of docs that has them.

    The sets travel once, from the scan to where they are compared. A node that very
    many ask for is read by several rows, SERVED requests each.
    """
    parts = asks.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SERVED).alias("parts"))
    dealt = asks.join(parts, "node").groupBy("node", F.pmod(F.xxhash64("x", "y", "b"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("x", "y", "b")).alias("asks"))
    rep = table.groupBy("node").agg(F.min(F.struct("k", "h")).alias("r"))
    wanted = dealt.join(rep, "node").select(F.col("r.k").alias("__k"), F.col("r.h").alias("__h"), F.col("node").alias("__node"), "asks")
    rows = docs.join(few(scratch.keep(wanted, "ngram-wanted"), "size(asks)"), F.col("k").eqNullSafe(F.col("__k")) & (F.col("h") == F.col("__h"))).select("__node", "text", "asks")

    def scan(batches):
        for batch in batches:
            ids, texts, asked = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for a, b in tokens.groups(texts, SCANNED):
                for m, s, own in zip(ids[a:b], shingles.distinct(texts.slice(a, b - a)), asked[a:b], strict=True):
                    if len(s) and names.of(s) == m:
                        data = s.tobytes()
                        step = max(1, SENT // max(1, len(data)))
                        for i in range(0, len(own), step):
                            part = own[i : i + step]
                            yield pa.RecordBatch.from_pydict({"x": pa.array([q["x"] for q in part], pa.int64()), "y": pa.array([q["y"] for q in part], pa.int64()), "b": pa.array([q["b"] for q in part], pa.int64()), "s": pa.array([data] * len(part), pa.binary())})

    return rows.mapInArrow(memory.tidy(scan), "x long, y long, b long, s binary")


def links(pairs: DataFrame, docs: DataFrame, table: DataFrame, names: Names) -> DataFrame:
    """Those of pairs (a, b) that link, by their whole sets. Pairs of one a are dealt to parts of about TOGETHER."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("long").alias("parts"))
    dealt = pairs.join(parts, "a").select(F.col("b").alias("node"), F.col("a").alias("x"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("y"), "b")
    heads = parts.select(F.col("a").alias("node"), F.col("a").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("y"), F.lit(None).cast("long").alias("b"))
    rows = _served(docs, table, dealt.unionByName(heads), names)

    def compare(batches):
        a = part = head = last = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, p, b, s in _rows(batch):
                own = np.frombuffer(s, np.uint64)
                if b is None:
                    a, part, head, last = x, p, own, None
                elif x == a and p == part and b != last:
                    last = b
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * both >= PERCENT * (len(head) + len(own) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    order = rows.repartition("x", "y").sortWithinPartitions(F.col("x"), F.col("y"), F.col("b").asc_nulls_first())
    return order.mapInArrow(memory.tidy(compare), "a long, b long")


def dense_links(pairs: DataFrame, docs: DataFrame, table: DataFrame, names: Names) -> DataFrame:
    """links() for pairs among few nodes: nodes are dealt to blocks of about BLOCK_NODES, and a node's shingles travel once for each pair of blocks."""
    n = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().count()
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, n // BLOCK_NODES))).cast("long")
    dealt = pairs.select(block("a").alias("x"), block("b").alias("y"), "a", "b")
    wanted = dealt.select(F.col("a").alias("node"), "x", "y").union(dealt.select("b", "x", "y")).distinct()
    sets_ = _served(docs, table, wanted.withColumn("b", F.col("node")), names)  # b tells whose set it is
    rows = sets_.select("x", "y", F.col("b").alias("a"), F.lit(None).cast("long").alias("b"), "s").unionByName(dealt.withColumn("s", F.lit(None).cast("binary")))

    def compare(batches):
        place, held = None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, y, a, b, s in _rows(batch):
                if (x, y) != place:
                    place, held = (x, y), {}
                if b is None:
                    held[a] = np.frombuffer(s, np.uint64)
                else:
                    p, q = held[a], held[b]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= PERCENT * (len(p) + len(q) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    order = rows.repartition("x", "y").sortWithinPartitions(F.col("x"), F.col("y"), F.col("b").asc_nulls_first())
    return order.mapInArrow(memory.tidy(compare), "a long, b long")


def _fits(n: str, m: str) -> Column:
    """Whether sets of n and m shingles can link at all."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _behind(n: str) -> Column:
    """Shingles of a set of n that its prefix leaves out."""
    return F.ceil(PERCENT * F.col(n) / 100) - 1


def _enough(most: Column, n: str, m: str) -> Column:
    return most * (100 + PERCENT) >= PERCENT * (F.col(n) + F.col(m))


def _ends(x: str, y: str, of_x: Column, of_y: Column) -> Column:
    """of_x where the prefix that ends at x ends first, of_y where the other does, the larger where it can't be told."""
    return F.when(F.col(x) < F.col(y), of_x).when(F.col(x) > F.col(y), of_y).otherwise(F.greatest(of_x, of_y))


def join(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; other columns are ignored).

    component_id is the least doc_id that links reach, itself included. A text
    without words has no shingles and no links. Null doc_ids count as absent: a
    component takes its id from the others, and is null where it has no other. Rows
    with equal doc_id are judged each by its own text. An empty table gives no rows.
    Sets are named by so many bits, and told apart by 64 more where names clash.
    """
    return _joined(docs, bits).select("doc_id", "n_shingles", "component_id")


def _joined(docs: DataFrame, bits: int = 64) -> DataFrame:
    """join(), with the hash of each row's text (h)."""
    base = docs.select(F.col("doc_id").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    found = scratch.keep(sets(base, bits), "ngram-sets")
    table, renamed = _told_apart(found.where("kind = 0").select("k", "h", "n", "node", "proof"))
    names = Names(bits, renamed)
    rows = scratch.keep(_shared(_prefixes(base, _sketch(found), names)), "ngram-prefixes")

    def compared(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, n, end, b, m, end2, one row for each shingle they are known to share) that the bound allows."""
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("n", "end", "m", "end2")])
        allowed = _enough(F.col("c") + _ends("end", "end2", _behind("n"), _behind("m")), "n", "m")
        wanted = scratch.keep(counted.where(_fits("n", "m") & allowed).select("a", "b"), "ngram-pairs")
        return scratch.keep(links(wanted, base, table, names), "ngram-links")

    def several(cells: DataFrame) -> DataFrame:
        """Cells of those shingles that several groups hold."""
        whole = Window.partitionBy("token")
        return cells.withColumn("x", F.min("g").over(whole)).withColumn("y", F.max("g").over(whole)).where("x <> y").drop("x", "y")

    near = compared(rows.where("head <> node").select(F.col("head").alias("a"), F.col("head_n").alias("n"), F.col("head_end").alias("end"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("end").alias("end2")))
    own = Window.partitionBy("node")
    f, r = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy("pos"))
    cells = rows.select("token", "node", "n", "end", f.alias("f"), (f - r).alias("room")).withColumn("reach", _behind("n") + F.col("f"))
    cells = cells.join(scratch.keep(components.label(near), "ngram-groups"), "node", "left").withColumn("g", F.coalesce("label", "node")).drop("label")
    best = Window.partitionBy("token").orderBy(F.desc(F.col("f") / F.col("n")), "node")
    hub = F.first(F.struct("node", "n", "end", "g")).over(best)
    cells = scratch.keep(several(cells.withColumn("hub", hub)), "ngram-cells")
    starred = cells.where("g <> hub.g").select(F.col("hub.node").alias("a"), F.col("hub.n").alias("n"), F.col("hub.end").alias("end"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("end").alias("end2"))
    near = near.unionByName(compared(starred))
    # A group is named by one of its nodes, so that the names of groups that grew tell the new ones.
    grown = scratch.keep(components.label(near).where("node <> label").select(F.col("node").alias("g"), "label"), "ngram-groups")
    cells = cells.drop("hub").join(few(grown), "g", "left").withColumn("g", F.coalesce("label", "g")).drop("label")
    cells = scratch.keep(several(cells), "ngram-cells")

    matrix = cells.groupBy("token", F.col("g").alias("h")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("end").alias("soonest"), F.max("reach").alias("farthest"), F.max("room").alias("widest"))
    first = F.col("end") < F.col("soonest")  # the node's prefix ends before those of all members that hold the shingle
    could = (100 * F.col("most") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("least"))
    reached = _enough(F.when(first, F.col("reach")).otherwise(F.greatest("reach", "farthest")), "n", "least")
    behind = F.when(first, _behind("n")).otherwise(F.greatest(_behind("n"), _behind("most")))
    open_ = could & reached & _enough(1 + F.least("room", "widest") + behind, "n", "least")
    left = cells.select(F.col("token").alias("t"), F.col("node").alias("a"), "n", "end", "reach", "room", "g")
    met = left.join(matrix, (F.col("t") == F.col("token")) & (F.col("g") < F.col("h")) & open_)
    other = cells.select(F.col("token").alias("t2"), F.col("g").alias("h2"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("end").alias("end2"), F.col("reach").alias("reach2"), F.col("room").alias("room2"))
    links_ = _fits("n", "m") & _enough(_ends("end", "end2", F.col("reach"), F.col("reach2")), "n", "m")
    links_ = links_ & _enough(1 + F.least("room", "room2") + _ends("end", "end2", _behind("n"), _behind("m")), "n", "m")
    pairs = met.select("t", "a", "n", "end", "reach", "room", "h").join(other, (F.col("t") == F.col("t2")) & (F.col("h") == F.col("h2")) & links_).select("a", "b").distinct()
    pairs = scratch.keep(pairs, "ngram-opened")
    near = near.unionByName(dense_links(pairs, base, table, names))
    every = scratch.keep(components.label(near), "ngram-components")

    own = table.join(every, "node", "left").select("k", "h", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("c"))
    least = own.where("c IS NOT NULL").groupBy("c").agg(F.min("k").alias("component_id"))
    return own.join(least, "c", "left").select(F.col("k").alias("doc_id"), "h", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the one with the least doc_id.

    Texts without words and rows without a doc_id stay. Rows that share a doc_id are
    judged each by its text; equal rows stay or go together.
    """
    gone = _joined(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__text")).distinct()
    same = (docs["doc_id"] == F.col("__gone")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__text"))
    return docs.join(few(scratch.keep(gone, "ngram-gone")), same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
