import collections
import hashlib
import pathlib
import random
import time

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("lectern.llm")
from oracle import SF  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import cases  # noqa: E402
from lectern.llm import compact_windows, components, jaccard_join, scratch, weighted_sampling  # noqa: E402


def near_copies(seed, groups=12, size=6, words=120):
    """Texts in groups of copies with single words changed, and passages that groups share."""
    r = random.Random(seed)
    shared = [f"shared{i}" for i in range(60)]
    out, k = [], 0
    for g in range(groups):
        base = [f"w{r.randrange(10_000)}" for _ in range(words)]
        if g % 3 == 0:
            base[20:20] = shared
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(6)):
                own[r.randrange(len(own))] = f"e{r.randrange(10_000)}"
            out.append((k, " ".join(own)))
            k += r.randrange(1, 4)
    r.shuffle(out)
    return out


def test_components_of_paths_and_cycles(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (1, 9), (9, 1), (7, 9)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components.label(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


def test_op10_against_all_pairs(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = cases.components(docs)
    got = jaccard_join.query(spark, SF).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == want
    assert got.n_shingles.to_dict() == {k: len(cases.shingles(t)) for k, t in zip(docs.doc_id, docs.text, strict=True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_op10_near_the_threshold(spark, seed):
    docs = pd.DataFrame(near_copies(seed), columns=["doc_id", "text"])
    got = jaccard_join.join(spark.createDataFrame(docs)).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == cases.components(docs)
    left = {r["doc_id"] for r in jaccard_join.keep_first(spark.createDataFrame(docs)).collect()}
    assert left == {k for k, c in cases.components(docs).items() if k == c}


def test_op10_sets_of_one_name_are_told_apart(spark):
    docs = pd.DataFrame(near_copies(3), columns=["doc_id", "text"])
    got = jaccard_join.join(spark.createDataFrame(docs), bits=3).toPandas().set_index("doc_id")  # eight names for all sets
    assert got.component_id.to_dict() == cases.components(docs)


def test_op10_ids_of_every_kind(spark):
    words = [f"w{i}" for i in range(40)]
    a, b = " ".join(words), " ".join(words + ["end"])
    rows = [(-(1 << 63), a), (None, b), (5, b), (5, "something else entirely"), (7, "something else entirely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.join(docs).collect()}
    low = -(1 << 63)
    assert got == {(low, 36): low, (None, 37): low, (5, 37): low, (5, 1): 5, (7, 1): 5}
    kept = {(r["doc_id"], r["text"]) for r in jaccard_join.keep_first(docs).collect()}
    assert kept == {(low, a), (None, b), (5, "something else entirely")}  # a row goes by its own text


def test_op10_awkward(spark):
    docs = cases.awkward(spark)
    got = jaccard_join.join(docs).toPandas()
    assert len(got) == docs.count()
    by = {(None if pd.isna(r.doc_id) else int(r.doc_id), r.n_shingles): r.component_id for r in got.itertuples()}
    assert by[2, 1] == 1 and by[None, 1] == 1 and by[3, 0] == 3 and by[7, by and max(n for k, n in by if k == 7)] == 6
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert jaccard_join.join(cases.empty(spark)).count() == 0


def test_op6_windows_against_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, least = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        h = rng.integers(1, 40, n).astype(np.uint64) << np.uint64(30)
        h[rng.random(n) < 0.08] = 0
        want = set()
        for c in np.flatnonzero(h):
            lo = hi = c
            while lo > 0 and h[lo - 1] > h[c]:
                lo -= 1
            while hi + 1 < n and h[hi + 1] and h[hi + 1] >= h[c]:
                hi += 1
            if hi - lo + 1 >= least:
                want.add((lo, c, hi))
        assert set(zip(*(x.tolist() for x in compact_windows.windows(h, least)), strict=True)) == want


def test_op6_finds_every_repeated_passage(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = compact_windows.query(spark, SF).toPandas()
    words = {k: cases.WORD.findall(t.lower()) for k, t in zip(docs.doc_id, docs.text, strict=True)}
    holders = collections.defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - 50):
            holders[tuple(w[i : i + 51])].add(k)
    repeated = set().union(*[h for h in holders.values() if len(h) > 1])
    assert repeated <= set(got.doc_id) | set(got.other_id)
    for r in got.itertuples():  # and every row is true
        a, b = (cases.shingles(" ".join(w)) for w in (words[r.doc_id][r.start_word : r.end_word], words[r.other_id][r.other_start : r.other_end]))
        assert len(a & b) / len(a | b) >= 0.75 and r.end_word - r.start_word >= 50


def test_op6_planted_passages(spark):
    r = random.Random(9)
    fresh = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    passage, other = fresh(55), fresh(80)
    docs = []
    for k in range(60):
        body = fresh(150)
        if k % 3 == 0:
            body[r.randrange(150) : 0] = passage
        if k % 20 == 7:
            edited = list(other)
            edited[40] = f"edit{k}"
            body[100:100] = edited
        docs.append((k, " ".join(body)))
    got = compact_windows.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).toPandas()
    found = set(got.doc_id) | set(got.other_id)
    assert {k for k in range(60) if k % 3 == 0 or k % 20 == 7} == found


def test_op6_awkward(spark):
    docs = cases.awkward(spark)
    got = compact_windows.passages(docs).toPandas()
    assert {(r.doc_id, r.other_id) for r in got.itertuples()} == {(7, 6)}
    assert compact_windows.passages(cases.empty(spark)).count() == 0


def jaccard(a: str, b: str) -> float:
    a, b = (collections.Counter(x.split()) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_op7_edits_and_likeness(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ascending=False)
    got = weighted_sampling.query(spark, SF).toPandas().set_index("doc_id")
    texts, ids, gaps = docs.text.tolist(), docs.doc_id.tolist(), []
    for i, (k, t) in enumerate(zip(ids, texts, strict=True)):
        after, cut = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        assert got.edited_sha256[k] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[k] == len(t)
        gaps += [got.near_edited[k] - jaccard(t, edited), got.near_next[k] - jaccard(t, after)]
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.12


def test_op7_collision_rate_is_the_weighted_similarity(spark):
    """Many draws of one pair: the share of equal draws nears the generalised Jaccard similarity."""
    a, b = "x " * 9 + "y " * 2 + "z", "x " * 4 + "y " * 4 + "v v"
    df = spark.createDataFrame([(1, a, b)], "k long, a string, b string")
    n = 600
    row = weighted_sampling.signatures(df, ["k"], {"a": F.col("a"), "b": F.col("b")}, n).first()
    same = np.mean([row["a"][8 * i : 8 * i + 8] == row["b"][8 * i : 8 * i + 8] for i in range(n)])
    assert abs(same - jaccard(a, b)) < 0.06


def test_op7_deviation_of_a_row(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = weighted_sampling.query(spark, SF).toPandas().set_index("doc_id")
    ids = sorted(texts, reverse=True)
    gaps = [got.near_next[k] - jaccard(texts[k], texts[ids[(i + 1) % len(ids)]]) for i, k in enumerate(ids)]
    cuts = [(texts[k], texts[ids[(i + 1) % len(ids)]], len(texts[k]) // 2) for i, k in enumerate(ids)]
    gaps += [got.near_edited[k] - jaccard(t, t[: len(t) - cut] + after[:cut]) for k, (t, after, cut) in zip(ids, cuts, strict=True)]
    assert got.fingerprint.str.len().min() >= 32 * 8 and np.std(gaps) < 0.0884


def test_op7_awkward(spark):
    docs = cases.awkward(spark)
    got = weighted_sampling.fingerprints(docs).toPandas()
    assert len(got) == docs.count() and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got[got.n_chars == len("same text here")].fingerprint.nunique() == 1
    assert weighted_sampling.fingerprints(cases.empty(spark)).count() == 0
    one = weighted_sampling.fingerprints(docs.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0


def edited_groups(seed, groups=6, copies=30, words=60, edits=(4, 10)):
    """Documents that hold a passage of their group: a few edited copies with the smaller ids, then copies without edits."""
    r = random.Random(seed)
    fresh = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    docs = []
    for g in range(groups):
        passage = fresh(words)
        for k in range(copies):
            own = list(passage)
            if k < copies - 2:
                n = r.randrange(*edits)
                for i in range(n):
                    own[(2 * i + 1) * words // (2 * n)] = f"e{r.randrange(10**9)}"
            docs.append((g * 1000 + k, " ".join(fresh(80) + own + fresh(80))))
    return docs


def test_op6_equal_passages_behind_edited_heads(spark):
    docs = edited_groups(3)
    got = compact_windows.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).toPandas()
    found = set(got.doc_id) | set(got.other_id)
    assert {g * 1000 + k for g in range(6) for k in (28, 29)} <= found


def test_op6_lone_pairs_near_the_threshold(spark):
    """Recall against all pairs: 400 passages, each with one copy of similarity 0.7576 and no equal stretch of 50 words."""
    r = random.Random(5)
    docs = []
    for k in range(400):
        passage = [f"n{r.randrange(10**9)}" for _ in range(62)]
        docs.append((2 * k, " ".join(passage)))
        passage[29:33] = [f"e{r.randrange(10**9)}" for _ in range(4)]
        docs.append((2 * k + 1, " ".join(passage)))
        a, b = (cases.shingles(t) for _, t in docs[-2:])
        assert 0.75 <= len(a & b) / len(a | b) < 0.76
    got = compact_windows.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).toPandas()
    assert set(zip(got.doc_id, got.other_id, strict=True)) == {(2 * k + 1, 2 * k) for k in range(400)}


def clusters(seed, n, size=4, words=80):
    """Documents of fresh words that each hold an edited copy of their cluster's passage, of similarity 0.75 to 0.85 with each other."""
    r = random.Random(seed)
    fresh = lambda k: [f"n{r.randrange(10**9)}" for _ in range(k)]
    docs = []
    for g in range(n):
        passage = fresh(words)
        for k in range(size):
            own = list(passage)
            own[6 + 20 * k] = f"e{r.randrange(10**9)}"
            docs.append((g * 10 + k, " ".join(fresh(60) + own + fresh(60)), own))
    return docs


def test_op6_clusters_of_edited_copies(spark):
    docs = clusters(11, 80)
    one, two = (cases.shingles(" ".join(x[2])) for x in docs[:2])
    assert 0.75 <= len(one & two) / len(one | two) < 0.8
    df = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    rows_ = [sorted(map(tuple, compact_windows.passages(df.repartition(n)).collect())) for n in (1, 8)]
    assert rows_[0] == rows_[1]
    up = {x[0]: x[0] for x in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in rows_[0]:
        up[top(x[0])] = top(x[3])
    pairs = [(g * 10 + i, g * 10 + j) for g in range(80) for i in range(4) for j in range(i)]
    assert np.mean([top(a) == top(b) for a, b in pairs]) >= 0.98
    assert all(a // 10 == b // 10 for a, b in ((x[0], x[3]) for x in rows_[0]))


def test_op6_passages_around_a_common_line(spark):
    """A line of 20 words stands in every document; passages around it are found all the same, and what is unlike stays apart."""
    r = random.Random(4)
    fresh = lambda k: [f"n{r.randrange(10**9)}" for _ in range(k)]
    line, docs = fresh(20), []
    for k in range(150):
        docs.append((k, " ".join(fresh(50) + line + fresh(50))))
    for g in range(10):
        passage = fresh(25) + line + fresh(25)
        docs += [(1000 + 10 * g + k, " ".join(fresh(40) + passage + fresh(40))) for k in range(3)]
    got = compact_windows.passages(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert {(min(a, b) // 10, max(a, b) // 10) for a, b in zip(got.doc_id, got.other_id, strict=True)} == {(100 + g, 100 + g) for g in range(10)}
    assert set(got.doc_id) | set(got.other_id) == {k for k, _ in docs if k >= 1000}


def test_op6_only_stretches_that_can_match_have_windows(spark):
    """Documents that share one line and nothing else have no windows, however many they are; shared passages have, wherever they stand."""
    r = random.Random(6)
    fresh = lambda k: [f"n{r.randrange(10**9)}" for _ in range(k)]
    line, passage = fresh(20), fresh(60)
    docs = [(k, " ".join(fresh(70) + line + fresh(70))) for k in range(60)]
    held = [(100 + k, " ".join(fresh(30 * k) + passage + fresh(10))) for k in range(3)]
    for n in (1, 7):
        got = compact_windows._windows(spark.createDataFrame(docs + held, "k long, text string").repartition(n)).collect()
        assert {x["doc"] for x in got} == {100, 101, 102}
        spans = {(x["doc"] - 100, x["lc"] >> 32, x["r"]) for x in got}
        assert all(30 * k <= lo and hi < 30 * k + 56 for k, lo, hi in spans)  # cut at the places that are shared
        assert {30 * k for k in range(3)} == {min(lo for k, lo, _ in spans if k == d) for d in range(3)}


def test_op6_every_pair_of_a_small_cluster_has_its_row(spark):
    """Edited copies that were verified with the same head are compared with each other too."""
    docs = clusters(12, 40)
    got = compact_windows.passages(spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string").repartition(3)).toPandas()
    assert set(zip(got.doc_id, got.other_id, strict=True)) == {(g * 10 + i, g * 10 + j) for g in range(40) for i in range(4) for j in range(i)}


def test_op6_stretches_that_edits_part_are_compared_whole():
    """Similar passages whose longest equal runs are shorter than a passage."""
    rng = np.random.default_rng(3)
    tried = 0
    for _ in range(1500):
        a = rng.integers(1, 1 << 31, int(rng.integers(50, 144)))
        b = a.copy()
        for i in rng.choice(len(a), int(rng.integers(0, 7)), False):
            b[i] = rng.integers(1, 1 << 31)
        a, b = (np.array([hash(tuple(w[i : i + 5].tolist())) & 0xFFFFFFFF for i in range(len(w) - 4)], np.uint64) for w in (a, b))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or a[0] != b[0] or a[-1] != b[-1]:
            continue
        tried += 1
        a, b = (np.concatenate((rng.integers(1, 1 << 32, 30).astype(np.uint64), x, rng.integers(1, 1 << 32, 30).astype(np.uint64))) for x in (a, b))
        assert compact_windows.compare(a, b)
    assert tried > 300


def test_scratch_tables_leave_no_shuffle_files(spark):
    """What a scratch table's write shuffled goes with the query, not with the driver's garbage; the setting is as before."""
    spark.range(1).count()  # executors have their folders
    folders = [pathlib.Path(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held = lambda: {f.name for d in folders for f in d.rglob("shuffle_*.data")}
    before, setting = held(), spark.conf.get(scratch.CLEANUP, None)
    df = spark.range(50_000).selectExpr("id", "id % 7 AS k").repartition(3, "k")
    kept = [scratch.keep(df, "t"), scratch.keep(df.groupBy("k").agg(F.sum("id").alias("s")), "t")]
    deadline = time.time() + 10
    while held() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(scratch.CLEANUP, None) == setting
    assert kept[0].count() == df.count() == 50_000 and kept[1].count() == 7


def test_op6_a_repeating_text_has_one_window_of_a_value(spark):
    """Texts that say a line over and over meet once for each value, not once for each place, and are found."""
    r = random.Random(8)
    fresh = lambda k: [f"n{r.randrange(10**9)}" for _ in range(k)]
    lines = [fresh(1), fresh(2), fresh(9)]
    docs = [(10 * g + k, " ".join(fresh(30) + line * ((300 + 40 * k) // len(line)) + fresh(30))) for g, line in enumerate(lines) for k in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cut = collections.Counter((x["doc"], x["v"]) for x in compact_windows._windows(df.withColumnRenamed("doc_id", "k").repartition(3)).collect())
    assert {d for d, _ in cut} == {k for k, _ in docs} and set(cut.values()) == {1}
    got = compact_windows.passages(df.repartition(3)).toPandas()
    pairs = set(zip(got.doc_id, got.other_id, strict=True))
    assert {(10 * g + k, 10 * g) for g in range(3) for k in range(1, 4)} <= pairs and all(a // 10 == b // 10 for a, b in pairs)


def test_op6_tied_windows_hold_the_same_passages():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(60, 260))
        h = rng.integers(1, int(rng.integers(2, 9)), n).astype(np.uint64) << np.uint64(30)
        h[rng.random(n) < 0.01] = 0
        l, c, r = compact_windows.windows(h)
        made = list(zip(*(x.tolist() for x in compact_windows.tied(h[c], l, c, r)), strict=True))
        assert len(made) <= len(c)
        for a, b, e in zip(l.tolist(), c.tolist(), r.tolist(), strict=True):  # each window lies in a tied one of its value, its centre among those
            assert any(h[y] == h[b] and x <= a and e <= w and y <= b <= z for x, y, z, w in made)
        for x, y, z, w in made:  # which holds no less hash, and a centre in every LEAST places between the first and the last
            assert h[x : w + 1].min() == h[y] == h[z]
            assert np.diff(np.flatnonzero(h[y : z + 1] == h[y])).max(initial=0) <= compact_windows.LEAST


def test_op6_rare_shingles_part_what_a_common_line_groups(spark):
    """Stretches that have a common line and a filler of their own: only those of one filler have a rare shingle in common, and each two of these have."""
    r = random.Random(10)
    fresh = lambda k: [f"n{r.randrange(10**9)}" for _ in range(k)]
    line, docs = fresh(14), []
    for g in range(30):
        filler = fresh(1)
        docs += [(10 * g + k, " ".join(filler * (60 + k) + line + fresh(30))) for k in range(1 + g % 3)]
    df = spark.createDataFrame(docs, "k long, text string")
    left = compact_windows._rare(df.repartition(3), compact_windows._windows(df))
    holders = collections.defaultdict(set)
    for x in left.collect():
        holders[x["v"]].add(x["doc"])
    assert {frozenset(h) for h in holders.values()} == {frozenset(10 * g + k for k in range(1 + g % 3)) for g in range(30) if g % 3}
    got = compact_windows.passages(df.withColumnRenamed("k", "doc_id")).toPandas()
    assert set(zip(got.doc_id, got.other_id, strict=True)) >= {(10 * g + k, 10 * g) for g in range(30) for k in range(1, 1 + g % 3)}
    assert all(a // 10 == b // 10 for a, b in zip(got.doc_id, got.other_id, strict=True))


def test_op6_dense_stretches_meet_by_a_rare_shingle():
    rng = np.random.default_rng(5)
    tried = 0
    for _ in range(400):
        pool = rng.integers(0, 60, 60)
        a, b = (np.where(rng.random(n) < 0.9, pool[(np.arange(n) + int(rng.integers(0, 3))) % len(pool)], rng.integers(60, 400, n)).astype(np.uint64) for n in rng.integers(46, 140, 2).tolist())
        many = lambda x: (x * np.uint64(2654435761) % np.uint64(97)).astype(np.int64) + 2
        dense = lambda x, y: np.convolve(np.isin(x, y), np.ones(compact_windows.LEAST, int), "valid").max() >= compact_windows.NEEDED
        if dense(a, b) and dense(b, a):
            tried += 1
            one, two = (set(x[compact_windows.rare(len(x), many(x), x, np.arange(len(x)))].tolist()) for x in (a, b))
            assert one & two
    assert tried > 100
