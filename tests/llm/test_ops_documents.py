import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

pytest.importorskip("lectern.llm")
import public_tokenizers  # noqa: E402
from oracle import SF, connect, rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import cases  # noqa: E402
from lectern.llm import exact_dedup, html_text, mixing, packing, scratch, secrets, sstable, tokens, toxicity  # noqa: E402


def frame(df):
    return df.toPandas()


# ------------------------------------------------------------------ tokens and shards


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunked_ids_are_the_librarys(name, spaced):
    vocabulary = open(public_tokenizers.path(name)).read()
    enc, whole = tokens.ChunkEncoder(vocabulary, spaced), Tokenizer.from_str(vocabulary)
    r, letters = random.Random(3), "ab'sll 12  \t\n\x85\xa0 éΣßİA|<>_.​\x1c\x00日本"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + ["", None, " ", "\n", "\n\n", "a\n", "\na", " a", "a  b", "a \n b"]
    ids, at = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_shard_round_trip_and_lookup():
    out, r = io.BytesIO(), random.Random(5)
    keys = sorted(r.sample(range(-(10**6), 10**6), 3000)) + [10**9, 10**9]
    writer = sstable.Writer(out, 2)
    values = [np.array([r.randrange(65_536) for _ in range(r.randrange(30))], "<u4") for _ in keys]
    writer.add(sstable.key_of(None), np.array([5], "<u4"))
    for k, v in zip(keys, values, strict=True):
        writer.add(sstable.key_of(k), v)
    writer.close()
    reader = sstable.Reader(out)
    assert [sstable.id_of(k) for k, _ in reader] == [None, *keys]
    assert all(np.array_equal(reader.get(sstable.key_of(k))[0], v) for k, v in list(zip(keys, values, strict=True))[:500])
    assert len(reader.get(sstable.key_of(10**9))) == 2 and reader.get(sstable.key_of(123456789)) == []
    absent = [k for k in range(2 * 10**6, 2 * 10**6 + 5000)]
    assert sum(reader.may_have(sstable.key_of(k)) for k in absent) < 250


def test_op1_against_the_library(spark):
    got = frame(sstable.query(spark, SF)).sort_values("doc_id").reset_index(drop=True)
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    whole, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r, t in zip(got.itertuples(), docs.text, strict=True):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op1_awkward_rows_and_lookup(spark):
    vocabulary = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    docs = cases.awkward(spark)
    manifest = sstable.write(docs, vocabulary, scratch.place(spark, "t"))
    got = frame(sstable.read(manifest))
    assert len(got) == docs.count() and got.n_tokens.min() == 1 and got.doc_id.isna().sum() == 1
    found = sstable.lookup(manifest, spark.createDataFrame([(2,), (8,), (77,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in found) == [2, 2, 2, 8]
    assert sstable.read(sstable.write(cases.empty(spark), vocabulary, scratch.place(spark, "t"))).count() == 0


# ------------------------------------------------------------------ exact copies


def test_op2_sql(spark):
    from lectern.llm import catalog

    con = connect()
    for name, sql in catalog.oracle_sql().items():
        assert rows(frame(catalog.queries()[name](spark, SF))) == rows(con.execute(sql).df()), name


def test_collisions_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs, hashed=lambda t: F.lit(b"same")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_op2_awkward(spark):
    docs = cases.awkward(spark)
    got = frame(exact_dedup.exact_groups(docs, largest=True))
    assert len(got) == docs.count() and got[got.text_sha256 == hashlib.sha256(b"same text here").hexdigest()].group_size.tolist() == [4] * 4
    assert got.groupby("text_sha256").kept.sum().max() == 1
    assert exact_dedup.exact_groups(cases.empty(spark)).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup.drop_copies(cases.empty(spark)).count() == 0


# ------------------------------------------------------------------ secrets

_ANY = re.compile(secrets._ASSIGN % "+")


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in _ANY.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def check_spans(df, texts):
    got = {r["doc_id"]: r for r in df.collect()}
    for k, t in texts.items():
        base = plain_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in base).encode()).hexdigest(), t
        assert [got[k][f"n_{n}"] for n in ("assign", "access", "hex")] == [sum(s[3] == n for s in base) for n in ("assign", "access", "hex")]
        assert all(f"{n}:{a}:{b}" in got[k]["spans"].split(",") for a, _, b, n in base)


def test_op3_on_the_table(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    check_spans(secrets.query(spark, SF), dict(zip(docs.doc_id, docs.text, strict=True)))


def test_op3_corner_cases(spark):
    bits = ["password", "PassWD", "secret", "tOken", "api_key", "ApiKey", "=", ": ", "'", '"', " ", "abcdefghijkl", "short", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é", "日本", "ſecret", "KIA", "🎉", ".", "-----BEGIN RSA PRIVATE KEY-----"]
    r = random.Random(11)
    texts = {i: "".join(r.choice(bits) for _ in range(r.randrange(14))) for i in range(400)}
    texts |= {400: None, 401: "", 402: ("token=" + "a1" * 20 + " ") * 3000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_spans(secrets.findings(docs, scratch.place(spark, "t")), texts)


def test_op3_scans_only_what_is_new(spark):
    ledger = scratch.place(spark, "t")
    one = spark.createDataFrame([(1, "token=zzzzzzzzzzzzzzzz"), (2, "token=zzzzzzzzzzzzzzzz"), (3, "none")], "doc_id long, text string")
    old = secrets.RULES[:1]
    secrets.scan(one, ledger, old)
    assert spark.read.parquet(ledger).count() == 2
    two = one.unionByName(spark.createDataFrame([(4, "AKIA" + "A" * 16)], "doc_id long, text string"))
    first = secrets.findings(two, ledger, secrets.RULES)
    got = {r["doc_id"]: r["spans"] for r in first.collect()}
    assert spark.read.parquet(ledger).count() == 5  # the two old blobs for the new rules, and the new blob for all
    assert got[1] == got[2] == "assign:0:22" and got[4] == "access:0:20" and got[3] == ""
    secrets.findings(two, ledger, secrets.RULES).count()
    assert spark.read.parquet(ledger).count() == 5
    newer = tuple(secrets.Rule(r.kind, 2, r.pattern, r.needs, r.group, r.least) if r.kind == "access" else r for r in secrets.RULES)
    again = {r["doc_id"]: r["spans"] for r in secrets.findings(two, ledger, newer).collect()}
    assert again == got and spark.read.parquet(ledger).count() == 8


def test_op3_awkward(spark):
    assert secrets.findings(cases.awkward(spark), scratch.place(spark, "t")).count() == cases.awkward(spark).count()
    assert secrets.findings(cases.empty(spark), scratch.place(spark, "t")).count() == 0


def test_native_plans_have_no_python(spark):
    for name in ("op3_secrets", "op7_weighted_sampling"):
        from lectern.llm import catalog

        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ toxicity


def test_op4_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = frame(toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("doc_id", "expected_severity", "p_toxic", labels["toxic"].alias("label"), "grade"))
    assert model.cuts == sorted(model.cuts)
    clean = got[got.label == 0]
    assert (clean.p_toxic >= toxicity.REJECT).mean() < 0.01
    assert (got[got.label == 1].p_toxic >= toxicity.REJECT).mean() > 0.85
    assert got[got.grade == 2].expected_severity.min() > got[got.grade == 0].expected_severity.max() - 0.5
    texts = docs.where("doc_id < 300").select("doc_id", "text").toPandas()
    plain = {k: plain_chances(model, t) for k, t in zip(texts.doc_id, texts.text, strict=True)}
    own = frame(toxicity.score(docs.where("doc_id < 300"), model))
    for r in own.itertuples():
        s = plain[r.doc_id]
        each = [1 - s[0], *(a - b for a, b in zip(s, [*s[1:], 0], strict=True))]
        assert r.p_toxic == pytest.approx(s[0]) and r.expected_severity == pytest.approx(sum(s)) and r.grade == int(np.argmax(each))


def plain_chances(model, text):
    counts = {}
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for x in [w] + [w[:n] + "+" for n in (4, 5, 6) if len(w) > n]:
            counts[x] = counts.get(x, 0) + 1
    z = sum(model.weights.get(x, 0.0) * (1 + math.log(n)) for x, n in counts.items())
    return [1 / (1 + math.exp(min(40, max(-40, c - z)))) for c in model.cuts]


def test_op4_selection_is_that_of_the_whole_fit():
    rng = np.random.default_rng(3)
    n, m = 300, 40
    x = (rng.random((n, m)) < 0.2).astype(float)
    latent = x @ np.concatenate(([3.0, 2, -2], np.zeros(m - 3))) + rng.logistic(size=n)
    grades = (latent > 1).astype(int) + (latent > 3)
    row, word = np.nonzero(x)
    w, _ = toxicity.fit(grades, row, word, x[row, word], m, penalty=0.03, steps=4000)
    assert set(np.flatnonzero(np.abs(w) > 1e-3)) <= set(toxicity.select(grades, row, word, x[row, word], m, 0.03)) <= set(np.flatnonzero(w))


def test_op4_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    n, m = 200, 6
    x = (rng.random((n, m)) < 0.4).astype(float)
    latent = x @ np.array([2.0, -1, 0, 0, 1, 0]) + rng.logistic(size=n)
    grades = (latent > 0.5).astype(int) + (latent > 2.0)
    row, word = np.nonzero(x)
    w, cuts = toxicity.fit(grades, row, word, x[row, word], m, penalty=0.0, steps=3000)

    def loss(w, cuts):
        s = 1 / (1 + np.exp(cuts[None, :] - (x @ w)[:, None]))
        p = np.hstack((np.ones((n, 1)), s)) - np.hstack((s, np.zeros((n, 1))))
        return -np.log(p[np.arange(n), grades]).mean()

    best = loss(w, cuts)
    for i in range(m):
        for d in (-0.01, 0.01):
            v = w.copy()
            v[i] += d
            assert loss(v, cuts) >= best - 1e-6
    assert all(loss(w, cuts + np.array(d)) >= best - 1e-6 for d in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]))


def test_op4_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = cases.awkward(spark)
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    none = toxicity.train(cases.empty(spark), labels)
    assert toxicity.keep_clean(docs, none).count() == docs.count() and toxicity.score(cases.empty(spark), none).count() == 0


# ------------------------------------------------------------------ mixing


def test_flow_spreads_repeats_and_serves_overlaps():
    # pattern 1 is shared by both sources: flow of least cost repeats no pattern while another has room
    given = mixing.route([10, 10, 10], [[0], [0, 1], [1]], [15, 15])
    assert [sum(g.values()) for g in given] == [10, 10, 10]
    given = mixing.route([10, 10], [[0], [0]], [50])
    assert [sum(g.values()) for g in given] == [25, 25] or sorted(sum(g.values()) for g in given) == [20, 30]
    assert sum(mixing.route([10], [[0]], [100])[0].values()) == 30


def test_targets_water_fill():
    got = mixing.targets([1, 100, 100], [3, 1, 2])
    assert abs(sum(got) - 201) < 1e-9 and got[0] == 3 and got[2] == 2 * got[1]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_op5_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), ["a"] if i % 3 else ["a", "b"]) for i in range(300)], "doc_id long, text string, of array<string>")
    got = frame(mixing.mix(docs, F.col("of")))
    assert (got["__taken"] <= 3 * got["__size"]).all() and len(got) == 300
    assert frame(mixing.mix(docs, F.col("of")))["__taken"].sum() == got["__taken"].sum()


def test_op5_overlapping_sources_share_out_the_excess(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), ["a"] if i % 30 else ["a", "b"]) for i in range(300)], "doc_id long, text string, of array<string>")
    got = frame(mixing.mix(docs, F.col("of")))
    small = got["__size"][got["__pattern"].str.contains("b")].sum()
    target = got["__target"][~got["__pattern"].str.contains("b")].iloc[0]
    assert abs(target + 3 * small - got["__size"].sum()) < 1e-6


def test_op5_awkward(spark):
    docs = cases.awkward(spark)
    got = frame(mixing.mix(docs, F.array("source")))
    assert len(got) == docs.count() and (got["__taken"] <= 3 * got["__size"]).all()
    for _, own in got.groupby("__pattern"):
        assert abs(own["__taken"].sum() - own["__target"].iloc[0]) <= 0.5
    assert mixing.repeat(docs, F.array("source")).columns == docs.columns
    assert mixing.mix(cases.empty(spark), F.array("source")).count() == 0


# ------------------------------------------------------------------ packing


def test_configurations_and_best_fit_cover_the_histogram():
    r = random.Random(2)
    for _ in range(20):
        histogram = {n: r.randrange(1, 50) for n in r.sample(range(1, 101), 30)}
        plan = packing.best_fit(histogram, packing.configurations(histogram, 100, 40), 100)
        made: dict = {}
        for items, n in plan:
            assert sum(items) <= 100
            for i in items:
                made[i] = made.get(i, 0) + n
        assert made == histogram
        bound = -(-sum(k * v for k, v in histogram.items()) // 100)
        assert sum(n for _, n in plan) <= max(bound * 1.03, bound + 2) or max(histogram) > 50


def test_knapsack_is_optimal():
    lengths, price = np.array([3, 5, 7]), np.array([0.4, 0.9, 1.2])
    best = max(a * 0.4 + b * 0.9 + c * 1.2 for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 22)
    assert abs(price[packing._best_pattern(lengths, price, 22)].sum() - best) < 1e-9


def check_packing(got, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for own in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for p in own[1].itertuples():
            assert p.offset == at
            at += p.length
        assert at <= 4096
    want = []
    for k, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k, i // 4096, i, min(4096, len(ids) - i), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]
    have = [(None if pd.isna(p.doc_id) else int(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in got.itertuples()]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_op8_against_the_library(spark):
    got = frame(packing.query(spark, SF))
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    check_packing(got, zip(docs.doc_id, docs.text, strict=True))
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_op8_awkward(spark):
    docs = cases.awkward(spark)
    check_packing(frame(packing.pack_documents(docs)), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.pack_documents(cases.empty(spark)).count() == 0


# ------------------------------------------------------------------ pages


def test_op9_on_the_table(spark):
    import html

    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = frame(html_text.query(spark, SF)).set_index("page_id")
    for k, x in zip(pages.page_id, pages.html, strict=True):
        article = re.search(r"<article>(.*?)</article>", x, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got.text[k] == "\n".join(b for b in blocks if b) and got.n_chars[k] == len(got.text[k])


def test_op9_longest_common_subsequence():
    def plain(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        return size[-1][-1]

    r = random.Random(1)
    for _ in range(500):
        a, b = (r.choices("abcd", k=r.randrange(12)) for _ in range(2))
        found = html_text.common(a, b)
        rest = iter(b)
        assert len(found) == plain(a, b) and all(a[i] in rest for i in sorted(found))


def test_op9_shared_lines_go_and_own_lines_stay(spark):
    page = lambda own: f"<html><head><title>t</title></head><body><div>Site name</div><div class='cookie-notice'>Cookies</div><div><p>{own}<p>Read on</div><aside>More</aside><form>Mail</form><div id=comments>First!</div><script>var x='<p>no</p>';</script><div>All rights reserved</div></body></html>"
    rows = [(1, "http://h/a/1", page("One &amp; two")), (2, "http://h/a/2", page("Three<br>four")), (3, "http://other/x", page("Alone")), (4, None, None), (5, "http://h/z/9", page("One &amp; two").replace("<div><p>", "<article><p>").replace("Read on</div>", "Read on</article>"))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, __host long, text long").repartition(1)
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[2] == "Three four"
    assert got[3] == "Site name\nAlone\nRead on\nAll rights reserved"  # no neighbour: markup alone
    assert got[4] == "" and "One & two\nRead on" in got[5]
    assert html_text.extract(df.limit(0)).count() == 0


def test_op9_one_page_under_two_addresses(spark):
    page = lambda own, last="": f"<body><div>Site name</div><div><p>{own} and so on to the end of a text that is longer than what stands around it</div><div>All rights reserved</div>{last}</body>"
    rows = [(1, "http://h/a?x=1", page("One")), (2, "http://h/a?x=2", page("One")), (3, "http://h/a?x=3", page("One", "<p>12:01")), (4, "http://h/b", page("Two")), (5, "http://twin/a", page("Six")), (6, "http://twin/b", page("Six"))]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()}
    text = " and so on to the end of a text that is longer than what stands around it"
    assert [got[k]["text"] for k in (1, 2, 3, 4)] == ["One" + text, "One" + text, "One" + text + "\n12:01", "Two" + text]
    assert got[1]["near_url"] == got[2]["near_url"] == "http://h/b"
    assert "Six" + text in got[5]["text"] and got[5]["near_url"] is None


def test_op9_partners_stand_behind_any_number_of_copies(spark):
    page = lambda own, last="": f"<body><div>Site name</div><div><p>{own} and so on to the end of a text that is longer than what stands around it, twice as long as that and more</div><div>All rights reserved</div>{last}</body>"
    rows = [(i, f"http://h/m?x={i}", page("One")) for i in range(30)] + [(100 + i, f"http://h/n/{i:02}", page("One", f"<p>12:{i:02}")) for i in range(90)]
    rows += [(300, "http://h/z", page("Two")), (400, "http://twin/a", page("Six"))] + [(401 + i, f"http://twin/b{i}", page("Six")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = " and so on to the end of a text that is longer than what stands around it, twice as long as that and more"
    for n, p in ((1, 1), (4, 30)):
        got = {r["page_id"]: r for r in html_text.extract(df.repartition(n), parts=p).collect()}
        assert len(got) == len(rows)
        assert all(got[k]["text"] == "One" + text and got[k]["near_url"] == "http://h/z" for k in range(30))
        assert all(got[100 + i]["text"] == f"One{text}\n12:{i:02}" and got[100 + i]["n_deleted"] == 2 for i in range(90))
        assert got[300]["text"] == "Two" + text and all("Site name" in got[400 + i]["text"] and got[400 + i]["near_url"] is None for i in range(21))


def test_op9_texts_do_not_depend_on_parts(spark):
    r = random.Random(2)
    page = lambda i: f"<body><div>Site name</div><div>Section {i // 7}</div><p>Own text of page {i} " + "and more " * r.randrange(30) + f"</p><div>{'Read on' if i % 3 else 'Stop'}</div><div>All rights reserved</div></body>"
    rows = [(i, f"http://h/{i // 5}/{i}", page(i)) for i in range(40)]
    rows += [(100 + i, f"http://h/3/15?copy={i}", rows[15][2]) for i in range(5)] + [(100, "http://h/3/15?copy=0", rows[15][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [sorted((x["page_id"], x["url"], x["text"], x["near_url"]) for x in html_text.extract(df.repartition(n), parts=p).collect()) for n, p in ((1, 1), (3, 8), (5, 40), (2, 200))]
    assert texts[0] == texts[1] == texts[2] == texts[3] and len(texts[0]) == len(rows)
    assert all("Site name" not in x[2] and "Own text" in x[2] for x in texts[0])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article class="post with-sidebar"><p>Kept</p></article>', "Kept"),
        ('<div class="content share-enabled"><p>Kept</p></div>', "Kept"),
        ('<div id="main" class="no-sidebar"><p class="notice-period">Kept</p></div>', "Kept"),
        ('<article><div class="article-header"><h1>Kept</h1></div><p>Too</p><div class="share-buttons">Share</div></article>', "Kept\nToo"),
        ('<div class="main-nav">Menu</div><div class="cookie_notice">Cookies</div><p>Kept</p><div id=related-posts>More</div><section class="comment-list"><p>First!</p></section>', "Kept"),
        ("<html><head><title>T</title><meta charset=x><body><p>Kept</p></body></html>", "Kept"),
        ("<head><title>T</title><p>Kept</p>", "Kept"),
        ("<p>a<svg/>b</p><iframe src=x /><p>c<select><option>d", "ab\ncd"),
        ("<p>a</p><script>var x = '<p>no</p>'; if (a < b) {", "a"),
        ("<p>long " + "words " * 40_000 + "</p>", "long " + " ".join(["words"] * 40_000)),
    ],
)
def test_op9_markup(page, text):
    assert html_text.main_text(html_text.lines(page), None)[0] == text


def test_op9_differencing_deletes_lines_of_the_table(spark):
    got = frame(html_text.query(spark, "/root/testdata/sf0.01"))
    assert got.n_deleted.sum() > 0 and got.near_url.notna().mean() > 0.9
