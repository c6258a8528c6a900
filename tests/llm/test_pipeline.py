import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

pytest.importorskip("lectern.llm")
import cases  # noqa: E402
from oracle import SF  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from lectern.llm import jaccard_join, mixing, scratch, toxicity  # noqa: E402


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in pipeline.STAGES:
        after = scratch.keep(stage(spark, docs, SF), "t")
        seen.append((name, docs.toPandas(), after.toPandas(), after.columns))
        docs = after
    assert all(columns == names for *_, columns in seen[:-1])
    (_, a0, a1, _), (_, b0, b1, _), (_, c0, c1, _), (_, d0, d1, _), (_, e0, e1, _) = seen

    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    clean = [k for k, t in zip(a0.doc_id, a0.text, strict=True) if model.chances(toxicity._terms(t))[0] < toxicity.REJECT]
    assert sorted(a1.doc_id) == sorted(clean) and len(a1) < len(a0)

    first = b0.assign(s=[hashlib.sha256((t or "").encode()).hexdigest() for t in b0.text]).groupby("s").doc_id.min()
    assert sorted(b1.doc_id) == sorted(first)

    assert sorted(c1.doc_id) == sorted(k for k, c in cases.components(c0).items() if k == c)

    size = {k: len(cases.WORD.findall(t)) for k, t in zip(d0.doc_id, d0.text, strict=True)}
    sources = sorted(d0.source.unique())
    sums = [sum(size[k] for k in d0[d0.source == s].doc_id) for s in sources]
    for s, target in zip(sources, mixing.targets(sums, [1 + i % 3 for i in range(len(sources))]), strict=True):
        own = d1[d1.source == s].doc_id
        assert abs(sum(size[k] for k in own) - target) <= max(size[k] for k in d0[d0.source == s].doc_id)
    assert d1.doc_id.value_counts().max() <= 3

    assert e1.groupby("sequence_id").length.sum().max() <= 4096 and (e1.piece == 0).sum() == len(e0)
    whole = pipeline.run(spark, SF).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(whole[cols].sort_values(cols).reset_index(drop=True), e1[cols].sort_values(cols).reset_index(drop=True))


def test_training_takes_little_memory_on_the_driver(spark):
    """Words of single documents are most of the vocabulary; no feature of theirs is held."""
    docs = [(k, " ".join([f"{''.join(chr(97 + int(c)) for c in str(k * 1000 + i))}word" for i in range(1000)] + (["vile", "nasty"] if k % 2 else ["kind", "good"]))) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, toxic int")
    tracemalloc.start()
    model = toxicity.train(df, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.chances(["vile"])[0] > 0.5 > model.chances(["kind"])[0]
    assert peak < 60_000_000


def test_scans_of_the_join_take_little_memory_in_a_worker():
    """Shingles are cut and counted little by little, however large a batch is; sets of many rows aren't all objects at once."""

    class Rows:
        """Takes the function that mapInArrow gets."""

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    texts = [" ".join(f"w{(k * 7919 + i * i) % 50_021}" for i in range(1000)) for k in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(range(1500), pa.int64()), pa.array(texts)], ["k", "h", "text"])
    scan = jaccard_join.sets(Rows())
    tracemalloc.start()
    found = sum(out.num_rows for out in scan(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 1500 + jaccard_join.COUNTERS // jaccard_join.BLOCK and peak < 50_000_000

    rows = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array([b"x" * 10_000] * 4000)], ["b", "s"])
    tracemalloc.start()
    assert [b for b, _ in jaccard_join._rows(rows)] == list(range(4000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000


def test_sketch_counts_are_those_of_every_shingle():
    counts = np.zeros(1 << 8, np.uint32)
    values = np.random.default_rng(5).integers(0, 1 << 63, 5000).astype(np.uint64)
    for part in np.split(values, [10, 10, 3000]):
        jaccard_join._count(counts, part)
    assert (counts == np.bincount((values & np.uint64(255)).astype(np.int64), minlength=256)).all()


@pytest.mark.parametrize("make", [cases.empty, cases.awkward])
def test_stages_take_awkward_tables(spark, make):
    docs = make(spark)
    for name, stage in pipeline.STAGES:
        after = scratch.keep(stage(spark, docs, SF), "t")
        assert name == "best_fit_packing" or after.columns == docs.columns
        docs = after
