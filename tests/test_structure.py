import re

from lectern.operators import fusion, structure
from lectern.streaming import requests


def test_prose_is_packed_without_loss_or_overlap():
    text = " ".join(f"Sentence marker{i} has some words in it to fill the line." for i in range(120))
    parts = structure.pack(structure.atoms(text), 6)
    assert len(parts) > 1 and all(structure.words(p) + 6 <= structure.MOST for p in parts)
    assert [m for p in parts for m in re.findall(r"marker(\d+)", p)] == [str(i) for i in range(120)]


def test_long_step_is_labelled():
    parts = structure.fit("1. " + " ".join(f"w{i}" for i in range(700)) + ".", 6)
    assert len(parts) > 1 and all(p.startswith(f"Step 1 — Part {i}\n1. ") for i, p in enumerate(parts, 1))
    assert [w for p in parts for w in p.split() if re.fullmatch(r"w\d+\.?", w)] == [f"w{i}" for i in range(699)] + ["w699."]


def test_short_tail_joins():
    assert len(structure.pack(["a " * 150, "b " * 30], 0)) == 1
    assert len(structure.pack(["a " * 210, "b " * 30], 0)) == 2


def test_orphan_warning_gives_nothing():
    assert structure.build_units([{"kind": "warning", "text": "x", "page": 1}]) == []


def test_annotation_stays_with_its_unit():
    made = structure.build_units([{"kind": "concept", "text": "a", "page": 1}, {"kind": "warning", "text": "w", "page": 1}])
    assert [(u.kind, u.notes) for u in made] == [("concept", ["w"])]


def test_tables_with_one_header_join_on_the_next_page_only():
    table = lambda page, cell: {"kind": "table", "text": "T", "page": page, "rows": [["h", "i"], [cell, cell]]}
    assert [len(u.rows) for u in structure.build_units([table(20, "1"), table(21, "2")])] == [3]
    assert [len(u.rows) for u in structure.build_units([table(20, "1"), table(22, "2")])] == [2, 2]


def test_table_parts_repeat_the_header_and_keep_rows():
    rows = [["Name", "Meaning"]] + [[f"r{i}", "word " * 35] for i in range(12)]
    parts = structure.table_segments("T", rows)
    assert len(parts) > 1 and all("| Name | Meaning |" in p for p, _ in parts) and sum(n for _, n in parts) == 12
    long = structure.table_segments("T", [["Name", "Meaning"], ["r", " ".join(f"x{i}" for i in range(600))]])
    assert len(long) > 1 and all("Column:" in p for p, _ in long)


def test_fusion_scores_and_keeps_first_insertion(spark):
    hits = spark.createDataFrame([(1, 0, 1, 1.0, "s"), (1, 0, 2, 1.0, "v"), (1, 1, 1, 1.0, "s"), (1, 1, 2, 1.0, "b")], "q long, list_ix int, rank int, weight double, k string")
    out = fusion.rank_fused(fusion.fuse(hits, "q", "k"), "q", "k", 3).orderBy("rank").collect()
    assert [r["k"] for r in out] == ["s", "v", "b"] and abs(out[0]["score"] - 2 / 61) < 1e-9


def test_diversity_prefers_another_kind(spark):
    rows = [(1, "e", "heading", 1, "a"), (1, "e", "heading", 2, "b"), (1, "e", "body", 3, "c"), (1, None, "body", 4, "d"), (1, None, "body", 5, "x"), (1, None, "body", 6, "y")]
    df = spark.createDataFrame(rows, "q long, parent string, kind string, rank int, k string")
    assert sorted(r["k"] for r in fusion.diverse(df, "q", "parent", "kind", "rank").collect()) == ["a", "c", "d", "x", "y"]


def test_streams_give_what_tables_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in requests.rate_sessions(events).collect()}
    q = requests.rate_sessions(live).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done = {tuple(r) for r in spark.table("sessions").collect()}
    assert done and done <= batch  # what the watermark hasn't closed is still open


def test_first_owner_keeps_a_thread(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 10), (1, "a", 50), (1, "b", 100), (1, "b", 120)], "thread long, who string, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = requests.first_owner(live, "thread", "who", 60).writeStream.format("memory").queryName("claims").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["who"], r["granted"]) for r in spark.table("claims").collect()] == [("a", True), ("b", False), ("a", True), ("b", False), ("b", True)]


def test_representations_by_whole_text_over_all_documents(spark):
    same = "A long heading that comes again and again"
    units = [
        (1, 0, "concept", "Work Center", "Work Center: a place. It has a Manufacturing Execution System (MES). More.", None, None, None),
        (1, 1, "procedure", same + " one", "1. Open\n2. Close", None, None, None),
        (2, 0, "procedure", same + " two", "1. Go", None, None, None),
        (3, 0, "field_definition", "WORK  center", "Fields", "Part 7", ["Name", "Meaning"], [["Lot", "a batch", "x"], [" ", "none"]]),
        (4, 0, "field_definition", None, "", "Part 8", ["Name", "Meaning"], []),
        (5, 0, "concept", None, " ".join(["word"] * 300), None, None, None),
    ]
    df = spark.createDataFrame(units, "doc long, unit long, kind string, section string, text string, title string, headers array<string>, rows array<array<string>>")
    got = sorted((r["doc"], r["unit"], r["type"], r["text"]) for r in structure.representations(df).collect())
    assert got == sorted([
        (1, 0, "heading", "Heading:\nWork Center"), (1, 0, "definition", "Definition:\na place. It has a Manufacturing Execution System (MES)."), (1, 0, "acronym_alias", "Acronym: MES\nMeaning: It has a Manufacturing Execution System"),
        (1, 1, "heading", f"Heading:\n{same} one"), (1, 1, "procedure_title", f"Procedure:\n{same} one"), (2, 0, "heading", f"Heading:\n{same} two"), (2, 0, "procedure_title", f"Procedure:\n{same} two"),
        (3, 0, "table_title_headers", "Table: Part 7\nColumns:\nName | Meaning"), (3, 0, "field_name_description", "Field: Lot\nName: Lot | Meaning: a batch | Column 3: x"),
        (5, 0, "definition", "Definition:\n" + " ".join(["word"] * 219)), (5, 0, "definition", "Definition:\n" + " ".join(["word"] * 81)),
    ])
