import pytest
from oracle import SF, connect, rows

from lectern import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(catalog.queries())


def test_top_lists_stop_early(spark):
    from lectern.operators import lexical

    scored = spark.createDataFrame([(1, 2, 0.5)], "q long, k long, score double")
    assert "WindowGroupLimit" in lexical.top(scored, ["q"], "k", 3)._jdf.queryExecution().toString()


def test_lexical_index_in_blocks_and_by_state(spark, tmp_path, monkeypatch):
    from lectern.operators import lexical

    rows = [(1, "red fish blue fish"), (2, "one fish"), (3, None), (4, ""), (5, "Blue whale"), (None, "red red")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id long, text string").write.parquet(path)
    questions = spark.createDataFrame([(7, "fish fish"), (8, "blue"), (9, "nothing here"), (10, "")], "q long, text string")
    one = lexical.index(spark.read.parquet(path), "id")
    assert lexical.index(spark.read.parquet(path), "id").chunks.inputFiles() == one.chunks.inputFiles()
    best = sorted((r["q"], r["rank"], r["id"]) for r in lexical.search(one, questions, "q", 2).collect())
    assert best == [(7, 1, 1), (7, 2, 2), (8, 1, 5), (8, 2, 1)]
    monkeypatch.setattr(lexical, "ASKED", 1)
    assert sorted((r["q"], r["rank"], r["id"]) for r in lexical.search(one, questions, "q", 2).collect()) == best
    spark.createDataFrame([(6, "fish")], "id long, text string").write.mode("append").parquet(path)
    assert lexical.index(spark.read.parquet(path), "id").chunks.count() == 7  # other files, another index
    assert lexical.search(lexical.index(spark.createDataFrame([], "id long, text string"), "id"), questions, "q", 2).count() == 0
