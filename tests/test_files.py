import pytest

from lectern.sources import files


def test_folder_scan_hashes_and_skips_subfolders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.pdf").write_text("y")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("z")
    rows = files.scan_folder(spark, str(tmp_path), "*.txt").collect()
    assert [(r["name"], r["sha256"][:8]) for r in rows] == [("a.txt", "2d711642")]


def test_missing_json_is_empty(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none.json"), "a long").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": "no"}]')
    assert sorted(str(r["a"]) for r in files.read_json(spark, str(tmp_path / "x.json"), "a long").collect()) == ["1", "None"]


def test_index_is_published_whole_and_refuses_other_versions(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    files.publish({"t": spark.range(3).toDF("id")}, folder)
    files.publish({"t": spark.range(5).toDF("id")}, folder)
    assert files.load(spark, folder)["t"].count() == 5
    monkeypatch.setattr(files, "SCHEMA_VERSION", 2)
    with pytest.raises(files.IndexMismatch):
        files.load(spark, folder)


def test_manifest_states(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    before = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in files.manifest_diff(now, before).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "removed"}
