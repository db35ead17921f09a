from __future__ import annotations

from fieldloom.sources import tables


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m1", "p1", "2024-01-01", "2000-01-01", "A", "S", "O", "H", 0.1), ("m2", "p2", None, None, "A", "S", "O", "A", None)], tables.TARGETS)
    tables.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(str, tables.read_csv(spark, str(tmp_path / "t"), tables.TARGETS).collect())) == sorted(map(str, df.collect()))


def test_files(spark, tmp_path):
    p = str(tmp_path / "x.json")
    tables.write_json({"b": 1, "a": [1, 2]}, p)
    assert tables.read_json(p) == {"a": [1, 2], "b": 1}
    for i in (1, 2):
        tables.append_ledger({"id": i, "other": 0}, str(tmp_path / "l.csv"), ("id", "score"))
    assert (tmp_path / "l.csv").read_text().split() == ["id,score", "1,", "2,"]
    tables.write_names(["a", "b"], str(tmp_path / "n"))
    assert tables.read_names(str(tmp_path / "n")) == ["a", "b"]
    assert tables.missing_files([p, str(tmp_path / "none")]) == [str(tmp_path / "none")]
    assert len(tables.split_id("group_kfold", 5, 42)) == 8


def test_fingerprint_is_blind_to_order_and_sees_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    print_ = lambda df: tables.fingerprint(df).first()["fingerprint"]
    assert print_(a) == print_(a.orderBy("k", ascending=False)) != print_(a.where("k = 1"))
    assert tables.profile(a).collect()[1]["nulls"] == 1
    assert tables.fingerprint(a.where("false")).first()["rows"] == 0
