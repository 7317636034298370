import pytest
from pyspark.sql import functions as F

from sparloom.operators import cdc as C
from sparloom.operators import relational as R
from sparloom.sources import files as S
from sparloom.streaming.changes import ChangeCapture, capture_changes


@pytest.fixture(scope="module")
def snapshots(spark):
    kind = "k int, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, "it's", None), (3, "z", 3), (4, "same", 4)], kind)
    new = spark.createDataFrame([(1, "y", 1), (3, None, 4), (4, "same", 4), (5, "n", 5)], kind)
    return old, new


def rows(df, *columns):
    return sorted(map(str, (tuple(r) for r in (df.select(*columns) if columns else df).collect())))


def test_diff(snapshots):
    log = C.snapshot_diff(*snapshots, ["k"], table="T")
    got = rows(log, "primary_key_1", "change_type", "changed_field_name", "old_value", "new_value")
    assert got == sorted(map(str, [("1", "UPDATE", "a", "x", "y"), ("2", "DELETE", "a", "it's", None), ("3", "UPDATE", "a", "z", None), ("3", "UPDATE", "b", "3", "4"), ("5", "INSERT", "a", None, "n"), ("5", "INSERT", "b", None, "5")]))


def test_tracked_fields(snapshots):
    rules = [{"table_name": "t ", "field_name": "A", "log_update": 1}, {"table_name": "T", "field_name": "*", "log_insert": 1}]
    kinds = C.tracked_fields(rules, "T", ["a", "b"])
    assert kinds == {"a": {"UPDATE", "INSERT"}, "b": {"INSERT"}}
    log = C.snapshot_diff(*snapshots, ["k"], table="T", kinds=kinds)
    assert rows(log.groupBy("change_type").count()) == sorted(map(str, [("UPDATE", 2), ("INSERT", 2)]))


def test_apply_and_undo(snapshots):
    old, new = snapshots
    log = C.with_change_ids(C.snapshot_diff(old, new, ["k"], table="T"))
    assert rows(C.apply_changes(old, log, ["k"])) == rows(new)
    back = C.with_change_ids(C.snapshot_diff(new, old, ["k"], table="T"))
    assert rows(C.apply_changes(new, back, ["k"])) == rows(old)


def test_rows_of_nulls_are_logged_and_undone(spark):
    kind = "k int, a string, b int"
    old = spark.createDataFrame([(1, None, None), (2, "x", None), (3, "y", 3)], kind)
    new = spark.createDataFrame([(2, None, None), (3, "y", 3), (4, None, None)], kind)
    log = C.with_change_ids(C.snapshot_diff(old, new, ["k"], table="T"))
    got = rows(log, "primary_key_1", "change_type", "changed_field_name", "old_value", "new_value")
    assert got == sorted(map(str, [("1", "DELETE", None, None, None), ("2", "UPDATE", "a", "x", None), ("4", "INSERT", None, None, None)]))
    assert rows(C.apply_changes(old, log, ["k"])) == rows(new)
    back = C.with_change_ids(C.snapshot_diff(new, old, ["k"], table="T"))
    assert rows(C.apply_changes(new, back, ["k"])) == rows(old)
    assert {r["primary_key_1"]: r["restore_stmt"] for r in C.restore_statements(log, ["T"]).collect()}["1"] == "insert into T(k) values ('1');"
    assert C.snapshot_diff(old, new, ["k"], kinds={"a": {"UPDATE"}}).count() == 1


def test_values_are_whole_and_keys_few(spark):
    long = "z" * 40_000
    log = C.with_change_ids(C.snapshot_diff(spark.createDataFrame([(1, long)], "k int, a string"), spark.createDataFrame([(1, "b")], "k int, a string"), ["k"], table="T"))
    assert log.first()["old_value"] == long and long in C.restore_statements(log, ["T"]).first()["restore_stmt"]
    wide = spark.createDataFrame([(1, 1, 1, 1, "a")], "k int, l int, m int, n int, a string")
    with pytest.raises(ValueError, match="three fields"):
        C.snapshot_diff(wide, wide, ["k", "l", "m", "n"])


def test_one_row_or_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "c"), (4, "d")], "k int, v string")
    assert rows(R.unique_or_nothing(df, ["k"], "v")) == rows(spark.createDataFrame([(1, "a"), (3, None)], "k int, v string"))


def test_restore_statements(spark, snapshots):
    log = C.with_change_ids(C.snapshot_diff(*snapshots, ["k"], table="T"))
    got = {r["primary_key_1"]: r["restore_stmt"] for r in C.restore_statements(log, ["T"]).collect()}
    assert got["1"] == "update T set k = k, a = 'x' /* old: y*/ where k = '1';"
    assert got["2"] == "insert into T(k, a) values ('2', 'it''s');"
    assert got["3"] == "update T set k = k, b = '3' /* old: 4*/, a = 'z' /* old: null*/ where k = '3';"
    assert set(got) == {"1", "2", "3"}
    assert C.restore_statements(log, ["OTHER"]).isEmpty()
    twice = log.filter("primary_key_1 = '1'").unionByName(log.filter("primary_key_1 = '1'").select(*[c for c in log.columns if c not in ("old_value", "new_value", "change_id")], F.lit("y").alias("old_value"), F.lit("w").alias("new_value"), (F.col("change_id") + 100).alias("change_id")))
    assert C.restore_statements(twice, ["T"]).first()["restore_stmt"] == "update T set k = k, a = 'x' /* old: w*/ where k = '1';"


def test_logs(spark):
    kind = "object_type string, object_name string, stmt string, checked int"
    stored = spark.createDataFrame([("t", "A", "1", 1), ("t", "A", "2", 2), ("t", "B", "1", 1)], kind)
    now = spark.createDataFrame([("t", "A", "1"), ("t", "B", "1"), ("t", "N", "1")], "object_type string, object_name string, stmt string")
    assert rows(C.structure_changes(stored, now, F.lit(9))) == sorted(map(str, [("t", "A", "1", 1), ("t", "A", "2", 2), ("t", "A", "1", 9), ("t", "B", "1", 9), ("t", "N", "1", 9)]))
    a, h = spark.createDataFrame([(1, None)], "x int, y string"), spark.createDataFrame([(1, None), (2, None)], "x int, y string")
    assert rows(C.import_history(a, h, ["x", "y"])) == ["(1, None)", "(2, None)"]
    s = C.merge_settings(spark.createDataFrame([("k", "mine", "old")], "key string, val string, description string"), spark.createDataFrame([("k", "d", "new"), ("j", "d", "x")], "key string, val string, description string"))
    assert rows(s) == ["('j', 'd', 'x')", "('k', 'mine', 'new')"]
    e = C.enriched(spark.createDataFrame([("me", None), (None, None)], "who string, changed timestamp"), {"who": "ctx", "role": None}, F.lit("2024-01-01").cast("timestamp"))
    assert rows(e, "who", "role") == ["('ctx', None)", "('me', None)"]
    r = C.normalised_rules(spark.createDataFrame([(" t", "a ", None)], "table_name string, field_name string, log_insert int"))
    assert tuple(r.first()) == ("T", "A", 0)


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 1), (2, "c", 2)], "k int, v string, o int")
    assert rows(R.unique_or_nothing(df, ["k"], "v"), "k", "v") == []  # two equal rows are two rows
    assert rows(R.latest(df, ["k"], ["o"], ["v"])) == ["(1, 'a')", "(2, 'c')"]
    assert rows(R.listed(df, ["k"], F.col("v"), -F.col("o"), "|", "l")) == ["(1, 'a|a')", "(2, 'c|b')"]
    assert R.within_budget(df, ["k"], "o", F.lit(2), 3).count() == 2


def test_size_report(spark, tmp_path):
    (tmp_path / "r.txt").write_text("BIG (128)\n    Primary pages: 1, total records: 20\n    Data pages: 9, x\nSMALL (129)\n    a, total records: 3\n    Data pages: 2\n")
    assert [tuple(r) for r in S.table_size_report(spark, str(tmp_path / "r.txt")).collect()] == [("SMALL", 3, 2), ("BIG", 20, 9)]


def test_publish_and_retention(spark, tmp_path):
    path = str(tmp_path / "out")
    assert S.publish(spark.range(10), path)[0] == 10
    assert S.publish(spark.range(3), path)[0] == 3 and spark.read.parquet(path).count() == 3
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, mtime int")
    assert rows(S.expired(f, 2), "path") == ["('a',)", "('b',)"]


def test_stream(spark, tmp_path):
    src, state, log = str(tmp_path / "src"), str(tmp_path / "state"), str(tmp_path / "log")
    capture = ChangeCapture(state, ["k"], "T", lambda df, i: df.write.mode("overwrite").parquet(f"{log}/{i}"))
    kind = "k int, v string"
    for batch in ([(1, "a"), (2, "b")], [(2, "c")]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(src)
        q = capture_changes(spark.readStream.schema(kind).parquet(src), str(tmp_path / "check"), capture)
        q.awaitTermination(120)
    assert rows(spark.read.parquet(f"{log}/1"), "change_type", "old_value", "new_value") == ["('UPDATE', 'b', 'c')"]
    assert rows(spark.read.parquet(f"{state}/1")) == ["(1, 'a')", "(2, 'c')"]


def test_stream_of_several_versions(spark, tmp_path):
    """The highest order counts whatever the partitions, a batch run again gives the same, old states go."""
    logs = {}
    capture = ChangeCapture(str(tmp_path / "state"), ["k"], "T", lambda df, i: logs.setdefault(i, []).append(rows(df, "change_type", "changed_field_name", "new_value")), order="at", keep=2)
    batch = lambda *r: spark.createDataFrame(r, "k int, v string, at int")
    for parts in (1, 3):  # run again after a failure
        capture(batch((1, "old", 1), (1, "new", 2), (2, "x", 5), (2, "w", 4)).repartition(parts), 0)
    assert logs[0][0] == logs[0][1] and "('INSERT', 'v', 'new')" in logs[0][0] and "('INSERT', 'v', 'x')" in logs[0][0]
    capture(batch((1, "z", 3)), 1)
    capture(batch((2, "q", 9)), 2)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["1", "2"]
    assert rows(spark.read.parquet(str(tmp_path / "state" / "2")), "k", "v") == ["(1, 'z')", "(2, 'q')"]
