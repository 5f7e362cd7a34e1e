import pytest

from tidemill.operators import checks as C


def test_project_features(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, t double, b string")
    assert C.project_features(df, "t").columns == ["a", "b", "t"]
    assert C.project_features(df, "t", ["b"]).columns == ["b", "t"]
    for target, features in [("z", None), ("t", ["z"]), ("t", []), ("t", ["t"])]:
        with pytest.raises(ValueError):
            C.project_features(df, target, features)


def test_owner_check(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, 1), (3, None, None), (4, 1, 1)], "id int, user_id int, session_id int")
    assert {(r.id, r.problem) for r in C.owner_violations(df).collect()} == {(3, "no owner"), (4, "two owners")}


def test_reconcile_and_existence(spark):
    a = spark.createDataFrame([("A",), ("B",), ("B",)], "name string")
    b = spark.createDataFrame([("B",), ("C",)], "name string")
    assert {tuple(r) for r in C.reconcile_keys(a, b, ["name"]).collect()} == {("A", "left_only"), ("C", "right_only")}
    assert [r.name for r in C.existing(a, b, {"name": "name"}).collect()] == ["B", "B"]
    orphan = C.orphans(spark.createDataFrame([("A",), (None,)], "name string"), b, {"name": "name"})
    assert [r.name for r in orphan.collect()] == ["A"]


def test_duplicate_positions(spark):
    df = spark.createDataFrame([("a", 5), ("a", 2), ("a", 9), ("b", 1)], "k string, pos int")
    assert [tuple(r) for r in C.duplicate_keys(df, ["k"], "pos").collect()] == [("a", 3, 2, 5)]


def test_duplicates_are_counted_before_rows_are_sorted(spark, capfd):
    df = spark.createDataFrame([(None, 1, 4), (None, 1, 3), ("a", 2, 5), ("a", 2, 2), ("a", None, 9), ("b", 1, 1)], "k string, l int, pos int")
    found = C.duplicate_keys(df, ["k", "l"], "pos")
    assert {tuple(r) for r in found.collect()} == {(None, 1, 2, 3, 4), ("a", 2, 2, 2, 5)}  # null is a key, as in GROUP BY
    found.explain()
    assert "count(1)" not in capfd.readouterr().out


def test_sessions_and_reassignment(spark):
    rows = spark.createDataFrame([(1, 10), (1, 20), (1, 21), (2, 5)], "s int, ts int")
    sessions = spark.createDataFrame([(1, 20)], "s int, expires_at int")
    assert sorted(r.ts for r in C.valid_session_rows(rows, sessions, "s", "ts").collect()) == [10, 20]
    jobs = spark.createDataFrame([(1, None, 7), (2, 3, None), (3, None, 8)], "id int, user_id int, session_id int")
    mapping = spark.createDataFrame([(7, 70)], "session_id int, new_user_id int")
    assert {tuple(r) for r in C.reassign_owner(jobs, mapping).collect()} == {(1, 70, None), (2, 3, None), (3, None, 8)}
