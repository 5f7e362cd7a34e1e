import pytest
from pyspark.sql import functions as F

from tidemill.operators import model as M


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, 20.0 + i, "Chicago" if i % 2 else "Denver", 40 + i % 7, 400.0 + 2 * i, i % 3 == 0) for i in range(60)]
    return spark.createDataFrame(rows, "id int, temperature double, city string, humidity int, co2 double, sunny boolean")


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, None), (10.0, "a"), (None, "b")], "x double, c string")
    assert [r.x for r in M.impute_median(df, ["x"]).collect()][-1] == 3.0
    assert [r.c for r in M.impute_mode(df, ["c"]).collect()][2] == "a"


def test_unseen_category_is_all_zero(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    new = spark.createDataFrame([("a",), ("b",), ("z",)], "c string")
    hot = M.one_hot(train, new, ["c"])
    assert [r["c__hot"].toArray().tolist() for r in hot.collect()] == [[1, 0], [0, 1], [0, 0]]
    assert M.hot_slots(hot, "c").count() == 2


def test_split_is_stable(spark):
    df = spark.range(5000)
    a = {r.id for r in M.train_test_split(df, ["id"]).where("is_test").collect()}
    b = {r.id for r in M.train_test_split(df.repartition(7), ["id"]).where("is_test").collect()}
    assert a == b and 0.17 < len(a) / 5000 < 0.23


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "actual double, predicted double")
    got = M.regression_metrics(df).first()
    assert got.mse == pytest.approx(1 / 3) and got.r2 == pytest.approx(0.5)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0)], "actual double, predicted double")
    assert M.regression_metrics(flat).first().r2 is None


def test_forest(mixed):
    gaps = mixed.withColumn("city", F.when(F.col("id") != 3, F.col("city"))).withColumn(
        "humidity", F.when(F.col("id") != 4, F.col("humidity"))
    )
    got = M.train_forest(gaps, "co2", ["id"], n_estimators=5, max_depth=4)
    assert got.features == ["temperature", "city", "humidity", "sunny"]
    weights = {r.feature: r.importance for r in got.importances.collect()}
    assert set(weights) == {"temperature", "city", "humidity", "sunny"}
    assert sum(weights.values()) == pytest.approx(1.0) and max(weights, key=weights.get) == "temperature"
    metrics = got.evaluation.first()
    assert metrics["rows"] == got.predictions.count() > 0 and metrics.r2 <= 1
    assert got.configuration == {"n_estimators": 5, "max_depth": 4}


def test_forest_drops_rows_without_target(mixed):
    some = mixed.withColumn("co2", F.when(F.col("id") >= 20, F.col("co2")))
    got = M.train_forest(some, "co2", ["id"], ["temperature"], n_estimators=2, max_depth=2)
    assert got.predictions.where("id < 20").count() == 0


def test_forest_refuses_bad_input(mixed):
    with pytest.raises(ValueError, match="not numeric"):
        M.train_forest(mixed, "city", ["id"])
    with pytest.raises(ValueError, match="nsufficient"):
        M.train_forest(mixed.where("id = 1"), "co2", ["id"], ["temperature"])
    with pytest.raises(ValueError, match="max_depth"):
        M.train_forest(mixed, "co2", ["id"], max_depth=31)


def test_many_categories_train(spark):
    df = spark.range(24_000).selectExpr("id", "concat('c', id % 20000) AS name", "cast(id % 50 AS double) AS y")
    fitted = M.train_forest(df, "y", ["id"], n_estimators=1, max_depth=2)
    assert [r.feature for r in fitted.importances.collect()] == ["name"]
    assert fitted.configuration == {"n_estimators": 1, "max_depth": 2}


def test_the_forest_does_not_depend_on_how_rows_are_stored(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 13 AS double) AS a", "cast(id % 7 AS string) AS b", "cast(id % 13 * 2 + id % 7 AS double) AS y")
    one, six = (M.train_forest(df.repartition(n), "y", ["id"], n_estimators=3, max_depth=4).evaluation.first() for n in (1, 6))
    assert all(a == pytest.approx(b, rel=1e-12) for a, b in zip(one, six))


def test_a_feature_without_values_trains(spark):
    df = spark.range(60).selectExpr("id", "cast(NULL AS double) AS a", "cast(id % 5 AS double) AS b", "cast(id % 5 AS double) AS y")
    fitted = M.train_forest(df, "y", ["id"], n_estimators=2, max_depth=3)
    assert fitted.evaluation.first()["rows"] > 0 and fitted.document(spark).first()["features"] == ["a", "b"]



def test_rows_with_equal_keys_are_rows_of_their_own(spark):
    """Ten keys with thirty rows each: both sides get rows of most keys, and storage doesn't matter."""
    rows = [(k % 10, float(k), 3.0 * k + k % 7, "ab"[k % 2]) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, y double, c string")
    fits = [M.train_forest(t, "y", ["id"], n_estimators=3, max_depth=4) for t in (df.coalesce(1), df.orderBy(F.desc("x")).repartition(6))]
    assert all(a == pytest.approx(b, rel=1e-12) for a, b in zip(*(f.evaluation.first() for f in fits)))
    assert fits[0].importances.collect() == fits[1].importances.collect()
    tested = fits[0].predictions
    assert tested.select("id").distinct().count() > 5 and tested.count() < 120
    assert sorted(tested.collect()) == sorted(fits[1].predictions.collect())


def test_importances_go_to_their_own_column(spark):
    """A number whose name looks like a slot of a text column."""
    df = spark.createDataFrame([(k, "uvw"[k % 3], float(k * k % 11), float(k * k % 11)) for k in range(200)], "id int, a string, a__hot_v double, y double")
    weights = {r.feature: r.importance for r in M.train_forest(df, "y", ["id"], n_estimators=4, max_depth=5).importances.collect()}
    assert set(weights) == {"a", "a__hot_v"} and weights["a__hot_v"] > 0.9


def test_samples_are_added_up_by_vector(spark, monkeypatch):
    """Each tree takes each row a Poisson number of times, equal rows one by one, whatever pieces a vector is cut into."""
    rows = [("ab"[k % 2], float(k % 3), float(k % 40)) for k in range(2400)]
    df = spark.createDataFrame(rows, "c string, x double, y double")

    def sums():
        sizes = df.groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))
        found = M.bootstrap_sums(df.repartition(3), sizes, 6, 2400, ["c", "x"], "y", 20).select("_x.*", "*").collect()
        return {(r.c, r.x): [(r[f"w{t}"], r[f"y{t}"]) for t in range(20)] for r in found}

    whole = sums()
    assert len(whole) == 6
    taken = [w for found in whole.values() for w, _ in found]
    assert all(w == int(w) for w in taken) and abs(sum(taken) - 48_000) < 5 * 48_000**0.5
    assert len(set(taken)) > 20  # the samples of different trees and vectors differ
    mean = {x: sum(y for c, v, y in rows if (c, v) == x) / 400 for x in whole}
    assert all(sum(w * y for w, y in found) / sum(w for w, _ in found) == pytest.approx(mean[x], abs=0.7) for x, found in whole.items())
    monkeypatch.setattr(M, "PART_ROWS", 150)
    cut = sums()
    assert all([w for w, _ in cut[x]] == [w for w, _ in whole[x]] for x in whole)
    assert all([y for _, y in cut[x]] == pytest.approx([y for _, y in whole[x]]) for x in whole)


def test_few_vectors_are_trained_on_sums_and_predict_as_well(spark, monkeypatch):
    """Targets with noise over 30 vectors: as good as the forest that reads every row."""
    df = spark.range(3000).selectExpr("id", "cast(id % 10 AS double) AS a", "concat('v', id % 6) AS b", "cast(id % 10 * 3 + id % 6 + id * 7919 % 101 / 50 AS double) AS y")
    few = M.train_forest(df, "y", ["id"], n_estimators=24)
    assert [type(s).__name__ for s in few.model.stages].count("RandomForestRegressionModel") == 24
    monkeypatch.setattr(M, "FEW_VECTORS", 0)
    monkeypatch.setattr(M, "ROWS_A_VECTOR", 1_000)
    plain = M.train_forest(df, "y", ["id"], n_estimators=24)
    assert type(plain.model.stages[-1]).__name__ == "RandomForestRegressionModel"
    assert few.evaluation.first().r2 == pytest.approx(plain.evaluation.first().r2, abs=0.03) and few.evaluation.first().r2 > 0.9
    assert few.evaluation.first()["rows"] == few.predictions.select("id").distinct().count() == few.predictions.count()
    share = {r.feature: r.importance for r in few.importances.collect()}
    assert sum(share.values()) == pytest.approx(1.0) and share["a"] > share["b"]
