import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import quantiles
from tidemill.functions.quantiles import exact_quantiles

PROBS = {"q1": 0.25, "q2": 0.5, "p95": 0.95}


def frame(spark):
    rng = np.random.default_rng(7)
    hot = rng.lognormal(size=3000)
    flat = np.where(rng.random(900) < 0.6, 5.0, rng.normal(size=900))
    pdf = pd.concat(
        [
            pd.DataFrame({"g": "hot", "v": hot}),
            pd.DataFrame({"g": "flat", "v": flat}),
            pd.DataFrame({"g": "tiny", "v": [1.0, 2.0, 4.0, 10.0]}),
            pd.DataFrame({"g": None, "v": np.arange(50.0)}),
        ]
    )
    return pdf, spark.createDataFrame(pdf, "g string, v double").repartition(6)


@pytest.mark.parametrize("method", ["linear", "lower"])
@pytest.mark.parametrize("path", ["sort", "buckets", "sketch"])
def test_matches_numpy(spark, method, path, monkeypatch):
    pdf, df = frame(spark)
    if path == "buckets":
        monkeypatch.setattr(quantiles, "SORTED_ROWS", 10)
        monkeypatch.setattr(quantiles, "BUCKET_ROWS", 7)
    if path == "sketch":
        spark.conf.set("tidemill.groupRows", "20")
    try:
        got = exact_quantiles(df, ["g"], "v", PROBS, method).toPandas()
    finally:
        spark.conf.unset("tidemill.groupRows")
    assert len(got) == 4
    for row in got.itertuples():
        vals = pdf[pdf.g.isna()].v if row.g is None or pd.isna(row.g) else pdf[pdf.g == row.g].v
        for name, p in PROBS.items():
            assert getattr(row, name) == pytest.approx(np.quantile(vals, p, method=method), abs=1e-12)


@pytest.mark.parametrize("method", ["linear", "lower"])
def test_large_groups_are_narrowed_by_counts_alone(spark, row_limit, monkeypatch, method):
    """No sketches are needed for spread-out values or few different ones; groups that crowd in one place still get them."""
    row_limit(50)
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", 10)
    rng = np.random.default_rng(3)
    values = {"even": rng.random(4000), "few": rng.integers(0, 5, 4000) / 7, "one": np.full(300, 2.5)}
    sketched = []
    select = quantiles._select_ranks
    monkeypatch.setattr(quantiles, "_select_ranks", lambda data, large, *rest: sketched.extend(r[0] for r in large.collect()) or select(data, large, *rest))
    for crowded in ({}, {"far": np.append(rng.normal(size=2000), 1e12)}):
        every = values | crowded
        pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in every.items()])
        got = exact_quantiles(spark.createDataFrame(pdf).repartition(5), ["g"], "v", PROBS, method).toPandas().set_index("g")
        assert sketched == list(crowded) and set(got.index) == set(every)
        for g, v in every.items():
            assert list(got.loc[g, list(PROBS)]) == pytest.approx([np.quantile(v, p, method=method) for p in PROBS.values()], abs=1e-12)


def test_global_group(spark, small_groups):
    got = exact_quantiles(spark.range(1001).select(F.col("id").alias("v")), [], "v", PROBS).first()
    assert (got.q1, got.q2, got.p95) == (250.0, 500.0, 950.0)


def test_lower_rank_takes_element_27_of_30(spark):
    got = exact_quantiles(spark.range(30).select(F.col("id").alias("v")), [], "v", {"p": 0.95}, "lower").first()
    assert got.p == 27.0


def test_infinite_values_sort_last(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED_ROWS", 1)
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", 2)
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 3]] + [(float("inf"),), (1e300,)], "v double")
    got = exact_quantiles(df, [], "v", {"low": 0.25, "top": 0.75})
    assert tuple(got.first()) == (3.0, 1e300)


@pytest.mark.parametrize("few", ["0", "100000"])
def test_without_broadcast_hints_the_answer_is_the_same(spark, small_groups, few):
    df = spark.range(300).selectExpr("id % 3 AS k", "cast(id * 7 % 101 AS double) AS v")
    spark.conf.set("tidemill.broadcastRows", few)
    try:
        got = {r.k: (r.a, r.b) for r in exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}).collect()}
    finally:
        spark.conf.unset("tidemill.broadcastRows")
    for k in range(3):
        values = sorted(i * 7 % 101 for i in range(300) if i % 3 == k)
        want = [values[int(p * 99)] + (values[min(99, int(p * 99) + 1)] - values[int(p * 99)]) * (p * 99 - int(p * 99)) for p in (0.25, 0.9)]
        assert got[k] == pytest.approx(want)


def test_pieces_within_a_partition_limit(spark, small_groups, monkeypatch):
    from tidemill.plans import skew

    monkeypatch.setattr(skew, "MOST_PARTITIONS", 2)
    df = spark.range(500).selectExpr("1 AS k", "id AS at")
    pieces = skew.ordered_pieces(df, ["k"], ["at"]).groupBy("piece").agg({"at": "min", "*": "count"}).orderBy("piece").collect()
    assert all(r["count(1)"] <= 20 for r in pieces) and sum(r["count(1)"] for r in pieces) == 500
    assert [r["min(at)"] for r in pieces] == sorted(r["min(at)"] for r in pieces)


@pytest.mark.parametrize("method", ["linear", "lower"])
@pytest.mark.parametrize("path", ["sort", "buckets", "sketch"])
def test_value_counts_in_place_of_rows(spark, method, path, monkeypatch):
    """The same answers from values with their numbers; rows are read where a bucket has to be narrowed."""
    _, df = frame(spark)
    df = df.withColumn("v", F.round("v", 1))
    want = {r.g: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", PROBS, method).collect()}
    if path != "sort":
        monkeypatch.setattr(quantiles, "SORTED_ROWS", 10)
        monkeypatch.setattr(quantiles, "BUCKET_ROWS", 300)
    rows = df
    if path == "sketch":
        spark.conf.set("tidemill.groupRows", "20")
        monkeypatch.setattr(quantiles, "MOST_BUCKETS", 1)
    else:
        rows = df.withColumn("v", F.raise_error(F.lit("rows are read")).cast("double"))
    try:
        counts = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
        got = {r.g: tuple(r)[1:] for r in exact_quantiles(rows, ["g"], "v", PROBS, method, counts=counts).collect()}
    finally:
        spark.conf.unset("tidemill.groupRows")
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert got[g] == pytest.approx(values, rel=1e-12)
