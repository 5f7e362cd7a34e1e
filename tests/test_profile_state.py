import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import profile as P
from tidemill.operators import profile_state as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x = rng.lognormal(0, 2, n)
    pdf = pd.DataFrame({"id": np.arange(n), "x": np.where(rng.random(n) < 0.1, np.nan, x), "far": 1e9 + rng.normal(size=n), "c": rng.choice(["a", "b", " ", None], n), "void": np.full(n, np.nan)})
    return pdf, spark.createDataFrame(pdf).withColumn("id", F.col("id").cast("int"))


def parts(df):
    return [df.where("id < 10"), df.where("id >= 10 AND id % 2 = 0"), df.where("id >= 10 AND id % 2 = 1"), df.where("false")]


def test_old_states_and_a_new_batch_equal_a_full_run(spark, table, tmp_path):
    pdf, df = table
    folder = str(tmp_path / "state")
    for k, part in enumerate(parts(df)[:-1]):
        S.add_batch(part, folder, str(k))
    before = {r.column_name: r for r in S.profile_of_states(*S.stored_states(spark, folder)).collect()}
    S.add_batch(parts(df)[-1], folder, "none")
    S.add_batch(parts(df)[1], folder, "1")  # repeated delivery
    got = {r.column_name: r for r in S.profile_of_states(*S.stored_states(spark, folder)).collect()}
    assert got.keys() == before.keys() == set(df.columns)
    whole = {r.column_name: r for r in P.describe(df).collect()}
    for c in ("id", "x", "far"):
        assert got[c]["count"] == whole[c]["count"] and (got[c]["min"], got[c]["max"]) == (whole[c]["min"], whole[c]["max"])
        assert got[c]["mean"] == pytest.approx(whole[c]["mean"], rel=1e-12)
        assert got[c]["std"] == pytest.approx(pdf[c].std(), rel=1e-7), "also far from zero"
        # the sketches' bounds
        values = pdf[c].dropna().sort_values().to_numpy()
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            rank = np.searchsorted(values, got[c][name]) / len(values)
            assert abs(rank - q) < 1.7 / S.KLL_SIZE * 2
        assert got[c]["distinct_estimate"] == pytest.approx(got[c]["distinct_values"], rel=0.08)
    missing = {r.column_name: r.missing for r in P.missing(df).collect()}
    distinct = {r.column_name: r.distinct_values for r in P.distinct_counts(df).collect()}
    assert {c: r.missing for c, r in got.items()} == {c: missing.get(c, 0) for c in got}
    assert {c: r.distinct_values for c, r in got.items()} == distinct
    assert got["c"]["blank"] == (pdf.c == " ").sum() and got["c"]["mean"] is None and got["c"]["mode_count"] == pdf.c.value_counts().max()
    assert got["void"]["mode"] is None and got["void"]["q50"] is None and got["void"]["count"] == 0


def test_only_the_new_batch_is_read(spark, table, tmp_path):
    """The first batch's rows are gone by the time the second one comes."""
    _, df = table
    rows = str(tmp_path / "rows")
    df.where("id < 100").write.parquet(f"{rows}/a")
    folder = str(tmp_path / "state")
    S.add_batch(spark.read.parquet(f"{rows}/a"), folder, "a")
    df.where("id >= 2900").write.mode("overwrite").parquet(f"{rows}/a")
    S.add_batch(spark.read.parquet(f"{rows}/a"), folder, "b")
    got = {r.column_name: r for r in S.profile_of_states(*S.stored_states(spark, folder)).collect()}
    assert (got["id"]["count"], got["id"]["min"], got["id"]["max"]) == (200, 0.0, 2999.0)


def test_distinct_sketches_see_a_value_once(spark):
    """They are made of value counts, hash numbers as numbers, as states stored before do, and are empty where there is no value."""
    df = spark.range(5000).selectExpr(
        "id % 300 AS k", "float(id % 70) / 8 AS x", "if(id % 9 = 0, -0.0D, 0.0D) AS zero", "timestamp_ntz'2021-01-01' + make_dt_interval(id % 31) AS t", "concat('v', id % 17) AS s", "CAST(NULL AS int) AS void"
    )
    states = S.column_states(df)
    kinds = {"k": "bigint(k)", "x": "double(x)", "zero": "zero", "t": "string(t)", "s": "s", "void": "bigint(void)"}
    old = df.selectExpr(*[f"hll_sketch_agg(if({c} IS NULL, NULL, xxhash64({e})), {S.HLL_BITS}) AS {c}" for c, e in kinds.items()])
    rows = states.selectExpr("column_name", "hll_sketch_estimate(distinct_sketch) AS new", "distinct_sketch").crossJoin(old)
    both = {r.column_name: r for r in rows.selectExpr("column_name", "new", *[f"if(column_name = '{c}', hll_sketch_estimate(hll_union(distinct_sketch, {c})), NULL) AS {c}" for c in kinds]).collect()}
    assert {c: r.new for c, r in both.items()} == pytest.approx({"k": 300, "x": 70, "zero": 1, "t": 31, "s": 17, "void": 0}, rel=0.05)
    assert {c: r[c] for c, r in both.items()} == pytest.approx({c: r.new for c, r in both.items()}, rel=0.03), "the same hashes"
    known = df.limit(0).select(F.lit("k").alias("column_name"), F.lit("5").alias("value"), F.lit(1).alias("n"))
    estimates = {r.column_name: r.e for r in S.column_states(df, known).selectExpr("column_name", "hll_sketch_estimate(distinct_sketch) AS e").collect()}
    assert set(estimates.values()) == {0}, "no row is read for them where the counts are known"
