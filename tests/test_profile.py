import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import gram
from tidemill.operators import profile as P
from tidemill.operators.columns import numeric_columns, string_columns
from tidemill.plans.session import nan_to_null


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame(
        {
            "price": np.where(rng.random(n) < 0.1, np.nan, rng.lognormal(3, 1, n).round(2)),
            "size": rng.integers(0, 9, n).astype(float),
            "flat": np.full(n, 0.1),
            "city": rng.choice(["Oslo", "Rome", "Bern", None, "  ", ""], n),
            "kind": rng.choice(["a", "b"], n),
            "flag": rng.random(n) < 0.5,
        }
    )
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    rows = [(*(float(x) if x is not None else None for x in r[:3]), r[3], r[4], bool(r[5])) for r in rows]
    df = spark.createDataFrame(rows, "price double, size double, flat double, city string, kind string, flag boolean")
    return pdf, df


def by_column(df, metric):
    return {r["column_name"]: r[metric] for r in df.collect()}


def test_column_kinds(frames):
    _, df = frames
    assert string_columns(df.schema) == ["city", "kind"]
    assert numeric_columns(df.schema) == ["price", "size", "flat"]
    kinds = by_column(P.schema_report(df), "kind")
    assert kinds["flag"] == "other" and kinds["price"] == "numeric" and kinds["city"] == "string"


def test_counts_match_pandas(frames):
    pdf, df = frames
    assert P.shape(df).first().asDict() == {"num_rows": 400, "num_columns": 6}
    assert by_column(P.missing(df), "missing") == pdf.isnull().sum().to_dict()
    assert by_column(P.distinct_counts(df), "distinct_values") == pdf.nunique().to_dict()
    assert P.duplicate_rows(df.select("size", "city", "kind")).first()[0] == pdf[["size", "city", "kind"]].duplicated().sum()
    blanks = by_column(P.blank_entries(df), "invalid")
    assert blanks["city"] == pdf.city.isin(["", "  "]).sum() and blanks["price"] == 0 and blanks["flag"] == 0


def test_describe_and_outliers_match_pandas(frames):
    pdf, df = frames
    want = pdf[["price", "size", "flat"]].describe()
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%", "q75": "75%", "max": "max"}
    for r in P.describe(df).collect():
        for ours, theirs in names.items():
            assert r[ours] == pytest.approx(want.loc[theirs, r["column_name"]], abs=1e-9)
    q1, q3 = pdf.price.quantile(0.25), pdf.price.quantile(0.75)
    out = pdf[(pdf.price < q1 - 1.5 * (q3 - q1)) | (pdf.price > q3 + 1.5 * (q3 - q1))]
    assert by_column(P.outlier_counts(df), "num_outliers")["price"] == len(out)
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    assert P.outlier_rows(keyed, ["id"], ["price"]).count() == len(out)


def test_single_outlier_position(spark):
    df = spark.createDataFrame([(0, 10), (1, 11), (2, 12), (3, 13), (4, 100)], "id int, value int")
    assert [tuple(r) for r in P.outlier_rows(df, ["id"]).collect()] == [("value", 4, 100.0)]


def test_correlation_matches_pandas_and_ignores_constants(frames):
    pdf, df = frames
    want = pdf[["price", "size", "flat"]].corr()
    got = {(r.column_x, r.column_y): r["corr"] for r in P.correlation_matrix(df).collect()}
    assert len(got) == 9
    assert got["price", "size"] == pytest.approx(want.loc["price", "size"], abs=1e-12)
    assert got["price", "price"] == pytest.approx(1.0)
    assert all(v is None for (x, y), v in got.items() if "flat" in (x, y))


def agree(got, want):
    """Two lists of (x, y, corr), up to rounding."""
    got, want = ({(a, b): c for a, b, c in x} for x in (got, want))
    assert got.keys() == want.keys()
    assert all((c is None) == (want[k] is None) and (c is None or c == pytest.approx(want[k], abs=1e-9)) for k, c in got.items())


def test_blocks_of_columns_give_the_same(frames, spark, monkeypatch):
    _, df = frames
    whole = P.correlation_matrix(df).collect()
    odd = spark.createDataFrame([(1.0, 1e9 + 1, 1, None), (2.0, 1e9 + 1, None, None), (None, 5.0, 4, 2.0), (3.0, 1e9 + 1, 7, None)], "a double, b double, `c d` int, e double")
    more = P.correlation_matrix(odd).collect()
    monkeypatch.setattr(P, "EXPRESSIONS_PER_PASS", 6)
    agree(P.correlation_matrix(df).collect(), whole)
    agree(P.correlation_matrix(odd.repartition(3)).collect(), more)
    monkeypatch.setattr(gram, "SUMS_BYTES", 1)  # one pair of blocks at a time
    agree(P.correlation_matrix(odd.repartition(3)).collect(), more)
    assert all(r["corr"] is None for r in P.correlation_matrix(odd.where("false")).collect())


def test_five_hundred_columns_with_gaps(spark):
    """As pandas does it, in two reads of the table."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 500)) + rng.normal(size=(400, 500)) + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8] = 3.0, np.nan
    pdf = pd.DataFrame(x, columns=[f"c{k}" for k in range(500)])
    df = spark.createDataFrame(pdf).repartition(4)
    got = P.correlation_matrix(df)
    assert got.count() == 500 * 500
    wide = got.toPandas().pivot(index="column_x", columns="column_y", values="corr").reindex(index=pdf.columns, columns=pdf.columns)
    np.testing.assert_allclose(wide.astype(float).to_numpy(), pdf.corr().mask(pdf.std() == 0).to_numpy(), atol=1e-9)


def test_pairwise_constant_has_no_correlation(spark):
    rows = [(1.0, 1e9 + 1), (2.0, 1e9 + 1), (None, 5.0), (3.0, 1e9 + 1)]
    got = {(r.column_x, r.column_y): r["corr"] for r in P.correlation_matrix(spark.createDataFrame(rows, "a double, b double")).collect()}
    assert got["a", "b"] is None and got["b", "b"] == pytest.approx(1.0)


def test_categories(frames, spark):
    pdf, df = frames
    for r in P.categorical_summary(df).collect():
        values = pdf[r.column_name]
        assert r["mode"] == values.mode().iloc[0] and r.unique_values == values.nunique()
    empty = spark.createDataFrame([(None,), (None,)], "category string")
    assert P.categorical_summary(empty).first().asDict() == {
        "column_name": "category", "mode": None, "mode_count": 0, "unique_values": 0,
    }
    tie = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    assert P.categorical_summary(tie).first()["mode"] == "a"


def test_frequencies_sum_to_one(frames):
    pdf, df = frames
    got = P.value_frequencies(df).groupBy("column_name").agg(F.sum("share").alias("s")).collect()
    assert len(got) == 5 and all(r.s == pytest.approx(1.0) for r in got)
    top = {(r.value, r.n) for r in P.top_values(df, 2, ["city"]).collect()}
    assert len(top) == 2 and max(n for _, n in top) == pdf.city.value_counts().iloc[0]


def test_table_without_numbers(frames):
    pdf, df = frames
    want = pdf[["city", "kind"]].describe()
    for r in P.describe(df.select("city", "kind")).collect():
        assert r["count"] == want.loc["count", r.column_name] and r["unique"] == want.loc["unique", r.column_name]
        assert r.freq == want.loc["freq", r.column_name]


def test_histogram_matches_numpy(frames):
    pdf, df = frames
    counts, edges = np.histogram(pdf["size"], bins=30)
    got = {r.bin: r for r in P.histogram(df, ["size"]).collect()}
    assert [got[i].n if i in got else 0 for i in range(30)] == counts.tolist()
    assert got[0].bin_start == pytest.approx(edges[0]) and got[29].bin_end == pytest.approx(edges[-1])
    flat = P.histogram(df, ["flat"]).first()
    assert flat.n == 400 and flat.bin == 15 and flat.bin_start == pytest.approx(0.1)


def test_box_stats(frames):
    pdf, df = frames
    r = P.box_stats(df, ["price"]).first()
    v = pdf.price.dropna()
    q1, q3 = v.quantile(0.25), v.quantile(0.75)
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    assert (r.whisker_low, r.whisker_high, r.fliers) == (inside.min(), inside.max(), len(v) - len(inside))


def test_full_profile_sections(frames):
    _, df = frames
    full = P.full_profile(df)
    sections = {r.section for r in full.select("section").distinct().collect()}
    assert sections == {
        "schema", "shape", "missing", "invalid", "unique", "duplicates", "describe", "outliers", "correlation", "categorical",
    }
    assert full.where("section = 'unique' and column_name = 'kind'").first().value_num == 2.0


def test_nan_counts_as_missing(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double"))
    assert P.missing(df).first().missing == 1
    assert P.describe(df).first()["mean"] == 2.0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "`a.b` int, `it's` string")
    assert by_column(P.missing(df), "missing") == {"a.b": 0, "it's": 1}
    assert by_column(P.describe(df), "mean") == {"a.b": 1.5}
    assert P.correlation_matrix(df).first()["corr"] == pytest.approx(1.0)


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (3.0, None)], "x double, k string")
    row = P.describe(df).first()
    assert (row["count"], row["mean"], row["q75"], row["max"]) == (2, 2.0, 2.5, 3.0)
    assert by_column(P.missing(df), "missing") == {"x": 1, "k": 1}
    assert by_column(P.distinct_counts(df), "distinct_values") == {"x": 2, "k": 1}
    group = P.profile_by_group(df, ["k"]).where("k = 'a'").first()
    assert (group["count"], group["missing"], group["mean"]) == (1, 1, 1.0)


def test_the_full_profile_reads_its_table_a_few_times(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200).selectExpr("id", "id % 7 AS m", "cast(id AS double) / 3 AS x", "concat('v', id % 3) AS s").write.parquet(path)
    plan = P.full_profile(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    reads = sum(1 for line in plan.splitlines() if "Relation [" in line and "id#" in line)
    assert 0 < reads <= 4


def test_quartiles_and_outliers_of_the_full_profile_are_read_off_value_counts(spark, monkeypatch):
    """No pass over the rows' cells: any row read for quartiles or outliers is an error."""
    df = spark.range(4000).selectExpr(
        "id", "CAST(id % 7 AS decimal(9, 2)) AS m", "if(id % 5 = 0, NULL, double(id * id % 1000)) AS x", "timestamp_ntz'2020-01-01' + make_dt_interval(id % 9) AS t", "concat('v', id % 3) AS s"
    )
    names = ["id", "m", "x"]
    bounds = {r.column_name: tuple(r) for r in P.quartile_bounds(df).collect()}
    outliers = {r.column_name: r.num_outliers for r in P.outlier_counts(df).collect()}
    cells = P.long_numeric
    monkeypatch.setattr(P, "long_numeric", lambda *a, **k: cells(*a, **k).withColumn("value", F.raise_error(F.lit("rows are read")).cast("double")))
    full = {(r.section, r.column_name, r.metric): r.value_num for r in P.full_profile(df).collect()}
    for c in names:
        assert tuple(full["describe", c, q] for q in ("q25", "q50", "q75")) == bounds[c][1:4]
        assert tuple(full["outliers", c, k] for k in ("lower_bound", "upper_bound")) == bounds[c][4:] and full["outliers", c, "num_outliers"] == outliers[c]
    assert [full["unique", c, "distinct_values"] for c in df.columns] == [4000, 7, df.select("x").where("x IS NOT NULL").distinct().count(), 9, 3]
    assert {r.value for r in P.value_counts(df, ["m", "t"]).collect()} == {f"{k}.00" for k in range(7)} | {f"2020-01-0{1 + k} 00:00:00" for k in range(9)}


def test_duplicate_rows_of_a_large_table_are_compared_where_hashes_meet(spark, small_groups):
    """Nulls in different columns have equal hashes but aren't equal; both zeros are."""
    rows = [(None, 5, 0.0), (5, None, -0.0), (None, 5, -0.0), (5, None, 1.0), (5, None, 1.0), (5, None, 1.0)] + [(k, k, 0.5) for k in range(100)]
    df = spark.createDataFrame(rows, "a long, b long, `_x.y` double").repartition(5)
    hashes = df.select(F.xxhash64("a", "b", "`_x.y`").alias("h"))
    assert hashes.distinct().count() == 102
    assert P.duplicate_rows(df).first()[0] == 3
    seen = P.duplicate_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_row_hash" in seen, "the rows that are grouped whole are chosen by hash"
    assert P.duplicate_rows(df.where("b < 90 AND a > 2")).first()[0] == 0
    assert P.duplicate_rows(df.select(F.struct("a", "b").alias("both"))).first()[0] == 4


def test_approximate_quartiles_are_near(spark):
    df = spark.range(1, 1002).selectExpr("cast(id AS double) AS x")
    row = P.describe(df, exact=False).first()
    assert abs(row["q25"] - 251) < 2 and abs(row["q50"] - 501) < 2 and row["count"] == 1001


def test_frequent_values_without_moving_all_values(spark, small_groups, monkeypatch):
    """Few values, a skewed column with a long tail, and one where nothing can be proven."""
    monkeypatch.setattr(P, "CANDIDATES", 40)
    rng = np.random.default_rng(6)
    tail = [f"t{k}" for k in rng.integers(0, 3000, 3000)]
    rows = [(k, ["a", "b", None][k % 3], "hot" if k % 2 else "warm" if k % 5 == 0 else tail[k], float(k % 4) if k % 7 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, few string, skewed string, x double").repartition(5)
    counts, whole, proven = P.frequent_values(df, df.columns, 2)
    assert whole == ["few", "x"] and proven == ["skewed"]
    assert counts.where("column_name = 'key'").count() <= 40
    got = {(r.column_name, r.value, r.n, r["rank"]) for r in P.top_values(df, 2).collect()}
    spark.conf.set("tidemill.groupRows", "100000")
    assert got == {(r.column_name, r.value, r.n, r["rank"]) for r in P.top_values(df, 2).collect()}
    whole_table = {tuple(r) for r in P.categorical_summary(df).collect()}
    spark.conf.set("tidemill.groupRows", "20")
    assert {tuple(r) for r in P.categorical_summary(df).collect()} == whole_table
    assert P.top_values(df.where("false"), 2).count() == 0


def test_values_of_equal_frequency_are_never_lost(spark, small_groups, monkeypatch):
    monkeypatch.setattr(P, "CANDIDATES", 8)
    df = spark.range(4000).selectExpr("concat('v', id % 1000) AS v", "id % 3 AS few")
    got = [(r.value, r.n) for r in P.top_values(df, 3, ["v"]).orderBy("rank").collect()]
    assert got == [("v0", 4), ("v1", 4), ("v10", 4)]
