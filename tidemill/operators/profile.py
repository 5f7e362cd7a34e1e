"""Distributed table profiler.

Counts, moments and correlations come from wide aggregates (one row per task leaves the
map side). Everything that depends on single values works on pre-aggregated
(column, value, count) rows, so a hot value costs one row per task and no column is ever
gathered in one place.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.quantiles import approximate_quantiles, exact_quantiles
from tidemill.functions.scalars import is_blank
from tidemill.operators.columns import (
    aggregate_sql,
    cells_by_kind,
    columns_by_own_kind,
    col,
    hashed_alike,
    long_numeric,
    name_sql,
    numeric_columns,
    string_columns,
    text_sql,
    wide_to_long,
)
from tidemill.operators.gram import wide_correlation
from tidemill.plans.joins import join_null_safe
from tidemill.plans.session import cut_lineage, group_rows, hint_small, without_nan

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
# aggregates per pass: keeps generated code within what the JVM compiles well
EXPRESSIONS_PER_PASS = 300
# frequent values that are counted exactly, and columns summarised at a time; a summary of m values is wrong by
# at most this many m-ths of the rows
CANDIDATES = 1_000
SUMMARIES = 50
SUMMARY_ERROR = 3.5
# what is summed per pair of columns: rows, values, squares and products
SUMS = ("n", "sx", "sy", "xx", "yy", "xy")


def schema_report(df: DataFrame) -> DataFrame:
    """Column position, name, Spark type and kind (string / numeric / other)."""
    text, numbers = string_columns(df.schema), numeric_columns(df.schema)
    rows = [
        (i, f.name, f.dataType.simpleString(), "string" if f.name in text else "numeric" if f.name in numbers else "other")
        for i, f in enumerate(df.schema)
    ]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string, kind string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("num_rows")).withColumn("num_columns", F.lit(len(df.columns)).cast("long"))


def _gap_sums(columns: list[str]) -> list[str]:
    sums = []
    for i, c in enumerate(columns):
        gap = f"(count(1) - count({name_sql(c)}))"
        sums += [f"{gap} AS missing__{i}", f"try_divide({gap} * 100D, count(1)) AS missing_pct__{i}"]
    return sums


@without_nan
def missing(df: DataFrame) -> DataFrame:
    return wide_to_long(aggregate_sql(df, _gap_sums(df.columns)), df.columns, ["missing", "missing_pct"])


def _blank_sums(text: list[str]) -> list:
    return [F.count_if(is_blank(col(c))).alias(f"invalid__{i}") for i, c in enumerate(text)]


@without_nan
def blank_entries(df: DataFrame) -> DataFrame:
    """Strings of white space only; 0 for columns that are not strings."""
    text = string_columns(df.schema)
    found = wide_to_long(df.agg(*_blank_sums(text)), text, ["invalid"]) if text else None
    others = [(c, 0) for c in df.columns if c not in text]
    zeros = df.sparkSession.createDataFrame(others, "column_name string, invalid bigint")
    return zeros if found is None else found.unionByName(zeros)


@without_nan
def value_counts(df: DataFrame, columns: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """(column_name, value, n) over non-null cells: the shared base of the value-based metrics.

    ``only`` restricts it to some values: rows (column_name, hash), few enough to be broadcast.
    """
    tables = cells_by_kind(df, columns)
    if only is not None:
        keep = F.broadcast(only)
        tables = [t.withColumn("hash", F.xxhash64("value")).join(keep, ["column_name", "hash"], "left_semi") for t in tables]
    return _counted(tables, "string")


def _counted(tables: list[DataFrame], as_type: str) -> DataFrame:
    """(column_name, value, n) of cells, counted in their own types."""
    parts = [
        cells.groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column_name", F.col("value").cast(as_type).alias("value"), "n")
        for cells in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@without_nan
def number_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value double, n) over the non-null cells of numeric columns, one row per distinct value.

    Whole numbers that are the same double keep rows of their own.
    """
    return _counted(cells_by_kind(df, columns), "double")


@without_nan
def frequent_values(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[str], list[str]]:
    """Counts (column_name, value, n) that hold the ``k`` most frequent values, without moving all distinct values.

    Returns them with two lists of columns: those whose every value is there, and others whose first ``k`` are
    proven. Columns in neither have to be counted in full.

    First each task keeps a mergeable summary of every column's frequent values, of a fixed size. These are only
    candidates: a second read counts them exactly. If the counts add up to the column's cells, nothing is
    missing. Else a value that isn't a candidate has at most as many cells as the least candidate's estimate or the
    summary's error allow, and the first ``k`` are proven if the k-th exact count is above that.
    """
    spark = df.sparkSession
    kinds = {c: kind for kind, names in columns_by_own_kind(df, columns).items() for c in names}
    candidates = max(CANDIDATES, 2 * k)
    tracked = 10 * candidates
    hashed = [f"if({name_sql(c)} IS NULL, NULL, xxhash64(CAST({name_sql(c)} AS {kinds[c]})))" for c in columns]
    found = {}
    for a in range(0, len(columns), SUMMARIES):
        part = range(a, min(len(columns), a + SUMMARIES))
        summaries = [f"approx_top_k({hashed[i]}, {candidates}, {tracked}) AS top{i}" for i in part]
        row = df.selectExpr("count(1) AS total", *summaries, *[f"count({name_sql(columns[i])}) AS n{i}" for i in part]).first()
        rows_in_all = row["total"]
        found |= {columns[i]: (row[f"n{i}"], len(row[f"top{i}"]), [tuple(x) for x in row[f"top{i}"]]) for i in part}
    # at most ``candidates`` numbers per column
    rows = [(c, h) for c, (_, _, top) in found.items() for h, _ in top if h is not None]
    counts = cut_lineage(value_counts(df, columns, spark.createDataFrame(rows, "column_name string, hash long")))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    sums = ranked.groupBy("column_name").agg(F.sum("n").alias("total"), F.max(F.when(F.col("rank") == k, F.col("n"))).alias("kth")).collect()
    exact = {r["column_name"]: (r["total"], r["kth"]) for r in sums}
    whole, proven = [], []
    for c, (cells, size, top) in found.items():
        total, kth = exact.get(c, (0, None))
        # estimates are upper bounds; a value that the summary let go, or held too loosely to name it, is within twice its error
        error = 2 * SUMMARY_ERROR * rows_in_all / tracked
        bound = max(error, top[-1][1] if size == candidates else 0)
        if total == cells:
            whole.append(c)
        elif kth is not None and kth > bound:
            proven.append(c)
    return counts, whole, proven


@without_nan
def distinct_counts(df: DataFrame) -> DataFrame:
    counts = value_counts(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    return _every_column(df, df.columns, counts, "distinct_values")


@without_nan
def approx_distinct_counts(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    row = df.agg(*[F.approx_count_distinct(col(c), rsd).alias(f"distinct_values__{i}") for i, c in enumerate(df.columns)])
    return wide_to_long(row, df.columns, ["distinct_values"])


def _every_column(df: DataFrame, columns: list[str], counts: DataFrame, metric: str) -> DataFrame:
    """Columns holding nothing but nulls are reported with 0."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(counts, "column_name", "left").withColumn(metric, F.coalesce(metric, F.lit(0)).cast("long"))


@without_nan
def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to another one, the first of each group not counted; null equals null.

    In a large table only rows whose hash is found twice are compared.
    """
    spark, columns = df.sparkSession, [col(c) for c in df.columns]
    if hashed_alike(df.schema) and df.count() > group_rows(spark):
        df = df.withColumn("_row_hash", F.xxhash64(*columns))
        twice = cut_lineage(df.groupBy("_row_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row_hash"))
        df = df.join(hint_small(twice, twice.count()), "_row_hash", "left_semi")
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


MOMENTS = {"count": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def _moment_sums(columns: list[str]) -> list[str]:
    return [f"{fn}(double({name_sql(c)})) AS {metric}__{i}" for i, c in enumerate(columns) for metric, fn in MOMENTS.items()]


@without_nan
def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    return wide_to_long(aggregate_sql(df, _moment_sums(columns)), columns, list(MOMENTS))


def sizes_of(stats: DataFrame) -> DataFrame:
    """What exact quantiles need to know of each column, from its moments."""
    return stats.where("count > 0").select("column_name", F.col("count").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"))


@without_nan
def describe(df: DataFrame, exact: bool = True) -> DataFrame:
    """count, mean, sample standard deviation, min, quartiles and max of every numeric column.

    The moments are one pass and written down, since the quartiles start from them. With ``exact=False``
    quartiles come from a sketch, in one pass more.
    """
    columns = numeric_columns(df.schema)
    if not columns:
        return describe_text(df)
    stats = cut_lineage(moments(df, columns))
    return _described(stats, quartile_bounds(df, columns, stats, exact))


def _described(stats: DataFrame, bounds: DataFrame) -> DataFrame:
    return (
        stats.join(F.broadcast(bounds), "column_name", "left")  # one row per column
        .select("column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    )


@without_nan
def describe_text(df: DataFrame) -> DataFrame:
    """What a summary shows for a table without numbers: count, unique, top value and its frequency."""
    counts = value_counts(df)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    found = counts.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("best")
    )
    return found.select("column_name", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.n")).alias("freq"))


@without_nan
def numeric_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    return describe(df, exact).select(
        "column_name", "mean", F.col("q50").alias("median"), F.col("std").alias("std_dev"), "min", "max"
    )


@without_nan
def quartile_bounds(
    df: DataFrame, columns: list[str] | None = None, stats: DataFrame | None = None, exact: bool = True, counts: DataFrame | None = None
) -> DataFrame:
    """(column_name, q25, q50, q75, lower_bound, upper_bound): one row per numeric column.

    ``stats`` takes the columns' ``moments`` and ``counts`` their ``number_counts`` where these are known.
    """
    cells = long_numeric(df, columns)
    if exact:
        q = exact_quantiles(cells, ["column_name"], "value", QUARTILES, sizes=None if stats is None else sizes_of(stats), counts=counts)
    else:
        q = approximate_quantiles(cells, ["column_name"], "value", QUARTILES)
    iqr = F.col("q75") - F.col("q25")
    return q.withColumn("lower_bound", F.col("q25") - 1.5 * iqr).withColumn("upper_bound", F.col("q75") + 1.5 * iqr)


@without_nan
def outlier_rows(df: DataFrame, row_id: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per outlying cell: strictly below or above 1.5 interquartile ranges."""
    columns = [c for c in numeric_columns(df.schema) if c not in row_id] if columns is None else columns
    cells = long_numeric(df, columns, keep=tuple(row_id))
    bounds = F.broadcast(quartile_bounds(df, columns))  # one row per column
    return (
        cells.join(bounds, "column_name")
        .where((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
        .select("column_name", *row_id, "value")
    )


@without_nan
def outlier_counts(df: DataFrame, columns: list[str] | None = None, bounds: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Cells strictly below or above 1.5 interquartile ranges, per column; ``counts`` takes the columns' ``number_counts`` if they are known."""
    cells = long_numeric(df, columns) if counts is None else counts
    bounds = F.broadcast(quartile_bounds(df, columns) if bounds is None else bounds)
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    number = F.count_if(outside) if counts is None else F.sum(F.when(outside, F.col("n")).otherwise(0))
    return cells.join(bounds, "column_name").groupBy("column_name").agg(
        number.alias("num_outliers"),
        F.first("lower_bound").alias("lower_bound"),
        F.first("upper_bound").alias("upper_bound"),
    )


@without_nan
def categorical_summary(df: DataFrame) -> DataFrame:
    """Most frequent value (the smallest one on ties), its count and the number of distinct values."""
    columns = string_columns(df.schema)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    counts = value_counts(df, columns)
    if columns and df.count() > group_rows(df.sparkSession):
        # distinct values of the other columns have to be told apart one by one
        frequent, whole, _ = frequent_values(df, columns, 1)
        rest = [c for c in columns if c not in whole]
        counts = frequent.where(F.col("column_name").isin(whole))
        counts = counts.unionByName(value_counts(df, rest)) if rest else counts
    found = (
        counts.groupBy("column_name")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("unique_values"))
        .select("column_name", F.col("best.value").alias("mode"), (-F.col("best.n")).alias("mode_count"), "unique_values")
    )
    full = _every_column(df, columns, found, "unique_values")
    return full.withColumn("mode_count", F.coalesce("mode_count", F.lit(0)).cast("long"))


@without_nan
def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count and share of every value among the non-null rows of its column."""
    columns = numeric_columns(df.schema) + string_columns(df.schema) if columns is None else columns
    # the totals are a wide aggregate with one row per column, so no column is windowed as a whole
    totals = wide_to_long(
        aggregate_sql(df, [f"count({name_sql(c)}) AS total__{i}" for i, c in enumerate(columns)]), columns, ["total"]
    )
    return (
        value_counts(df, columns)
        .join(F.broadcast(totals), "column_name")
        .select("column_name", "value", "n", (F.col("n") / F.col("total")).alias("share"))
    )


@without_nan
def top_values(df: DataFrame, k: int, columns: list[str] | None = None) -> DataFrame:
    """The k most frequent values per column; Spark limits each task to k rows per column first.

    In a large table only candidates are counted where that is proven to be enough.
    """
    columns = df.columns if columns is None else columns
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    if df.count() > group_rows(df.sparkSession):
        frequent, whole, proven = frequent_values(df, columns, k)
        rest = [c for c in columns if c not in [*whole, *proven]]
        counts = frequent.where(F.col("column_name").isin([*whole, *proven]))
        counts = counts.unionByName(value_counts(df, rest)) if rest else counts
    else:
        counts = value_counts(df, columns)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@without_nan
def correlation_matrix(df: DataFrame, columns: list[str] | None = None, known: dict | None = None) -> DataFrame:
    """Pearson correlation over the rows where both columns are present; null if one is constant.

    A first pass fetches mean, range and gaps per column. Products of centred values are then
    plain sums: one per pair of gapless columns, six where a column has gaps. ``known`` takes the first
    pass's result: total, and count, avg, min and max by column position. More pairs than one aggregate holds
    are left to ``gram.wide_correlation``, which reads the table as often whatever the number of columns.
    """
    columns = numeric_columns(df.schema) if columns is None else columns
    if len(columns) * (len(columns) + 1) // 2 > EXPRESSIONS_PER_PASS:
        return wide_correlation(df, columns)
    doubles = df.selectExpr(*[f"double({name_sql(c)}) AS c{i}" for i, c in enumerate(columns)])
    wanted = [f"{fn}(c{i}) AS {fn}{i}" for i in range(len(columns)) for fn in ("count", "avg", "min", "max")]
    stats = aggregate_sql(doubles, ["count(1) AS total", *wanted]).first() if known is None else known
    centres = [0.0 if stats[f"avg{i}"] is None else stats[f"avg{i}"] for i in range(len(columns))]
    centred = doubles.selectExpr(*[f"c{i} - double('{m!r}') AS x{i}" for i, m in enumerate(centres)])
    gaps = {i for i in range(len(columns)) if stats[f"count{i}"] < stats["total"]}
    flat = {i for i in range(len(columns)) if stats[f"min{i}"] == stats[f"max{i}"]}
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    if len(pairs) + 5 * sum(bool(gaps & {i, j}) for i, j in pairs) > EXPRESSIONS_PER_PASS:
        return wide_correlation(df, columns)
    wanted, entries = {"total": "count(1)"}, []
    for i, j in pairs:
        x, y, at = f"x{i}", f"x{j}", f"_{i}_{j}"
        if i in flat or j in flat:
            found = ["1", "0", "0", "NULL", "NULL", "NULL"]
        elif gaps & {i, j}:
            found = [f"{k}{at}" for k in SUMS]
            wanted |= {
                f"n{at}": f"count({x} * {y})",
                f"sx{at}": f"sum(if({y} IS NOT NULL, {x}, NULL))",
                f"sy{at}": f"sum(if({x} IS NOT NULL, {y}, NULL))",
                f"xx{at}": f"sum(if({y} IS NOT NULL, {x} * {x}, NULL))",
                f"yy{at}": f"sum(if({x} IS NOT NULL, {y} * {y}, NULL))",
                f"xy{at}": f"sum({x} * {y})",
            }
        else:
            found = ["1", "0", "0", f"own{i}", f"own{j}", f"xy{at}"]
            wanted |= {f"own{i}": f"sum({x} * {x})", f"own{j}": f"sum({y} * {y})", f"xy{at}": f"sum({x} * {y})"}
        values = ", ".join(f"'{k}', double({v})" for k, v in zip(SUMS, found))
        entries.append(f"named_struct('x', {text_sql(columns[i])}, 'y', {text_sql(columns[j])}, {values})")
    sums = aggregate_sql(centred, [f"{e} AS {k}" for k, e in wanted.items()]).selectExpr(f"inline(array({', '.join(entries)}))")
    half = (
        sums.withColumn("vx", _spread(F.col("xx"), F.col("sx"), F.col("n")))
        .withColumn("vy", _spread(F.col("yy"), F.col("sy"), F.col("n")))
        .withColumn("xy", F.col("xy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")))
        .withColumn("corr", F.try_divide("xy", F.sqrt("vx") * F.sqrt("vy")))
        .withColumn("corr", F.when(F.col("corr").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "corr"))))
    )
    both = F.array_distinct(
        F.array(
            F.struct(F.col("x").alias("column_x"), F.col("y").alias("column_y")),
            F.struct(F.col("y").alias("column_x"), F.col("x").alias("column_y")),
        )
    )
    return half.select(F.inline(both), "corr")


def _spread(squares, total, n):
    """Sum of squares around the mean of the paired rows; null where only rounding noise is left."""
    value = squares - F.try_divide(total * total, n)
    return F.when(value > squares * 1e-12, value)


@without_nan
def heatmap_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return correlation_matrix(df, columns).select("column_x", "column_y", F.round("corr", 2).alias("label"))


@without_nan
def profile_by_group(df: DataFrame, keys: list[str], columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Moments, missing count and quartiles per group and numeric column.

    Moments are one wide aggregate per group; rows are turned into cells for the quartiles only.
    """
    columns = [c for c in numeric_columns(df.schema) if c not in keys] if columns is None else columns
    metrics = list(MOMENTS)
    wide = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_rows"), *[F.expr(e) for e in _moment_sums(columns)])
    entries = [
        f"named_struct('column_name', {text_sql(c)}, 'missing', _rows - `count__{i}`, " + ", ".join(f"'{m}', `{m}__{i}`" for m in metrics) + ")"
        for i, c in enumerate(columns)
    ]
    stats = cut_lineage(wide.selectExpr(*map(name_sql, keys), f"inline(array({', '.join(entries)}))"))
    cells = long_numeric(df, columns, keep=tuple(keys))
    groups = keys + ["column_name"]
    if exact:
        sizes = stats.where("count > 0").select(*groups, F.col("count").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"))
        quartiles = exact_quantiles(cells, groups, "value", QUARTILES, sizes=sizes)
    else:
        quartiles = approximate_quantiles(cells, groups, "value", QUARTILES)
    ordered = stats.select(*groups, "count", "missing", "mean", "std", "min", "max")
    return join_null_safe(ordered, quartiles, groups, "left")


@without_nan
def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width bins per numeric column (empty bins left out); a constant column is widened by half."""
    columns = numeric_columns(df.schema) if columns is None else columns
    ends = moments(df, columns).select(
        "column_name",
        F.when(F.col("min") == F.col("max"), F.col("min") - 0.5).otherwise(F.col("min")).alias("lo"),
        F.when(F.col("min") == F.col("max"), F.col("max") + 0.5).otherwise(F.col("max")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        long_numeric(df, columns)
        .join(F.broadcast(ends), "column_name")
        .withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
        .groupBy("column_name", "bin", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column_name",
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            "n",
        )
    )


@without_nan
def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Median, quartiles, whiskers (extreme values inside the fences) and number of fliers."""
    cells = long_numeric(df, columns)
    bounds = F.broadcast(quartile_bounds(df, columns))
    inside = (F.col("value") >= F.col("lower_bound")) & (F.col("value") <= F.col("upper_bound"))
    return cells.join(bounds, "column_name").groupBy("column_name", "q25", "q50", "q75").agg(
        F.least(F.min(F.when(inside & (F.col("value") <= F.col("q75")), F.col("value"))), F.col("q25")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside & (F.col("value") >= F.col("q25")), F.col("value"))), F.col("q75")).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


@without_nan
def full_profile(df: DataFrame) -> DataFrame:
    """All sections in one long table: (section, column_name, metric, value_num, value_text)."""
    numbers, text = numeric_columns(df.schema), string_columns(df.schema)

    def rows(part: DataFrame, section: str, metrics: list[str], texts: tuple[str, ...] = ()) -> DataFrame:
        name = F.col("column_name") if "column_name" in part.columns else F.lit("*")
        entries = [
            F.struct(
                F.lit(m).alias("metric"),
                F.lit(None).cast("double").alias("value_num") if m in texts else F.col(m).cast("double").alias("value_num"),
                F.col(m).cast("string").alias("value_text") if m in texts else F.lit(None).cast("string").alias("value_text"),
            )
            for m in metrics
        ]
        return part.select(F.lit(section).alias("section"), name.alias("column_name"), F.inline(F.array(*entries)))

    # one pass for everything that is a sum; its single row is model-sized
    row = cut_lineage(aggregate_sql(df, ["count(1) AS num_rows", *_gap_sums(df.columns), *_blank_sums(text), *_moment_sums(numbers)]))
    gaps = wide_to_long(row, df.columns, ["missing", "missing_pct"])
    blanks = df.sparkSession.createDataFrame([(c, 0) for c in df.columns if c not in text], "column_name string, invalid bigint")
    blanks = blanks.unionByName(wide_to_long(row, text, ["invalid"])) if text else blanks
    # values of numbers are counted once and written: distinct counts, quartiles and outliers are read off them
    unique = F.count(F.lit(1)).alias("distinct_values")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("best")
    others = [c for c in df.columns if c not in numbers and c not in text]
    counts = cut_lineage(number_counts(df, numbers)) if numbers else None
    found = [counts.groupBy("column_name").agg(unique)] if numbers else []
    found += [value_counts(df, others).groupBy("column_name").agg(unique)] if others else []
    found += [value_counts(df, text).groupBy("column_name").agg(unique, best)] if text else []
    values = found[0]
    for part in found[1:]:
        values = values.unionByName(part, allowMissingColumns=True)
    values = cut_lineage(values)  # one row per column
    parts = [
        rows(schema_report(df), "schema", ["data_type", "kind"], ("data_type", "kind")),
        rows(row.select("num_rows", F.lit(len(df.columns)).cast("long").alias("num_columns")), "shape", ["num_rows", "num_columns"]),
        rows(gaps, "missing", ["missing", "missing_pct"]),
        rows(blanks, "invalid", ["invalid"]),
        rows(_every_column(df, df.columns, values.select("column_name", "distinct_values"), "distinct_values"), "unique", ["distinct_values"]),
        rows(duplicate_rows(df), "duplicates", ["duplicate_rows"]),
    ]
    if numbers:
        stats = wide_to_long(row, numbers, list(MOMENTS))
        bounds = cut_lineage(quartile_bounds(df, numbers, stats, counts=counts))
        first = row.first()
        known = {"total": first["num_rows"]}
        for i in range(len(numbers)):
            known |= {f"{k}{i}": first[f"{m}__{i}"] for k, m in (("count", "count"), ("avg", "mean"), ("min", "min"), ("max", "max"))}
        parts += [
            rows(_described(stats, bounds), "describe", ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
            rows(outlier_counts(df, numbers, bounds, counts), "outliers", ["num_outliers", "lower_bound", "upper_bound"]),
            correlation_matrix(df, numbers, known).select(
                F.lit("correlation").alias("section"),
                F.col("column_x").alias("column_name"),
                F.col("column_y").alias("metric"),
                F.col("corr").alias("value_num"),
                F.lit(None).cast("string").alias("value_text"),
            ),
        ]
    else:
        parts.append(rows(describe_text(df), "describe", ["count", "unique", "top", "freq"], ("top",)))
    if text:
        names = df.sparkSession.createDataFrame([(c,) for c in text], "column_name string")
        modes = names.join(F.broadcast(values), "column_name", "left").select(
            "column_name",
            F.col("best.value").alias("mode"),
            F.coalesce(-F.col("best.n"), F.lit(0)).alias("mode_count"),
            F.coalesce("distinct_values", F.lit(0)).alias("unique_values"),
        )
        parts.append(rows(modes, "categorical", ["mode", "mode_count", "unique_values"], ("mode",)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
