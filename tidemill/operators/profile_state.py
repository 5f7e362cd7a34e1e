"""Profiles that grow with their table: a stored state per batch of rows, and the profile of any number of states.

A state holds one row per column with counts, moments around the mean and two sketches, and one row per distinct value with its
count. States of batches that were profiled at different times are merged; no row is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.scalars import is_blank
from tidemill.operators.columns import aggregate_sql, col, columns_by_kind, name_sql, numeric_columns, string_columns, wide_to_long
from tidemill.operators.profile import value_counts
from tidemill.plans.session import without_nan

# Size of the sketches: distinct counts are within about 1.04 / sqrt(2 ** HLL_BITS) standard errors, ranks within about 1.7 / KLL_SIZE.
HLL_BITS = 12
KLL_SIZE = 400
COLUMNS_PER_PASS = 100

SUMS = ["rows", "n", "blank", "mean", "m2", "lo", "hi"]


@without_nan
def column_states(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row per column: rows, n (not null), blank, mean, m2 (sum of squares around it), lo, hi and the sketches.

    Moments and the quantile sketch are those of numbers, and null for other columns. A table without rows has
    states that change nothing. Sums and quantile sketches are passes of their own, since Spark compiles the sums only without sketches
    beside them. Distinct sketches see each value once: they are made of the table's ``value_counts``, which ``values`` takes if they are known.
    """
    numbers, texts = set(numeric_columns(df.schema)), set(string_columns(df.schema))
    parts = []
    for a in range(0, len(df.columns), COLUMNS_PER_PASS):
        names = df.columns[a : a + COLUMNS_PER_PASS]
        sums, sketches = [], []
        for i, c in enumerate(names):
            x, q = (f"double({name_sql(c)})" if c in numbers else "CAST(NULL AS double)"), name_sql(c)
            sums += [
                f"count(1) AS rows__{i}", f"count({q}) AS n__{i}",
                f"avg({x}) AS mean__{i}", f"var_pop({x}) * count({x}) AS m2__{i}", f"min({x}) AS lo__{i}", f"max({x}) AS hi__{i}",
            ]
            sums.append((F.count_if(is_blank(col(c))) if c in texts else F.count(F.lit(None))).alias(f"blank__{i}"))
            sketches += [f"kll_sketch_agg_double({x}, {KLL_SIZE}) AS quantile_sketch__{i}", f"hll_sketch_agg(CAST(NULL AS bigint), {HLL_BITS}) AS empty__{i}"]
        ranks = wide_to_long(aggregate_sql(df, sketches), names, ["quantile_sketch", "empty"])
        # one row per column
        parts.append(wide_to_long(aggregate_sql(df, sums), names, SUMS).join(F.broadcast(ranks), "column_name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    distinct = _distinct_sketches(df, value_counts(df) if values is None else values)
    found = F.coalesce("found", "empty").alias("distinct_sketch")  # a column without values has an empty sketch
    return out.join(F.broadcast(distinct), "column_name", "left").select("column_name", *SUMS, found, "quantile_sketch")


def _distinct_sketches(df: DataFrame, values: DataFrame) -> DataFrame:
    """A sketch of the distinct values of each column that has any. Numbers are hashed as numbers."""
    value = F.col("value")
    hashed = F.xxhash64(value)
    for kind, names in columns_by_kind(df, df.columns).items():
        if kind != "string":
            hashed = F.when(F.col("column_name").isin(names), F.xxhash64(value.cast(kind))).otherwise(hashed)
    return values.select("column_name", hashed.alias("hash")).groupBy("column_name").agg(F.hll_sketch_agg("hash", F.lit(HLL_BITS)).alias("found"))


def add_batch(df: DataFrame, folder: str, batch: str) -> None:
    """Profile the rows of a batch and store its state below ``folder``; a batch that is added again replaces itself."""
    values, written = value_counts(df), f"{folder}/values/batch={batch}"
    values.write.mode("overwrite").parquet(written)
    states = column_states(df, df.sparkSession.read.schema(values.schema).parquet(written))
    states.write.mode("overwrite").parquet(f"{folder}/columns/batch={batch}")


def stored_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The column states and value counts of all batches."""
    return tuple(spark.read.parquet(f"{folder}/{kind}").drop("batch") for kind in ("columns", "values"))


def merge_columns(states: DataFrame) -> DataFrame:
    """One state per column from many; moments are combined around the common mean, so nothing cancels out."""
    mean = (F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("centre")
    # one row per column
    centres = F.broadcast(states.groupBy("column_name").agg(mean))
    shift = F.col("mean") - F.col("centre")
    return states.join(centres, "column_name").groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in ("rows", "n", "blank")],
        F.first("centre").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def merge_values(values: DataFrame) -> DataFrame:
    return values.groupBy("column_name", "value").agg(F.sum("n").alias("n"))


def profile_of_states(states: DataFrame, values: DataFrame) -> DataFrame:
    """The profile of all batches: one row per column.

    Counts, moments, range, distinct values and the most frequent one (the smallest of several) are exact; ``distinct_estimate`` and
    the quartiles come from the sketches. ``std`` is that of a sample.
    """
    best = F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best")
    counted = merge_values(values).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"), best)
    quartiles = F.expr("if(lo IS NULL, NULL, kll_sketch_get_quantile_double(quantile_sketch, array(0.25D, 0.5D, 0.75D)))")
    merged = merge_columns(states).withColumn("quartiles", quartiles)
    return merged.join(counted, "column_name", "left").select(
        "column_name",
        "rows",
        F.col("n").alias("count"),
        (F.col("rows") - F.col("n")).alias("missing"),
        "blank",
        "mean",
        F.sqrt(F.try_divide("m2", F.col("n") - 1)).alias("std"),
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
        F.coalesce("distinct_values", F.lit(0)).cast("long").alias("distinct_values"),
        F.col("best.value").alias("mode"),
        (-F.col("best.n")).alias("mode_count"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
        *[F.col("quartiles")[k].alias(name) for k, name in enumerate(("q25", "q50", "q75"))],
    )
