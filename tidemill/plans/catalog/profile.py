"""Profiler queries over line items (with gaps and blanks put in) and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import profile as P
from tidemill.operators import profile_state as PS
from tidemill.plans.session import load, work_dir

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_returnflag", "l_linestatus"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
COLUMNS = [*KEYS, *NUMBERS, *TEXTS, "l_shipdate"]


def items(spark, sf_dir):
    """Line items with missing discounts and return flags and some blank line states."""
    blank = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)
    return load(spark, sf_dir, "lineitem").select(
        *KEYS,
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.05)).alias("l_discount"),
        "l_tax",
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        F.when(blank, F.lit("  ")).otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        "l_shipdate",
    )


ITEMS = """items AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0.05) AS l_discount, l_tax,
         nullif(l_returnflag, 'R') AS l_returnflag,
         CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN '  ' ELSE l_linestatus END AS l_linestatus, l_shipdate
  FROM lineitem)"""


def each(columns, template):
    return "\nUNION ALL ".join(template.format(c=c) for c in columns)


def rounded(df, digits=4, skip=()):
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


NUM = [*KEYS, *NUMBERS]

QUARTILE_SQL = f"""q AS ({each(NUMBERS, "SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM items")}),
  b AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lower_bound, q75 + 1.5 * (q75 - q25) AS upper_bound FROM q)"""
CELLS_SQL = f"""cells AS ({each(NUM, "SELECT '{c}' AS column_name, l_orderkey, l_linenumber, {c}::DOUBLE AS value FROM items WHERE {c} IS NOT NULL")})"""
OUTLIER_SQL = "value < lower_bound OR value > upper_bound"
COUNTED = [*NUM, *TEXTS]
COUNTS_SQL = f"""counts AS ({each(COUNTED, "SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM items WHERE {c} IS NOT NULL GROUP BY ALL")})"""


STATE = "SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS count, count(*) - count({c}) AS missing"
STATES_SQL = "\nUNION ALL ".join(
    [
        each(NUM, STATE + ", 0::BIGINT AS blank, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM items"),
        each(TEXTS, STATE + ", count(*) FILTER (trim({c}) = ''), NULL, NULL, NULL, NULL FROM items"),
        each(["l_shipdate"], STATE + ", 0, NULL, NULL, NULL, NULL FROM items"),
    ]
)


def corr_sql(cols, body):
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, {body.format(a=a, b=b)} FROM items" for a in cols for b in cols
    )


def q_describe(spark, sf_dir):
    return rounded(P.describe(items(spark, sf_dir)))


def q_by_group(spark, sf_dir):
    df = items(spark, sf_dir).select(*TEXTS, *NUMBERS)
    return rounded(P.profile_by_group(df, TEXTS))


def q_full(spark, sf_dir):
    return rounded(P.full_profile(items(spark, sf_dir)))


def q_schema(spark, sf_dir):
    return P.schema_report(load(spark, sf_dir, "lineitem"))


SPARK_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END"

def q_states(s, d):
    """The exact part of a profile that was made in three batches, one of which was added twice."""
    folder = work_dir(s, "profile-state")
    for k in (0, 1, 2, 1):
        PS.add_batch(items(s, d).where(F.col("l_orderkey") % 3 == k), folder, str(k))
    found = PS.profile_of_states(*PS.stored_states(s, folder)).drop("distinct_estimate", "q25", "q50", "q75")
    return rounded(found).withColumn("mode", F.when(F.col("column_name").isin(TEXTS), F.col("mode")))


QUERIES = {
    "profile_of_states": q_states,
    "schema_report": q_schema,
    "profile_shape": lambda s, d: P.shape(items(s, d)),
    "profile_missing": lambda s, d: rounded(P.missing(items(s, d))),
    "profile_distinct": lambda s, d: P.distinct_counts(items(s, d)),
    "profile_blank": lambda s, d: P.blank_entries(items(s, d)),
    "profile_duplicates": lambda s, d: P.duplicate_rows(items(s, d)),
    "profile_describe": q_describe,
    "numeric_summary": lambda s, d: rounded(P.numeric_summary(items(s, d))),
    "iqr_outliers": lambda s, d: rounded(
        P.outlier_counts(load(s, d, "events").select("value").unionByName(load(s, d, "orders").select(F.col("o_totalprice").alias("value"))))
    ),
    "iqr_outlier_rows": lambda s, d: P.outlier_rows(load(s, d, "events").select("event_id", "user_id", "value"), ["event_id"]),
    "categorical_summary": lambda s, d: P.categorical_summary(items(s, d)),
    "value_frequencies": lambda s, d: rounded(P.value_frequencies(items(s, d), COUNTED), 6),
    "top_values": lambda s, d: P.top_values(items(s, d), 3, COUNTED),
    "correlation_matrix": lambda s, d: rounded(P.correlation_matrix(items(s, d).withColumn("flat", F.lit(1.0)))),
    "heatmap_cells": lambda s, d: P.heatmap_cells(items(s, d)),
    "profile_by_group": q_by_group,
    "profile_full": q_full,
    "histogram_30": lambda s, d: rounded(P.histogram(items(s, d))),
    "box_stats": lambda s, d: rounded(P.box_stats(load(s, d, "events").select("value", "user_id"))),
}

CORR = "regr_sxy({b}, {a}) / nullif(sqrt(regr_sxx({b}, {a})) * sqrt(regr_syy({b}, {a})), 0)"
FLAT_ITEMS = ITEMS.replace("items AS (", "items0 AS (") + ", items AS (SELECT *, 1.0::DOUBLE AS flat FROM items0)"

DESCRIBE_SQL = each(
    NUM,
    "SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    "round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, "
    "round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c})::DOUBLE, 4) AS max FROM items",
)
MISSING_SQL = each(
    COLUMNS,
    "SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct FROM items",
)
DISTINCT_SQL = each(COLUMNS, "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM items")
BLANK_SQL = each(
    TEXTS, "SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim({c}) = '') AS invalid FROM items"
) + "\nUNION ALL " + each([c for c in COLUMNS if c not in TEXTS], "SELECT '{c}' AS column_name, 0::BIGINT AS invalid FROM items LIMIT 1").replace(
    "FROM items LIMIT 1", ""
)
CATEGORICAL_SQL = each(
    TEXTS,
    "SELECT '{c}' AS column_name, (SELECT {c} FROM items WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, "
    "(SELECT count(*) FROM items WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS mode_count, count(DISTINCT {c}) AS unique_values FROM items",
)

ITEM_TYPES = """SELECT column_name, {types} AS data_type, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'other' ELSE 'numeric' END AS kind
FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE WITH {items} SELECT * FROM items))""".format(types=SPARK_TYPES, items=ITEMS)


def section(name, table, metrics, texts=()):
    """One section of the full profile from a table with a column per metric."""
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS section, column_name, '{m}' AS metric, "
        + (f"NULL::DOUBLE AS value_num, {m}::VARCHAR AS value_text" if m in texts else f"{m}::DOUBLE AS value_num, NULL::VARCHAR AS value_text")
        + f" FROM {table}"
        for m in metrics
    )


ALL_QUARTILES = each(NUM, "SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM items")
ALL_CELLS = each(NUM, "SELECT '{c}' AS column_name, {c}::DOUBLE AS value FROM items WHERE {c} IS NOT NULL")
FULL_SQL = f"""WITH {ITEMS}, s_types AS ({ITEM_TYPES}), s_missing AS ({MISSING_SQL}), s_blank AS ({BLANK_SQL}), s_distinct AS ({DISTINCT_SQL}),
  s_shape AS (SELECT '*' AS column_name, count(*) AS num_rows, {len(COLUMNS)} AS num_columns FROM items),
  s_dup AS (SELECT '*' AS column_name, sum(n - 1) AS duplicate_rows FROM (SELECT count(*) AS n FROM items GROUP BY {", ".join(COLUMNS)})),
  s_desc AS ({DESCRIBE_SQL}), s_cat AS ({CATEGORICAL_SQL}), s_q AS ({ALL_QUARTILES}), s_cells AS ({ALL_CELLS}),
  s_out AS (SELECT c.column_name, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS num_outliers,
    round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper_bound
    FROM s_cells c JOIN s_q q ON c.column_name = q.column_name GROUP BY 1),
  s_corr AS ({corr_sql(NUM, CORR + " AS corr")})
{section("schema", "s_types", ["data_type", "kind"], ("data_type", "kind"))}
UNION ALL {section("shape", "s_shape", ["num_rows", "num_columns"])}
UNION ALL {section("missing", "s_missing", ["missing", "missing_pct"])}
UNION ALL {section("invalid", "s_blank", ["invalid"])}
UNION ALL {section("unique", "s_distinct", ["distinct_values"])}
UNION ALL {section("duplicates", "s_dup", ["duplicate_rows"])}
UNION ALL {section("describe", "s_desc", ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])}
UNION ALL {section("outliers", "s_out", ["num_outliers", "lower_bound", "upper_bound"])}
UNION ALL {section("categorical", "s_cat", ["mode", "mode_count", "unique_values"], ("mode",))}
UNION ALL SELECT 'correlation', column_x, column_y, round(corr, 4), NULL FROM s_corr"""

SQL = {
    "profile_of_states": f"""WITH {ITEMS}, v AS ({each(COLUMNS, "SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM items WHERE {c} IS NOT NULL GROUP BY ALL")}),
b AS (SELECT column_name, count(*) AS distinct_values, max(n) AS mode_count, min(value) FILTER (n = top) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY column_name) AS top FROM v) GROUP BY ALL),
m AS ({STATES_SQL})
SELECT m.*, distinct_values, CASE WHEN column_name IN ('l_returnflag', 'l_linestatus') THEN mode END AS mode, mode_count FROM m JOIN b USING (column_name)""",
    "profile_full": FULL_SQL,
    "schema_report": f"""SELECT ordinal, column_name, {SPARK_TYPES} AS data_type,
  CASE WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'other' END AS kind
FROM (SELECT (row_number() OVER () - 1)::INTEGER AS ordinal, column_name, column_type AS data_type FROM (DESCRIBE lineitem))""",
    "profile_shape": f"WITH {ITEMS} SELECT count(*) AS num_rows, {len(COLUMNS)}::BIGINT AS num_columns FROM items",
    "profile_missing": f"WITH {ITEMS} {MISSING_SQL}",
    "profile_distinct": f"WITH {ITEMS} {DISTINCT_SQL}",
    "profile_blank": f"WITH {ITEMS} {BLANK_SQL}",
    "profile_duplicates": f"""WITH {ITEMS}, g AS (SELECT count(*) AS n FROM items GROUP BY {", ".join(COLUMNS)})
SELECT sum(n - 1)::BIGINT AS duplicate_rows FROM g""",
    "profile_describe": f"WITH {ITEMS} {DESCRIBE_SQL}",
    "numeric_summary": f"WITH {ITEMS}, d AS ({DESCRIBE_SQL}) SELECT column_name, mean, q50 AS median, std AS std_dev, min, max FROM d",
    "iqr_outliers": """WITH v AS (SELECT value FROM events UNION ALL SELECT o_totalprice FROM orders),
  q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v),
  b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT 'value' AS column_name, count(*) FILTER (WHERE value < lo OR value > hi) AS num_outliers,
  round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound FROM v, b""",
    "iqr_outlier_rows": """WITH v AS (SELECT 'value' AS column_name, event_id, value FROM events UNION ALL SELECT 'user_id', event_id, user_id::DOUBLE FROM events),
  q AS (SELECT column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1)
SELECT v.column_name, event_id, value FROM v JOIN q ON v.column_name = q.column_name
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "categorical_summary": f"WITH {ITEMS} {CATEGORICAL_SQL}",
    "value_frequencies": f"WITH {ITEMS}, {COUNTS_SQL} SELECT column_name, value, n, round(n / sum(n) OVER (PARTITION BY column_name), 6) AS share FROM counts",
    "top_values": f"""WITH {ITEMS}, {COUNTS_SQL}
SELECT * FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)::INTEGER AS rank FROM counts) WHERE rank <= 3""",
    "correlation_matrix": f"""WITH {FLAT_ITEMS} SELECT column_x, column_y, round(corr, 4) AS corr FROM ({corr_sql([*NUM, "flat"], CORR + " AS corr")})""",
    "heatmap_cells": f"""WITH {ITEMS} SELECT column_x, column_y, round(corr, 2) AS label FROM ({corr_sql(NUM, CORR + " AS corr")})""",
    "profile_by_group": f"""WITH {ITEMS}, cells AS ({each(NUMBERS, "SELECT l_returnflag, l_linestatus, '{c}' AS column_name, {c} AS value FROM items")})
SELECT l_returnflag, l_linestatus, column_name, count(value) AS count, count(*) - count(value) AS missing, round(avg(value), 4) AS mean,
  round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
  round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75
FROM cells GROUP BY 1, 2, 3""",
    "histogram_30": f"""WITH {ITEMS}, {CELLS_SQL},
  e AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM cells GROUP BY 1),
  w AS (SELECT column_name, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM e),
  h AS (SELECT c.column_name, lo, hi, least(floor((value - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*) AS n FROM cells c JOIN w ON c.column_name = w.column_name GROUP BY ALL)
SELECT column_name, bin, round(lo + bin * ((hi - lo) / 30), 4) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / 30), 4) AS bin_end, n FROM h""",
    "box_stats": """WITH v AS (SELECT 'value' AS column_name, value FROM events UNION ALL SELECT 'user_id', user_id::DOUBLE FROM events),
  q AS (SELECT column_name, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM v GROUP BY 1),
  f AS (SELECT v.column_name, value, q25, q50, q75, value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM v JOIN q ON v.column_name = q.column_name)
SELECT column_name, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75,
  round(least(min(value) FILTER (WHERE inside AND value <= q75), q25), 4) AS whisker_low,
  round(greatest(max(value) FILTER (WHERE inside AND value >= q25), q75), 4) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS fliers
FROM f GROUP BY column_name, q25, q50, q75""",
}
