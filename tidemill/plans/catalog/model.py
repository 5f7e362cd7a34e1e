"""Regression queries: predict the price of a line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import model as M
from tidemill.plans.catalog.profile import ITEMS, items, rounded
from tidemill.plans.session import load

KEYS = ["l_orderkey", "l_linenumber"]
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
TARGET = "l_extendedprice"

# one forest per application and table content; its training data and predictions are written tables
_fitted: dict[tuple, M.ForestResult] = {}


def forest(s, d):
    """The library's defaults: 100 trees without a depth limit. This takes minutes, so its three queries share it."""
    rows = items(s, d)
    content = rows.select(F.xxhash64(*KEYS, *FEATURES, TARGET).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.shiftright("h", 20))).first()
    key = (s.sparkContext.applicationId, d, *content)
    if key not in _fitted:
        _fitted[key] = M.train_forest(rows, TARGET, KEYS, FEATURES)
    return _fitted[key]


def q_forest_rules(s, d):
    """What holds for any forest: one prediction per test row, inside the targets' range, and shares that add up."""
    fitted = forest(s, d)
    wanted = M.train_test_split(items(s, d).where(F.col(TARGET).isNotNull()), [*KEYS, *FEATURES, TARGET])
    ends = wanted.where(~F.col("is_test")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    checked = fitted.predictions.join(F.broadcast(ends)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(*KEYS).alias("keys"),
        F.count_if(F.col("predicted").between(F.col("lo") - 1e-6, F.col("hi") + 1e-6)).alias("inside"),
    )
    shares = fitted.importances.agg(F.round(F.sum("importance"), 6).alias("importance"), F.count(F.lit(1)).alias("features"))
    # both sides are one row
    return checked.join(F.broadcast(shares))


def predictor(s, d):
    """A fixed rule instead of a model, so the metrics can be recomputed elsewhere."""
    return load(s, d, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * F.lit(2000.0) + 1000).alias("predicted")
    )


def parts(s, d):
    return load(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")


def q_one_hot(s, d):
    """Brands learned from small parts, applied to all parts: one row per non-zero slot."""
    hot = M.one_hot(parts(s, d).where("p_size <= 25"), parts(s, d), ["p_brand", "p_type"])
    both = [
        M.hot_slots(hot.select("p_partkey", f"{c}__hot"), c).select("p_partkey", F.lit(c).alias("column_name"), "slot")
        for c in ("p_brand", "p_type")
    ]
    return both[0].unionByName(both[1])


QUERIES = {
    "impute_mode": lambda s, d: M.impute_mode(items(s, d), ["l_returnflag", "l_linestatus"]).select(*KEYS, "l_returnflag", "l_linestatus"),
    "impute_median": lambda s, d: rounded(M.impute_median(items(s, d), ["l_discount"]).select(*KEYS, "l_discount")),
    "one_hot": q_one_hot,
    "train_test_split": lambda s, d: M.train_test_split(load(s, d, "lineitem"), KEYS).select(*KEYS, "is_test"),
    "rf_predictions": lambda s, d: forest(s, d).predictions,
    "rf_importance": lambda s, d: forest(s, d).importances,
    "rf_rules": q_forest_rules,
    "regression_metrics": lambda s, d: rounded(M.regression_metrics(predictor(s, d)), 2).withColumn("r2", F.round("r2", 2)),
}

SQL = {
    "rf_rules": f"""WITH {ITEMS}, t AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS k FROM items WHERE l_extendedprice IS NOT NULL
  AND concat('0x', substr(md5(concat_ws('|', 42, {", ".join([*KEYS, *FEATURES, TARGET])})), 1, 8))::BIGINT % 100 < 20)
SELECT n AS rows, k AS keys, n AS inside, 1.0::DOUBLE AS importance, 5::BIGINT AS features FROM t""",
    "impute_mode": f"""WITH {ITEMS} SELECT l_orderkey, l_linenumber,
  coalesce(l_returnflag, (SELECT l_returnflag FROM items WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag,
  l_linestatus FROM items""",
    "impute_median": f"""WITH {ITEMS} SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, (SELECT median(l_discount) FROM items)), 4) AS l_discount FROM items""",
    "one_hot": """WITH b AS (SELECT p_brand AS v, row_number() OVER (ORDER BY p_brand) - 1 AS slot FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 25)),
  t AS (SELECT p_type AS v, row_number() OVER (ORDER BY p_type) - 1 AS slot FROM (SELECT DISTINCT p_type FROM part WHERE p_size <= 25))
SELECT p_partkey, 'p_brand' AS column_name, slot::INTEGER AS slot FROM part JOIN b ON p_brand = v
UNION ALL SELECT p_partkey, 'p_type', slot::INTEGER FROM part JOIN t ON p_type = v""",
    "train_test_split": """SELECT l_orderkey, l_linenumber,
  concat('0x', substr(md5(concat('42|', l_orderkey::VARCHAR, '|', l_linenumber::VARCHAR)), 1, 8))::BIGINT % 100 < 20 AS is_test FROM lineitem""",
    "regression_metrics": """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000.0::DOUBLE + 1000 AS p FROM lineitem)
SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 2) AS r2, round(avg((y - p) * (y - p)), 2) AS mse, count(*) AS rows,
  round(min(y), 2) AS actual_min, round(max(y), 2) AS actual_max FROM p""",
}
