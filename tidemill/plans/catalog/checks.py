"""Filters, key checks and ownership over orders (as jobs), customers (as owners) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import checks as C
from tidemill.operators import jobs as J
from tidemill.plans.catalog.jobs import JOBS, jobs
from tidemill.plans.catalog.profile import ITEMS, items
from tidemill.plans.session import load


def sessions(s, d):
    """One session per user, opened by the first event and valid for 24 hours."""
    first = load(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return first.withColumn("expires_at", F.col("created_at") + F.expr("interval 24 hours"))


def owned(s, d):
    """Jobs whose two owner columns overlap and leave gaps."""
    price = F.col("o_totalprice")
    return load(s, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(price >= 100000, F.col("o_custkey")).alias("user_id"),
        F.when((price < 110000) & (price > 20000), F.col("o_custkey")).alias("session_id"),
    )


def year_customers(s, d, year):
    o = load(s, d, "orders")
    start, end = F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    return o.where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)).select("o_custkey")


def promoted(s, d):
    """Sessions that registered as users."""
    return load(s, d, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("session_id"), (F.col("c_custkey") + 1000000).alias("new_user_id")
    )


def required_stops(s, d):
    return load(s, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("route_id"), F.col("l_suppkey").alias("stop"))


def visited_stops(s, d):
    return load(s, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("route_id"), F.col("l_suppkey").alias("stop"))


def q_owner_jobs(s, d):
    # the owner with the most jobs; one value fetched to parameterise the report
    top = jobs(s, d).where("user_id is not null").groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()
    return J.owner_jobs(jobs(s, d), user_id=top.user_id, statuses=["queued", "completed"]).select(
        "id", "type", "status", "attempts", "created_at"
    )


QUERIES = {
    "feature_projection": lambda s, d: C.project_features(
        items(s, d).drop("l_orderkey"), "l_extendedprice", ["l_quantity", "l_tax", "l_returnflag"]
    ),
    "drop_null_target": lambda s, d: C.drop_null_target(items(s, d), "l_discount").select("l_orderkey", "l_linenumber", "l_discount"),
    "owner_jobs": q_owner_jobs,
    "valid_session_events": lambda s, d: C.valid_session_rows(load(s, d, "events"), sessions(s, d), "user_id", "ts").select(
        "event_id", "user_id", "event_type"
    ),
    "check_one_owner": lambda s, d: C.owner_violations(owned(s, d)),
    "reconcile_keys": lambda s, d: C.reconcile_keys(year_customers(s, d, 1996), year_customers(s, d, 1997), ["o_custkey"]),
    "semi_exists": lambda s, d: C.existing(
        load(s, d, "events"), load(s, d, "customer").where("c_mktsegment = 'BUILDING'"), {"user_id": "c_custkey"}
    ).select("event_id", "user_id", "value"),
    "orphan_rows": lambda s, d: C.orphans(
        load(s, d, "orders"), load(s, d, "customer").where("c_mktsegment <> 'MACHINERY'"), {"o_custkey": "c_custkey"}
    ).select("o_orderkey", "o_custkey"),
    "set_difference": lambda s, d: C.reconcile_keys(required_stops(s, d), visited_stops(s, d), ["route_id", "stop"]),
    "duplicate_keys": lambda s, d: C.duplicate_keys(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey"),
    "reassign_owner": lambda s, d: C.reassign_owner(jobs(s, d).select("id", "user_id", "session_id"), promoted(s, d)),
}

SQL = {
    "feature_projection": f"WITH {ITEMS} SELECT l_quantity, l_tax, l_returnflag, l_extendedprice FROM items",
    "drop_null_target": f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, l_discount FROM items WHERE l_discount IS NOT NULL",
    "owner_jobs": f"""WITH {JOBS}, top AS (SELECT user_id FROM jobs WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT id, type, status, attempts, created_at FROM jobs WHERE user_id = (SELECT user_id FROM top) AND status IN ('queued', 'completed')
ORDER BY created_at DESC, id DESC""",
    "valid_session_events": """WITH s AS (SELECT user_id, min(ts) + INTERVAL 24 HOUR AS expires_at FROM events GROUP BY 1)
SELECT event_id, e.user_id, event_type FROM events e JOIN s ON e.user_id = s.user_id WHERE ts <= expires_at""",
    "check_one_owner": """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 100000 THEN o_custkey END AS user_id,
  CASE WHEN o_totalprice < 110000 AND o_totalprice > 20000 THEN o_custkey END AS session_id FROM orders)
SELECT *, CASE WHEN user_id IS NULL THEN 'no owner' ELSE 'two owners' END AS problem FROM o
WHERE (user_id IS NULL AND session_id IS NULL) OR (user_id IS NOT NULL AND session_id IS NOT NULL)""",
    "reconcile_keys": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996),
  b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
SELECT o_custkey, 'left_only' AS side FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)
UNION ALL SELECT o_custkey, 'right_only' FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""",
    "semi_exists": """SELECT event_id, user_id, value FROM events e
WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c_mktsegment = 'BUILDING')""",
    "orphan_rows": """SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_mktsegment <> 'MACHINERY')""",
    "set_difference": """WITH r AS (SELECT DISTINCT l_orderkey AS route_id, l_suppkey AS stop FROM lineitem WHERE l_returnflag <> 'R'),
  v AS (SELECT DISTINCT l_orderkey AS route_id, l_suppkey AS stop FROM lineitem WHERE l_linestatus = 'F')
SELECT *, 'left_only' AS side FROM (SELECT * FROM r EXCEPT SELECT * FROM v)
UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM v EXCEPT SELECT * FROM r)""",
    "duplicate_keys": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) FILTER (WHERE rn = 1) AS first_position, min(l_partkey) FILTER (WHERE rn = 2) AS second_position
FROM r GROUP BY 1, 2 HAVING count(*) > 1""",
    "reassign_owner": f"""WITH {JOBS}, m AS (SELECT c_custkey AS session_id, c_custkey + 1000000 AS new_user_id FROM customer WHERE c_acctbal > 0)
SELECT id, coalesce(new_user_id, user_id) AS user_id, CASE WHEN new_user_id IS NULL THEN j.session_id END AS session_id
FROM jobs j LEFT JOIN m ON j.session_id = m.session_id""",
}
