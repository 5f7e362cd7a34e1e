"""Job-table and metric queries. An order is a job, its customer the owner (a user for larger
orders, else a guest session); an event is a metric sample or a step in a job's life."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import jobs as J
from tidemill.plans.catalog.profile import rounded
from tidemill.plans.session import load


def jobs(s, d):
    price = F.col("o_totalprice")
    return load(s, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("dataset"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("image"))
        .otherwise(F.lit("archive"))
        .alias("type"),
        F.when(F.col("o_orderstatus") == "P", F.lit("queued"))
        .when(F.col("o_orderstatus") == "O", F.lit("processing"))
        .when(price < 50000, F.lit("failed"))
        .otherwise(F.lit("completed"))
        .alias("status"),
        F.floor(price / 100000).cast("int").alias("attempts"),
        F.col("o_orderdate").alias("created_at"),
        F.when(price >= 100000, F.col("o_custkey")).alias("user_id"),
        F.when(price < 100000, F.col("o_custkey")).alias("session_id"),
    )


JOBS = """jobs AS (
  SELECT o_orderkey AS id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'dataset' WHEN '2-HIGH' THEN 'image' ELSE 'archive' END AS type,
         CASE WHEN o_orderstatus = 'P' THEN 'queued' WHEN o_orderstatus = 'O' THEN 'processing' WHEN o_totalprice < 50000 THEN 'failed' ELSE 'completed' END AS status,
         floor(o_totalprice / 100000)::INTEGER AS attempts, o_orderdate AS created_at,
         CASE WHEN o_totalprice >= 100000 THEN o_custkey END AS user_id,
         CASE WHEN o_totalprice < 100000 THEN o_custkey END AS session_id
  FROM orders)"""


def timed_jobs(s, d):
    """Jobs with start and completion taken from the first and last shipment."""
    ships = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_shipdate").alias("started_at"), F.max("l_shipdate").alias("completed_at")
    )
    return jobs(s, d).join(ships, "id", "left")


TIMED = JOBS + """, ships AS (SELECT l_orderkey, min(l_shipdate) AS started_at, max(l_shipdate) AS completed_at FROM lineitem GROUP BY 1),
  timed AS (SELECT jobs.*, started_at, completed_at FROM jobs LEFT JOIN ships ON id = l_orderkey)"""


def failures(s, d):
    """Error events with a type from the value and a category from the event's properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(c) for c in J.ERROR_CATEGORIES])
    kind = F.when(F.col("value") < 10, F.lit("dataset")).when(F.col("value") < 50, F.lit("image")).otherwise(F.lit("route"))
    return load(s, d, "events").where("event_type = 'error'").select(
        kind.alias("type"), F.get(names, F.floor(k / 10).cast("int")).alias("error_type")
    )


def as_job_events(e):
    """Events of one user on one day are the life of one job."""
    action = (
        F.when(F.col("event_type") == "signup", F.lit("enqueue"))
        .when(F.col("event_type").isin("view", "click"), F.lit("start"))
        .when(F.col("event_type") == "purchase", F.lit("complete"))
        .otherwise(F.lit("fail"))
    )
    return e.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("job_id"), action.alias("action"), "ts", "event_id")


def job_events(s, d):
    return as_job_events(load(s, d, "events"))


JOB_EVENTS = """je AS (
  SELECT user_id * 100 + day(ts) AS job_id, ts, event_id,
         CASE WHEN event_type = 'signup' THEN 'enqueue' WHEN event_type IN ('view', 'click') THEN 'start' WHEN event_type = 'purchase' THEN 'complete' ELSE 'fail' END AS action,
         row_number() OVER (PARTITION BY user_id * 100 + day(ts) ORDER BY ts, event_id) AS rn,
         count(*) OVER (PARTITION BY user_id * 100 + day(ts)) AS n
  FROM events),
moves(frm, act, dest) AS (VALUES ('none', 'enqueue', 'queued'), ('queued', 'start', 'processing'), ('processing', 'complete', 'completed'), ('queued', 'fail', 'failed'), ('processing', 'fail', 'failed')),
fold AS (
  SELECT DISTINCT job_id, 0::BIGINT AS step, 'none' AS status, 0::BIGINT AS attempts, 0::BIGINT AS rejected, NULL::TIMESTAMP AS last_seen FROM je
  UNION ALL
  SELECT f.job_id, f.step + 1, coalesce(m.dest, f.status), f.attempts + CASE WHEN m.dest = 'processing' THEN 1 ELSE 0 END,
         f.rejected + CASE WHEN m.dest IS NULL THEN 1 ELSE 0 END, je.ts
  FROM fold f JOIN je ON je.job_id = f.job_id AND je.rn = f.step + 1
  LEFT JOIN moves m ON m.frm = f.status AND m.act = je.action),
states AS (SELECT f.job_id, je.n AS events, f.status, f.attempts, f.rejected, f.last_seen FROM fold f JOIN je ON je.job_id = f.job_id AND je.rn = f.step WHERE f.step = je.n)"""

BOUNDS_SQL = ", ".join(f"('{J.bound_label(b)}', {b}::DOUBLE)" for b in J.DURATION_BOUNDS)
BUCKETS = f"""bounds(le, bound) AS (VALUES {BOUNDS_SQL}, ('+Inf', NULL)),
  buckets AS (SELECT event_type, le, bound, count(*) FILTER (WHERE bound IS NULL OR value / 10 <= bound) AS cumulative
    FROM events, bounds GROUP BY ALL)"""


def buckets(s, d):
    e = load(s, d, "events").withColumn("seconds", F.col("value") / 10)
    return J.duration_buckets(e, ["event_type"], "seconds")


def q_recovery(s, d):
    table = jobs(s, d)
    now = table.agg(F.max("created_at")).scalar()
    done = J.recovery_decisions(table, now.cast("timestamp_ntz"), "created_at")
    return rounded(done.select("id", "status", "attempts", "idle_seconds", "decision"))


def step_sql(source, keys, seconds, step):
    """Common tables ending in r (keys, step_end, samples, increase): each sample goes to the steps whose range holds it."""
    return f"""s AS ({source}),
k AS (SELECT *, unnest(range(ceil(epoch_us(ts) / {step}e6)::BIGINT, (epoch_us(ts) + {seconds}000000 - 1) // {step}000000 + 1)) AS step FROM s WHERE value IS NOT NULL),
l AS (SELECT *, lag(value) OVER (PARTITION BY {keys}, step ORDER BY ts, tie) AS prev FROM k),
r AS (SELECT {keys}, make_timestamp(step * {step}000000) AS step_end, count(*) AS samples,
  sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END)::DOUBLE AS increase FROM l GROUP BY {keys}, step HAVING count(*) >= 2)"""


SCRAPE_BOUNDS = [10.0, 50.0, 100.0, 250.0]


def scrapes(s, d):
    """Counters of two shards' histograms, read every five minutes; each starts from zero every day."""
    e = load(s, d, "events").select("event_type", (F.col("user_id") % 2).alias("shard"), "value", F.date_trunc("day", "ts").alias("day"), F.col("ts").cast("timestamp").alias("t"))
    slot = F.ceil(F.unix_micros("t") / 300_000_000)
    bounds = F.array(*map(F.lit, SCRAPE_BOUNDS), F.lit(None).cast("double"))
    seen = e.select("event_type", "shard", "day", slot.alias("slot"), "value", F.explode(bounds).alias("bound"))
    counts = seen.groupBy("event_type", "shard", "bound", "day", "slot").agg(F.count_if(F.col("bound").isNull() | (F.col("value") <= F.col("bound"))).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("event_type", "shard", "bound", "day").orderBy("slot"))
    return counts.select("event_type", "shard", "bound", F.timestamp_micros(F.col("slot") * 300_000_000).alias("ts"), so_far.alias("n"))


QUERIES = {
    "queue_depth": lambda s, d: J.queue_depth(jobs(s, d)),
    "outstanding_limit": lambda s, d: J.outstanding(jobs(s, d)),
    "latency_stats": lambda s, d: rounded(J.latency_stats(timed_jobs(s, d), ["type"])),
    "throughput": lambda s, d: rounded(J.throughput(timed_jobs(s, d), ["type"]), 9),
    "error_breakdown": lambda s, d: J.error_breakdown(failures(s, d)),
    "duration_buckets": lambda s, d: buckets(s, d).drop("bound"),
    "histogram_quantile": lambda s, d: rounded(J.histogram_quantile(buckets(s, d), ["event_type"], 0.95)),
    "retention_expired": lambda s, d: J.expired_jobs(jobs(s, d), keep=3).select("id", "user_id", "session_id", "created_at"),
    "percentile_lower_rank": lambda s, d: J.lower_rank_percentile(load(s, d, "events"), ["event_type"], "value", 0.95),
    "counter_rate": lambda s, d: rounded(J.counter_rate(load(s, d, "events"), ["event_type"], "ts", "value", "event_id"), 6),
    "range_rates": lambda s, d: rounded(J.range_rates(load(s, d, "events"), ["event_type"], "ts", "value", "event_id", 21600, 3600), 8),
    "latency_p95_steps": lambda s, d: rounded(J.quantile_steps(scrapes(s, d), ["event_type"], ["shard"], 0.95, "ts", "n", "ts", 21600, 3600)),
    "latest_gauge": lambda s, d: rounded(
        J.latest_gauge(load(s, d, "events"), ["event_type", "user_id"], ["event_type"], "value", ["ts", "event_id"])
    ),
    "job_state_fold": lambda s, d: J.fold_job_states(job_events(s, d), "job_id", "action", "ts", "event_id"),
    "recovery_decision": q_recovery,
    "artifact_keys": lambda s, d: load(s, d, "pages").select(
        "page_id", J.artifact_key(F.col("page_id"), F.regexp_extract("url", r"^([^?#]*)", 1)).alias("artifact_key")
    ),
}

SQL = {
    "queue_depth": f"""WITH {JOBS}, q AS (SELECT type, count(*) AS depth FROM jobs WHERE status = 'queued' GROUP BY 1
  UNION ALL SELECT * FROM (VALUES ('dataset', 0), ('image', 0), ('route', 0)))
SELECT type, max(depth) AS depth FROM q GROUP BY 1""",
    "outstanding_limit": f"""WITH {JOBS}, n AS (SELECT count(*) FILTER (WHERE status IN ('queued', 'processing')) AS outstanding FROM jobs)
SELECT outstanding, 100::BIGINT AS job_limit, outstanding >= 100 AS rejects_new FROM n""",
    "latency_stats": f"""WITH {TIMED}, c AS (
  SELECT type, 'queue' AS phase, date_diff('microsecond', created_at, started_at) / 1e6 AS sec FROM timed WHERE completed_at IS NOT NULL
  UNION ALL SELECT type, 'processing', date_diff('microsecond', started_at, completed_at) / 1e6 FROM timed WHERE completed_at IS NOT NULL
  UNION ALL SELECT type, 'total', date_diff('microsecond', created_at, completed_at) / 1e6 FROM timed WHERE completed_at IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY type, phase ORDER BY sec) AS rn, count(*) OVER (PARTITION BY type, phase) AS n FROM c)
SELECT type, phase, count(*) AS jobs, round(avg(sec), 4) AS avg_seconds,
  round(max(sec) FILTER (WHERE rn = floor((n - 1) * 0.95::DOUBLE)::BIGINT + 1), 4) AS p95_seconds
FROM r GROUP BY 1, 2""",
    "throughput": f"""WITH {TIMED} SELECT type, count(*) AS jobs,
  round(count(*)::DOUBLE / ((epoch_us(max(completed_at)) - epoch_us(min(created_at))) / 1e6), 9) AS jobs_per_second
FROM timed WHERE completed_at IS NOT NULL GROUP BY 1""",
    "error_breakdown": f"""WITH f AS (SELECT CASE WHEN value < 10 THEN 'dataset' WHEN value < 50 THEN 'image' ELSE 'route' END AS type,
  coalesce(({J.ERROR_CATEGORIES!r}::VARCHAR[])[floor(json_extract(props, '$.k')::INTEGER / 10)::INTEGER + 1], 'unknown') AS error_type
  FROM events WHERE event_type = 'error')
SELECT type, error_type, count(*) AS failures FROM f GROUP BY 1, 2""",
    "duration_buckets": f"WITH {BUCKETS} SELECT event_type, le, cumulative FROM buckets",
    "histogram_quantile": f"""WITH {BUCKETS}, w AS (
  SELECT *, coalesce(lag(cumulative) OVER o, 0) AS below, coalesce(lag(bound) OVER o, 0) AS start,
    0.95::DOUBLE * max(cumulative) OVER (PARTITION BY event_type) AS rank, max(bound) OVER (PARTITION BY event_type) AS top
  FROM buckets WINDOW o AS (PARTITION BY event_type ORDER BY bound ASC NULLS LAST))
SELECT event_type, round(CASE WHEN bound IS NULL THEN top ELSE start + (bound - start) * (rank - below) / (cumulative - below) END, 4) AS quantile
FROM w WHERE below < rank AND rank <= cumulative""",
    "retention_expired": f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs)
SELECT id, user_id, session_id, created_at FROM r WHERE rn > 3""",
    "percentile_lower_rank": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) AS percentile FROM r WHERE rn = floor((n - 1) * 0.95::DOUBLE)::BIGINT + 1 GROUP BY 1""",
    "counter_rate": """WITH t AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, value,
  lag(value) OVER (PARTITION BY event_type, time_bucket(INTERVAL 5 MINUTE, ts) ORDER BY ts, event_id) AS prev FROM events),
  g AS (SELECT event_type, window_start, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS gain FROM t)
SELECT event_type, window_start, count(*) AS samples, round(sum(gain), 6) AS increase, round(sum(gain) / 300, 6) AS rate
FROM g GROUP BY 1, 2 HAVING count(*) >= 2""",
    "range_rates": f"""WITH {step_sql("SELECT event_type, ts, value, event_id AS tie FROM events", "event_type", 21600, 3600)}
SELECT event_type, step_end, samples, round(increase, 8) AS increase, round(increase / 21600, 8) AS rate FROM r""",
    "latency_p95_steps": f"""WITH b AS (SELECT unnest([{", ".join(map(str, SCRAPE_BOUNDS))}, NULL]) AS bound),
c AS (SELECT event_type, user_id % 2 AS shard, bound, date_trunc('day', ts) AS day, ceil(epoch_us(ts) / 300000000)::BIGINT AS slot,
  count(*) FILTER (bound IS NULL OR value <= bound) AS n FROM events, b GROUP BY ALL),
m AS (SELECT event_type, shard, bound, make_timestamp(slot * 300000000::BIGINT) AS ts, sum(n) OVER (PARTITION BY event_type, shard, bound, day ORDER BY slot)::DOUBLE AS value FROM c),
{step_sql("SELECT event_type, shard, bound, ts, value, ts AS tie FROM m", "event_type, shard, bound", 21600, 3600)},
a AS (SELECT event_type, step_end, bound, sum(increase / 21600) AS cumulative FROM r GROUP BY ALL),
w AS (SELECT *, coalesce(lag(cumulative) OVER o, 0) AS below, coalesce(lag(bound) OVER o, 0) AS start,
    0.95::DOUBLE * max(cumulative) OVER (PARTITION BY event_type, step_end) AS rank, max(bound) OVER (PARTITION BY event_type, step_end) AS top
  FROM a WINDOW o AS (PARTITION BY event_type, step_end ORDER BY bound ASC NULLS LAST))
SELECT event_type, step_end, round(CASE WHEN bound IS NULL THEN top ELSE start + (bound - start) * (rank - below) / (cumulative - below) END, 4) AS quantile
FROM w WHERE below < rank AND rank <= cumulative""",
    "latest_gauge": """WITH l AS (SELECT event_type, user_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS series, round(sum(value), 4) AS value FROM l GROUP BY 1""",
    "job_state_fold": f"WITH RECURSIVE {JOB_EVENTS} SELECT job_id, events, status, attempts, rejected, last_seen FROM states",
    "recovery_decision": f"""WITH {JOBS}, i AS (SELECT *, date_diff('microsecond', created_at, (SELECT max(created_at) FROM jobs)) / 1e6 AS idle_seconds FROM jobs)
SELECT id, status, attempts, round(idle_seconds, 4) AS idle_seconds,
  CASE WHEN idle_seconds < 30 THEN 'wait' WHEN status IN ('completed', 'failed') THEN 'acknowledge' WHEN attempts >= 3 THEN 'fail'
       WHEN status = 'queued' THEN 'reprocess' ELSE 'stuck' END AS decision FROM i""",
    "artifact_keys": """SELECT page_id, concat('jobs/', page_id, '/', regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '([^/]*)$', 1)) AS artifact_key FROM pages""",
}
