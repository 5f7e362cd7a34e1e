"""Streaming queries over the events table as a file stream, run over what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.plans.catalog.jobs import JOB_EVENTS, JOBS, as_job_events, jobs
from tidemill.plans.catalog.profile import rounded
from tidemill.plans.session import work_dir
from tidemill.sources import queue
from tidemill.streaming import jobs as S
from tidemill.streaming.runner import ROCKSDB, ClosingSource, replay_delay, run_append, run_update, table_stream


# Files that a micro-batch of a replay takes.
FILES = 64


def events(s, d):
    return table_stream(s, d, "events", "ts", files_per_batch=FILES)


def delay(s, d):
    return replay_delay(s, d, "events", "ts")


def plain(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def windowed(s, d, build, label):
    """Run an append-mode window query to the end of the stream."""
    source = events(s, d).select("ts", "event_id", "user_id", "event_type", "value")
    closing = ClosingSource(source, "ts")
    return run_append(build(source.unionByName(closing.stream()), delay(s, d)), label, closing)


def q_dedup(s, d):
    """Every event delivered twice, kept once."""
    source = events(s, d).select("event_id", "ts", "event_type", "value")
    again = events(s, d).select("event_id", "ts", "event_type", "value")
    return plain(run_append(S.deduplicate(source.unionByName(again), ["event_id"], delay=delay(s, d)), "dedup"), "ts")


def q_rate(s, d):
    out = windowed(s, d, lambda e, wait: S.sliding_rate(e, ["event_type"], delay=wait), "rate")
    return rounded(plain(out.select("start", "event_type", "events", "rate"), "start"), 6)


def q_depth(s, d):
    return plain(windowed(s, d, lambda e, wait: S.tumbling_counts(e, ["event_type"], delay=wait), "depth"), "start")


def q_sessions(s, d):
    return plain(windowed(s, d, lambda e, wait: S.sessions(e, "user_id", delay=wait), "sessions"), "start", "end")


def job_stream(s, d):
    """Job events and the source that ends them."""
    source = as_job_events(events(s, d))
    closing = ClosingSource(source, "ts")
    return source.unionByName(closing.stream()), closing


def q_state(s, d):
    both, closing = job_stream(s, d)
    states = S.job_states(both, "job_id", "action", "ts", "event_id", delay(s, d))
    out = run_update(states, "job-state", ["job_id"], closing, ROCKSDB)
    seen = F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_seen")
    return out.select("job_id", "events", "status", "attempts", "rejected", seen)


def q_sliced(s, d):
    both, closing = job_stream(s, d)
    slices = S.job_slices(both, "job_id", "action", "ts", "event_id", delay(s, d), "1 hour")
    seen = F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_seen")
    return S.run_sliced_states(slices, "job-slices", closing, "day").select("job_id", "events", "status", "attempts", "rejected", seen)


def q_recovery(s, d):
    both, closing = job_stream(s, d)
    out = run_append(S.idle_decisions(both, "job_id", "action", "ts", "event_id", delay(s, d)), "recovery", closing, ROCKSDB)
    return out.select("job_id", "status", "attempts", "decision")


def q_queue(s, d):
    """All jobs put into a queue and taken from it in batches of a few groups, repeated deliveries left out."""
    folder = work_dir(s, "queue")
    queue.enqueue(jobs(s, d).select("id", F.to_json(F.struct("type", "status")).alias("body")), folder, files=12)
    taken = queue.read_queue(s, folder, admit=6).withColumn("at", F.timestamp_micros("enqueued_us"))
    out = run_append(S.deduplicate(taken, ["entry"], "at"), "queue", rounds=3)
    body = F.from_json("body", "type string, status string")
    return out.select(F.col("id").cast("long").alias("id"), body.alias("body")).select("id", "body.type", "body.status")


QUERIES = {
    "stream_queue": q_queue,
    "stream_dedup": q_dedup,
    "stream_rate_5m": q_rate,
    "stream_depth": q_depth,
    "stream_sessions": q_sessions,
    "stream_job_state": q_state,
    "stream_job_slices": q_sliced,
    "stream_recovery": q_recovery,
}

SQL = {
    "stream_queue": f"WITH {JOBS} SELECT id, type, status FROM jobs",
    "stream_dedup": "SELECT event_id, ts, event_type, value FROM events",
    "stream_rate_5m": """SELECT date_trunc('minute', ts) - to_minutes(k) AS start, event_type, count(*) AS events, round(count(*) / 300.0::DOUBLE, 6) AS rate
FROM events, (SELECT unnest(range(0, 5))::INTEGER AS k) GROUP BY 1, 2""",
    "stream_depth": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 24 HOUR THEN 1 ELSE 0 END AS fresh
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 24 HOUR AS "end", count(*) AS events FROM n GROUP BY user_id, session""",
    "stream_job_state": f"WITH RECURSIVE {JOB_EVENTS} SELECT job_id, events, status, attempts, rejected, last_seen FROM states",
    "stream_job_slices": f"WITH RECURSIVE {JOB_EVENTS} SELECT job_id, events, status, attempts, rejected, last_seen FROM states",
    "stream_recovery": f"""WITH RECURSIVE {JOB_EVENTS} SELECT job_id, status, attempts,
  CASE WHEN status IN ('completed', 'failed') THEN 'acknowledge' WHEN attempts >= 3 THEN 'fail' WHEN status = 'queued' THEN 'reprocess' ELSE 'stuck' END AS decision FROM states""",
}
