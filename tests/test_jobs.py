import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import jobs as J

DAY = dt.datetime(2024, 1, 1)


def job_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id long, session_id long, created_at timestamp, type string, status string")


def test_retention_keeps_ten_per_owner(spark):
    rows = [(i, 1, None, DAY + dt.timedelta(hours=i), "image", "completed") for i in range(11)]
    rows += [(100 + i, None, 1, DAY + dt.timedelta(hours=i), "image", "completed") for i in range(11)]
    assert sorted(r.id for r in J.expired_jobs(job_rows(spark, rows)).collect()) == [0, 100]
    assert J.expired_jobs(job_rows(spark, rows[1:11])).count() == 0


def test_retention_breaks_ties_by_id(spark):
    rows = [(i, 1, None, DAY, "image", "completed") for i in range(5)]
    assert sorted(r.id for r in J.expired_jobs(job_rows(spark, rows), keep=2).collect()) == [0, 1, 2]


def test_queue_depth_lists_known_types(spark):
    rows = [(1, 1, None, DAY, "image", "queued"), (2, 1, None, DAY, "image", "failed"), (3, 1, None, DAY, "extra", "queued")]
    got = {r.type: r.depth for r in J.queue_depth(job_rows(spark, rows)).collect()}
    assert got == {"dataset": 0, "image": 1, "route": 0, "extra": 1}


def test_outstanding_limit(spark):
    rows = [(i, 1, None, DAY, "image", "queued" if i % 2 else "processing") for i in range(100)]
    assert J.outstanding(job_rows(spark, rows)).first().rejects_new
    assert not J.outstanding(job_rows(spark, rows[1:])).first().rejects_new


def test_owner_jobs(spark):
    rows = [(1, 1, None, DAY, "a", "queued"), (2, 1, None, DAY, "a", "failed"), (3, None, 1, DAY, "a", "queued")]
    assert [r.id for r in J.owner_jobs(job_rows(spark, rows), user_id=1).collect()] == [2, 1]
    assert [r.id for r in J.owner_jobs(job_rows(spark, rows), session_id=1, statuses=["queued"]).collect()] == [3]
    with pytest.raises(ValueError):
        J.owner_jobs(job_rows(spark, rows))


def test_latency_and_throughput(spark):
    rows = [(i, DAY, DAY + dt.timedelta(seconds=1), DAY + dt.timedelta(seconds=1, milliseconds=100 * i)) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, started_at timestamp, completed_at timestamp")
    got = {r.phase: r for r in J.latency_stats(df, []).collect()}
    assert got["processing"].p95_seconds == pytest.approx(2.8)  # element 27 of 0..29
    assert got["queue"].avg_seconds == pytest.approx(1.0) and got["total"].jobs == 30
    assert J.throughput(df, []).first().jobs_per_second == pytest.approx(30 / 4.0)


def test_latency_reads_its_jobs_once(spark, tmp_path):
    """Jobs may be an expensive join, so later passes go on from what was written down."""
    rows = [(i, DAY, DAY + dt.timedelta(seconds=i), DAY + dt.timedelta(seconds=2 * i)) for i in range(5)]
    spark.createDataFrame(rows, "id long, created_at timestamp, started_at timestamp, completed_at timestamp").write.parquet(str(tmp_path / "jobs"))
    got = J.latency_stats(spark.read.parquet(str(tmp_path / "jobs")), [])
    assert not any(str(tmp_path / "jobs") in file for file in got.inputFiles())
    assert {(r.phase, r.jobs, r.avg_seconds, r.p95_seconds) for r in got.collect()} == {("queue", 5, 2.0, 3.0), ("processing", 5, 2.0, 3.0), ("total", 5, 4.0, 6.0)}


def test_error_categories(spark):
    df = spark.createDataFrame([("image", "timeout"), ("image", "odd"), ("image", None)], "type string, error_type string")
    assert {r.error_type: r.failures for r in J.error_breakdown(df).collect()} == {"timeout": 1, "unknown": 2}


def test_histogram_quantile_edges(spark):
    df = spark.createDataFrame([("a", 0.001)] * 10 + [("b", 100.0)] * 3, "k string, s double")
    got = {r.k: r.quantile for r in J.histogram_quantile(J.duration_buckets(df, ["k"], "s"), ["k"], 0.5).collect()}
    assert got == {"a": pytest.approx(0.0025), "b": 10.0}


def test_counter_rate_counts_resets(spark):
    values = [(0, 10.0), (1, 15.0), (90, 3.0), (200, 4.0), (200, 9.0), (301, 50.0)]
    rows = [("s", DAY + dt.timedelta(seconds=s), v, i) for i, (s, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double, id int")
    got = J.counter_rate(df, ["k"], "ts", "v", "id").collect()
    assert len(got) == 1 and got[0].samples == 5
    assert got[0].increase == 5 + 3 + 1 + 5 and got[0].rate == pytest.approx(14 / 300)


@pytest.mark.parametrize("slice_seconds", [1, 7, 300])
@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_counter_rate_does_not_depend_on_slices(spark, slice_seconds, limit, row_limit):
    row_limit(limit)
    rnd = random.Random(2)
    rows = [(f"s{i % 2}", DAY + dt.timedelta(milliseconds=rnd.randrange(900_000)), float(rnd.randrange(50)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double, id int")
    got = {(r.k, r.window_start): r.increase for r in J.counter_rate(df, ["k"], "ts", "v", "id", slice_seconds=slice_seconds).collect()}
    want, last = {}, {}
    for k, ts, v, _ in sorted(rows, key=lambda r: (r[1], r[3])):
        w = (k, DAY + dt.timedelta(minutes=5 * ((ts - DAY).seconds // 300)))
        if w in last:
            want[w] = want.get(w, 0.0) + (v if v < last[w] else v - last[w])
        last[w] = v
    assert got == pytest.approx(want)


def test_latest_gauge(spark):
    rows = [("a", 1, 1, 5.0), ("a", 1, 2, 7.0), ("a", 2, 1, 3.0), ("b", 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "t string, u int, ts int, v double")
    got = {r.t: (r.series, r.value) for r in J.latest_gauge(df, ["t", "u"], ["t"], "v", ["ts"]).collect()}
    assert got == {"a": (2, 10.0), "b": (1, 1.0)}


def test_recovery_decisions(spark):
    old, new = DAY, DAY + dt.timedelta(seconds=50)
    rows = [("completed", 1, old), ("failed", 1, old), ("queued", 0, old), ("queued", 3, old), ("processing", 1, old), ("queued", 0, new)]
    df = spark.createDataFrame(rows, "status string, attempts int, seen timestamp")
    now = F.lit(DAY + dt.timedelta(seconds=60))
    got = [r.decision for r in J.recovery_decisions(df, now, "seen").collect()]
    assert got == ["acknowledge", "acknowledge", "reprocess", "fail", "stuck", "wait"]


def fold_slowly(events):
    state, attempts, rejected = "none", 0, 0
    for _, _, act in sorted(events):
        to = J.MOVES.get((state, act))
        rejected += to is None
        attempts += to == "processing"
        state = to or state
    return state, attempts, rejected


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_fold_matches_a_plain_loop(spark, limit, row_limit):
    row_limit(limit)
    rnd = random.Random(9)
    acts = ["enqueue", "start", "complete", "fail", "noise"]
    rows = []
    for i in range(3000):
        job = 0 if i % 3 == 0 else rnd.randrange(200)
        at = DAY + dt.timedelta(seconds=rnd.choice([rnd.randrange(200_000), rnd.randrange(90)]))
        rows.append((job, rnd.choice(acts), at, i))
    df = spark.createDataFrame(rows, "job long, act string, ts timestamp, id int")
    got = {r.job_id: (r.status, r.attempts, r.rejected) for r in J.fold_job_states(df, "job", "act", "ts", "id").collect()}
    per_job = {}
    for job, act, at, i in rows:
        per_job.setdefault(job, []).append((at, i, act))
    assert got == {job: fold_slowly(e) for job, e in per_job.items()}


def test_artifact_key(spark):
    df = spark.createDataFrame([(7, "/tmp/x/plot.png"), (8, "plain.json")], "id long, p string")
    got = [r.k for r in df.select(J.artifact_key(F.col("id"), F.col("p")).alias("k")).collect()]
    assert got == ["jobs/7/plot.png", "jobs/8/plain.json"]


def plain_rates(samples, seconds, step):
    """Rates at steps by going through every range."""
    out = {}
    for key in {k for k, *_ in samples}:
        mine = sorted((t, n, v) for k, t, n, v in samples if k == key)
        for at in range(0, max(t for t, *_ in mine) + seconds + step, step):
            seen = [v for t, _, v in mine if at - seconds < t <= at]
            if len(seen) > 1:
                out[key, at] = len(seen), sum(b if b < a else b - a for a, b in zip(seen, seen[1:]))
    return out


@pytest.mark.parametrize(("seconds", "step"), [(300, 60), (300, 45), (60, 60), (50, 120)])
def test_rates_at_every_step(spark, small_groups, seconds, step):
    """Resets, gaps, equal times, samples on the edge, and a hot series; ranges overlap or leave gaps."""
    rng = np.random.default_rng(seconds + step)
    samples = [("a", int(t), n, float(rng.integers(0, 50))) for n, t in enumerate(rng.integers(0, 2000, 150))]
    samples += [("hot", int(t), n, float(n % 40)) for n, t in enumerate(np.sort(rng.integers(600, 640, 300)))] + [("b", 60, 1, 5.0), ("b", 120, 2, 1.0)]
    df = spark.createDataFrame(samples, "k string, t long, n long, v double").withColumn("ts", F.timestamp_seconds("t"))
    got = J.range_rates(df.repartition(4), ["k"], "ts", "v", "n", seconds, step)
    epoch = F.unix_timestamp(F.col("step_end").cast("timestamp"))
    found = {(r.k, r.at): (r.samples, r.increase) for r in got.select("k", epoch.alias("at"), "samples", "increase").collect()}
    assert found == plain_rates(samples, seconds, step)
    assert J.range_rates(df.where("false"), ["k"], "ts", "v", "n").count() == 0


def test_quantiles_at_every_step(spark):
    """Two shards' counters; at each step the quantile of what was observed in the last minutes."""
    rows = []
    for shard, seen in ((0, [0.5, 0.5, 1.5, 1.5]), (1, [0.5, 3.0, 0.5, 9.0])):
        for bound in (1.0, 2.0, 4.0, None):
            for t in range(5):
                rows.append(("x", shard, bound, 60 * t, float(sum(bound is None or v <= bound for v in seen[:t]))))
    df = spark.createDataFrame(rows, "kind string, shard int, bound double, t long, n double").withColumn("ts", F.timestamp_seconds("t"))
    got = {str(r["step_end"])[11:16]: r["quantile"] for r in J.quantile_steps(df, ["kind"], ["shard"], 0.5, "ts", "n", "t", 300, 60).collect()}
    # after four minutes eight values: four up to 1, six up to 2, seven up to 4
    assert got["00:04"] == pytest.approx(1.0) and got["00:01"] == pytest.approx(0.5)
    assert got["00:07"] == pytest.approx(2.0), "only the last step of each shard is in the range"
    assert "00:08" not in got
