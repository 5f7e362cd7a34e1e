import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_jobs import fold_slowly
from tidemill.operators import jobs as J
from tidemill.streaming import jobs as S
from tidemill.streaming.runner import ROCKSDB, ClosingSource, keyed_overwrite, newest_per_key, replay_delay, run_append, run_update, state_store, table_stream

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
T0 = dt.datetime(2024, 1, 1)


def put(spark, path, rows, number):
    # one file per call, so that each becomes a micro-batch of its own
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part={number}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    rows = [(i, at(i), 1, "click") for i in range(5)]
    put(spark, tmp_path, rows, 0)
    put(spark, tmp_path, rows[3:] + [(5, at(5), 1, "click")], 1)
    out = run_append(S.deduplicate(stream(spark, str(tmp_path)), ["event_id"]), "t-dedup")
    assert sorted(r.event_id for r in out.collect()) == list(range(6))


def test_late_rows_are_dropped(spark, tmp_path):
    put(spark, tmp_path, [(1, at(0), 1, "click"), (2, at(300), 1, "click")], 0)
    put(spark, tmp_path, [(5, at(301), 1, "click")], 1)  # lateness is judged by the watermark one batch back
    put(spark, tmp_path, [(3, at(1), 1, "click"), (4, at(295), 1, "click")], 2)
    source = stream(spark, str(tmp_path))
    closing = ClosingSource(source, "ts")
    out = run_append(S.tumbling_counts(source.unionByName(closing.stream()), ["event_type"]), "t-late", closing)
    got = {r.start: r.events for r in out.collect()}
    assert got == {at(0): 1, at(240): 1, at(300): 2}  # the row for minute 1 came too late


def test_sliding_windows(spark, tmp_path):
    put(spark, tmp_path, [(1, at(10), 1, "click"), (2, at(12), 1, "click")], 0)
    source = stream(spark, str(tmp_path))
    closing = ClosingSource(source, "ts")
    out = run_append(S.sliding_rate(source.unionByName(closing.stream()), ["event_type"]), "t-rate", closing)
    got = {r.start: r.events for r in out.collect()}
    assert got == {at(6): 1, at(7): 1, at(8): 2, at(9): 2, at(10): 2, at(11): 1, at(12): 1}
    assert {round(r.rate, 6) for r in out.collect()} == {round(1 / 300, 6), round(2 / 300, 6)}


def test_sessions_split_after_a_day(spark, tmp_path):
    put(spark, tmp_path, [(1, at(0), 1, "x"), (2, at(600), 1, "x"), (3, at(600 + 1441), 1, "x"), (4, at(5), 2, "x")], 0)
    source = stream(spark, str(tmp_path))
    closing = ClosingSource(source, "ts")
    out = run_append(S.sessions(source.unionByName(closing.stream()), "user_id"), "t-sess", closing)
    assert sorted((r.user_id, r.events) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_state_across_batches_matches_a_plain_loop(spark, tmp_path):
    rnd = random.Random(4)
    acts = ["enqueue", "start", "complete", "fail"]
    rows = [(i, at(i), rnd.randrange(12), rnd.choice(acts)) for i in range(120)]
    mixed = rnd.sample(rows, len(rows))  # every batch has events that belong before those of earlier ones
    for k in range(3):
        put(spark, tmp_path, mixed[k::3], k)
    source = stream(spark, str(tmp_path))
    closing = ClosingSource(source, "ts")
    states = S.job_states(source.unionByName(closing.stream()), "user_id", "event_type", "ts", "event_id", "3 hours")
    out = run_update(states, "t-state", ["job_id"], closing, ROCKSDB)
    per_job = {}
    for i, ts, job, act in rows:
        per_job.setdefault(job, []).append((ts, i, act))
    assert {r.job_id: (r.status, r.attempts, r.rejected) for r in out.collect()} == {j: fold_slowly(e) for j, e in per_job.items()}


def test_start_before_enqueue_in_another_batch(spark, tmp_path):
    put(spark, tmp_path, [(2, at(1), 7, "start"), (3, at(2), 7, "complete")], 0)
    put(spark, tmp_path, [(1, at(0), 7, "enqueue")], 1)
    source = stream(spark, str(tmp_path))
    closing = ClosingSource(source, "ts")
    states = S.job_states(source.unionByName(closing.stream()), "user_id", "event_type", "ts", "event_id")
    (row,) = run_update(states, "t-order", ["job_id"], closing, ROCKSDB).collect()
    assert (row.status, row.attempts, row.rejected) == ("completed", 1, 0)


@pytest.mark.parametrize("files", [None, 1])
def test_a_folder_table_in_several_batches_equals_the_batch_result(spark, tmp_path, files):
    rows = [(i, at((i * 37) % 500), i % 5, "abc"[i % 3]) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    source = table_stream(spark, str(tmp_path), "events", "ts", files_per_batch=files)
    closing = ClosingSource(source, "ts")
    wait = replay_delay(spark, str(tmp_path), "events", "ts")
    out = run_append(S.tumbling_counts(source.unionByName(closing.stream()), ["event_type"], delay=wait), "t-folder", closing)
    want = {}
    for _, ts, _, kind in rows:
        key = (ts.replace(minute=0), kind)
        want[key] = want.get(key, 0) + 1
    assert {(r.start, r.event_type): r.events for r in out.collect()} == want
    kept = run_append(S.deduplicate(source, ["event_id"], delay=wait), "t-folder-dedup")
    assert kept.count() == 200


def test_the_state_provider_is_the_query_s_own(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    put(spark, tmp_path, [(1, at(0), 1, "enqueue")], 0)
    states = S.job_states(stream(spark, str(tmp_path)), "user_id", "event_type", "ts", "event_id")
    run_update(states, "t-provider", ["job_id"], None, ROCKSDB)
    assert spark.conf.get(key, None) == before


def test_idle_jobs_get_one_decision(spark, tmp_path):
    put(spark, tmp_path, [(1, at(0), 1, "enqueue"), (2, at(0), 2, "enqueue"), (3, at(1), 2, "start"), (4, at(2), 3, "complete")], 0)
    source = stream(spark, str(tmp_path))
    closing = ClosingSource(source, "ts")
    out = run_append(
        S.idle_decisions(source.unionByName(closing.stream()), "user_id", "event_type", "ts", "event_id"), "t-idle", closing, ROCKSDB
    )
    assert {(r.job_id, r.decision) for r in out.collect()} == {(1, "reprocess"), (2, "stuck"), (3, "stuck")}


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = keyed_overwrite(str(tmp_path / "sink"))
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    write(a, 0)
    write(a, 0)
    write(spark.createDataFrame([(2, 21)], "k int, v int"), 1)
    table = spark.read.parquet(str(tmp_path / "sink"))
    assert table.count() == 3
    assert {tuple(r) for r in newest_per_key(table, ["k"]).collect()} == {(1, 10), (2, 21)}


def test_sliced_states_equal_a_plain_loop(spark, tmp_path):
    """Events in any order over several batches; one job has a third of all of them; late slices follow earlier ones."""
    rnd = random.Random(9)
    acts = ["enqueue", "start", "complete", "fail", "odd"]
    rows = [(i, at(rnd.randrange(90)), 0 if i % 3 == 0 else rnd.randrange(1, 9), rnd.choice(acts)) for i in range(150)]
    for k in range(3):
        put(spark, tmp_path, rows[k::3], k)
    source = stream(spark, str(tmp_path))
    closing = ClosingSource(source, "ts")
    slices = S.job_slices(source.unionByName(closing.stream()), "user_id", "event_type", "ts", "event_id", "3 hours", "7 minutes")
    out = S.run_sliced_states(slices, "t-slices", closing)
    per_job = {}
    for i, ts, job, act in rows:
        per_job.setdefault(job, []).append((ts, i, act))
    assert {r.job_id: (r.status, r.attempts, r.rejected) for r in out.collect()} == {j: fold_slowly(e) for j, e in per_job.items()}
    assert {r.job_id: r.events for r in out.collect()} == {j: len(e) for j, e in per_job.items()}


def test_jobs_of_a_slice_share_state_rows(spark, tmp_path, monkeypatch):
    """Events of many jobs in few slices wait in a row per slice and bucket, and come out per job; jobs without a number too."""
    monkeypatch.setattr(S, "SLICE_BUCKETS", 4)
    rnd = random.Random(4)
    acts = ["enqueue", "start", "complete", "fail", "odd"]
    rows = [(i, at(rnd.randrange(60)), None if i % 11 == 0 else rnd.randrange(40), rnd.choice(acts)) for i in range(400)]
    for k in range(2):
        put(spark, tmp_path, rows[k::2], k)
    source = stream(spark, str(tmp_path))
    closing = ClosingSource(source, "ts")
    slices = S.job_slices(source.unionByName(closing.stream()), "user_id", "event_type", "ts", "event_id", "3 hours", "30 minutes")
    kept = []

    def once():
        query = slices.writeStream.foreachBatch(lambda batch, _: kept.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)

    assert once() <= 2 * 5, "4 buckets and that of jobs without a number"
    closing.close()
    once()
    want = {}
    for i, ts, job, act in rows:
        want.setdefault((job, ts.minute // 30), []).append((ts, i, act))
    assert len(kept) == len(want)
    for r in kept:
        events = want[r.job_id, r.slice.minute // 30]
        first = r.outcome[0]
        assert (r.events, first.state, first.attempts, first.rejected) == (len(events), *fold_slowly(events))
        assert r.at_us == max(ts for ts, _, _ in events).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000


def test_outcomes_of_runs_from_every_state(spark):
    rnd = random.Random(8)
    acts = ["enqueue", "start", "complete", "fail", "other"]
    runs = [[]] + [[rnd.choice(acts) for _ in range(rnd.randrange(1, 9))] for _ in range(200)] + [["other"] * 3000]
    df = spark.createDataFrame([(r,) for r in runs], "run array<string>")
    for (run, outcome) in df.select("run", J.outcome_of(F.col("run"))).collect():
        for start, got in zip(J.STATES, outcome):
            state, attempts, rejected = start, 0, 0
            for act in run:
                to = J.MOVES.get((state, act))
                state, attempts, rejected = to or state, attempts + (to == "processing"), rejected + (to is None)
            assert tuple(got) == (state, attempts, rejected)


def test_slices_of_later_batches_go_on_from_the_states_before(spark, tmp_path):
    write, path = S.chain_into(str(tmp_path / "out")), str(tmp_path / "out")
    maps = lambda acts: S.outcome_of(F.array(*map(F.lit, acts)))

    def batch(job, minute, acts):
        return spark.range(1).select(F.lit(job).cast("long").alias("job_id"), F.lit(at(minute)).alias("slice"), F.lit(len(acts)).cast("long").alias("events"), F.lit(minute).cast("long").alias("at_us"), maps(acts).alias("outcome"))

    write(batch(1, 5, ["enqueue"]).unionByName(batch(2, 5, ["enqueue", "fail"])), 0)
    for _ in range(2):  # a repeated batch changes nothing
        write(batch(1, 80, ["complete"]).unionByName(batch(1, 7, ["start", "start"])), 1)
    got = {r.job_id: (r.status, r.attempts, r.rejected, r.events) for r in S.states_before(spark, path, 9).collect()}
    assert got == {1: ("completed", 1, 1, 4), 2: ("failed", 0, 0, 2)}


def test_silence_is_noticed_by_the_clock(spark, tmp_path):
    """Nothing arrives after the first batch; the decisions come all the same."""
    import time

    put(spark, tmp_path, [(1, at(0), 1, "enqueue"), (2, at(0), 2, "enqueue"), (3, at(1), 2, "start"), (4, at(2), 3, "odd")], 0)
    result = S.silent_decisions(stream(spark, str(tmp_path)), "user_id", "event_type", "ts", "event_id", idle_seconds=1)
    with state_store(spark, ROCKSDB):
        query = result.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.monotonic() + 120
        while time.monotonic() < end and spark.table("silent").count() < 3:
            time.sleep(1)
    finally:
        query.stop()
    got = [(r.job_id, r.decision) for r in spark.table("silent").orderBy("job_id").collect()]
    assert got == [(1, "reprocess"), (2, "stuck"), (3, "stuck")]


class Store:
    """Keeps states and timers of one key in memory and counts the calls that go to the store."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getMapState(self, name, key, value):
        return Kept(self, {})

    getValueState = getListState = lambda self, name, schema: Kept(self, None)

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at_ms):
        self.calls += 1
        self.timers.append(at_ms)

    def deleteTimer(self, at_ms):
        self.calls += 1
        self.timers.remove(at_ms)


class Kept:
    def __init__(self, store, value):
        self.store, self.value = store, value

    def __getattr__(self, name):
        self.store.calls += 1
        return {
            "exists": lambda: bool(self.value),
            "get": lambda: iter(self.value or []) if isinstance(self.value, (list, type(None))) else self.value,
            "update": lambda v: setattr(self, "value", v),
            "put": lambda v: setattr(self, "value", list(v)),
            "appendList": lambda v: setattr(self, "value", [*(self.value or []), *v]),
            "clear": lambda: setattr(self, "value", None),
            "getValue": lambda k: self.value.get(k),
            "updateValue": lambda k, v: self.value.__setitem__(k, v),
            "removeKey": lambda k: self.value.pop(k, None),
            "iterator": lambda: iter(list(self.value.items())),
        }[name]


class Clock:
    def __init__(self, mark_ms):
        self.mark_ms = mark_ms

    def getCurrentWatermarkInMs(self):
        return self.mark_ms


def replay(processor, batches):
    """Feed batches of (watermark, events) to a processor as Spark does; what it gives out, batch by batch."""
    store, out = Store(), []
    processor.init(store)
    for mark, rows in batches:
        if rows:
            part = pd.DataFrame(rows, columns=["at_us", "tie", "act", "job", "nameless"])
            list(processor.handleInputRows((0,), iter([part]), Clock(mark)))
        got = []
        for timer in [t for t in store.timers if t <= mark]:
            got += [r for part in processor.handleExpiredTimer((0,), Clock(mark), None) for r in part.itertuples(index=False)]
            store.timers.remove(timer)
        out.append(got)
    return store, out


@pytest.mark.parametrize("processor", [S.JobState, S.IdleJobs])
def test_calls_to_the_state_store_are_by_bucket_not_by_job_and_event(processor):
    """500 jobs of 4 events each: waiting takes a few calls altogether, and what is applied one write per job."""
    rows = [(k * 1_000_000 + job, k, 1 + (k + job) % 4, job, False) for job in range(500) for k in range(4)]
    store, _ = replay(processor(), [(0, rows)])
    assert store.calls < 10
    store, out = replay(processor(), [(0, rows), (10_000_000, [])])
    assert len(out[1]) == 500 and store.calls < 500 + 20


def test_idle_jobs_of_a_bucket_are_told_apart():
    """Job 1 goes on in time, job 2 falls silent, job 3 comes back after its decision, and an event waits for job 4."""
    s = 1_000_000
    act = {a: k + 1 for k, a in enumerate(S.ACTIONS)}
    batches = [
        (0, [(1 * s, 1, act["enqueue"], 1, False), (1 * s, 2, act["enqueue"], 2, False), (1 * s, 3, act["enqueue"], 3, False), (1 * s, 4, act["enqueue"], 4, False)]),
        (20_000, [(25 * s, 5, act["start"], 1, False), (60 * s, 6, act["start"], 4, False), (1 * s, 7, 0, 0, True)]),
        (40_000, []),
        (50_000, [(55 * s, 8, act["start"], 3, False)]),
        (80_000, []),
        (200_000, []),
    ]
    _, out = replay(S.IdleJobs(), batches)
    got = [sorted((None if pd.isna(r.job_id) else r.job_id, r.decision) for r in part if not pd.isna(r.job_id)) for part in out]
    assert got == [[], [], [(2, "reprocess"), (3, "reprocess")], [], [(1, "stuck")], [(3, "stuck"), (4, "stuck")]]
    assert [r.decision for part in out for r in part if pd.isna(r.job_id)] == ["stuck"]
