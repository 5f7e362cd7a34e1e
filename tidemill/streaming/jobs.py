"""Streaming analytics on job events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators.jobs import IDLE_SECONDS, MAX_ATTEMPTS, MOVES, TERMINAL, action_of, chained, follow, outcome_of
from tidemill.plans.session import work_dir
from tidemill.streaming.runner import newest_per_key


def deduplicate(events: DataFrame, key: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries; keys are remembered only as long as the watermark needs them."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def sliding_rate(
    events: DataFrame, by: list[str], ts: str = "ts", delay: str = "10 minutes", length: str = "5 minutes", slide: str = "1 minute"
) -> DataFrame:
    """Events per second in sliding windows."""
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, length, slide), *by)
        .agg(F.count(F.lit(1)).alias("events"))
        .select("window.start", "window.end", *by, "events", (F.col("events") / seconds).alias("rate"))
    )


def tumbling_counts(events: DataFrame, by: list[str], ts: str = "ts", delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, length), *by)
        .agg(F.count(F.lit(1)).alias("events"))
        .select("window.start", *by, "events")
    )


def sessions(events: DataFrame, key: str, ts: str = "ts", delay: str = "10 minutes", gap: str = "24 hours") -> DataFrame:
    """Activity of a key without a break longer than ``gap``."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
    )


JOB_STATE = "status string, attempts bigint, rejected bigint, events bigint, last_us bigint"
JOB_KEY = "job bigint, nameless boolean"
STATE_ROW = "job_id long, events long, status string, attempts long, rejected long, last_us long"
DECISION_ROW = "job_id long, status string, attempts long, decision string, last_us long"
# Jobs share a state key, so that a batch takes calls to the state store and data frames by bucket and not by job.
BUCKETS = 2048
ACTIONS = sorted({act for _, act in MOVES})
WAITING = np.dtype([("at_us", "i8"), ("tie", "i8"), ("act", "i1"), ("job", "i8"), ("nameless", "?")])
Job = tuple[int, bool]  # a job's number; jobs without one are told apart from number 0
State = tuple[str, int, int, int, int]


class JobState(StatefulProcessor):
    """Keeps status and attempts of the jobs of a bucket; emits a job's state whenever events have been applied.

    Events wait in a list until the watermark has passed them and are then applied in the order of their
    times, so it doesn't matter which batches they came in. What waits in one bucket is bounded by the events its jobs have
    within the watermark's delay. A bucket has one timer, for when the watermark has passed what it waits for.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", JOB_KEY, JOB_STATE)
        self.pending = handle.getListState("pending", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [_packed(part) for part in rows]
        self.pending.appendList([(part.tobytes(),) for part in parts])
        wanted = max(min(int(part["at_us"].min()) for part in parts) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > wanted:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        changed, rest = self._apply(mark)
        if len(rest):
            self.handle.registerTimer(int(rest["at_us"].min()) // 1000 + 1)
        if changed:
            yield _table(changed, ["status", "attempts", "rejected", "events", "last_us"], list(changed.values()))

    def _apply(self, mark_ms: int) -> tuple[dict[Job, State], np.ndarray]:
        """Fold the waiting events up to the watermark into the states; the changed states and the events that go on waiting."""
        waiting = np.concatenate([np.empty(0, WAITING), *(np.frombuffer(row[0], WAITING) for row in self.pending.get())])
        ready = waiting["at_us"] <= mark_ms * 1000
        rest, now = waiting[~ready], waiting[ready]
        if not len(now):
            return {}, rest
        now = now[np.lexsort([now["act"], now["tie"], now["at_us"], now["nameless"], now["job"]])]
        known, changed = self.jobs.exists(), {}
        for at_us, _, act, number, nameless in now.tolist():
            job = (number, nameless)
            if job not in changed:
                changed[job] = (self.jobs.getValue(job) if known else None) or ("none", 0, 0, 0, 0)
            status, attempts, rejected, events, last = changed[job]
            target = MOVES.get((status, ACTIONS[act - 1])) if act else None
            changed[job] = (target or status, attempts + (target == "processing"), rejected + (target is None), events + 1, max(last, at_us))
        for job, state in changed.items():
            self.jobs.updateValue(job, state)
        if len(rest):
            self.pending.put([(rest.tobytes(),)])
        else:
            self.pending.clear()
        return changed, rest

    def close(self) -> None:
        pass


class IdleJobs(JobState):
    """Decides what to do with a job once it has been silent for the idle time.

    Jobs that have not been decided since their last event are kept with their deadlines; these are looked through
    only when the watermark has passed the earliest of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", JOB_KEY, "deadline_ms bigint")
        self.due = handle.getValueState("due", "deadline_ms bigint")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        changed, rest = self._apply(mark)
        awaited = set(rest[["job", "nameless"]].tolist())
        before = self.due.get()[0] if self.due.exists() else None  # without it no job is open
        due, silent = [] if before is None else [before], {}
        for job, state in changed.items():
            deadline = state[4] // 1000 + IDLE_SECONDS * 1000
            if deadline < mark and job not in awaited:
                silent[job] = state
                if before is not None:
                    self.open.removeKey(job)
            else:
                self.open.updateValue(job, (deadline,))
                due.append(deadline)
        if due and min(due) < mark:
            due = []
            for job, (deadline,) in [(tuple(k), tuple(v)) for k, v in self.open.iterator()]:
                if deadline < mark and job not in awaited:
                    silent[job] = tuple(self.jobs.getValue(job))
                    self.open.removeKey(job)
                else:  # one whose next event is waiting is looked at after that
                    due.append(deadline if deadline >= mark else int(rest["at_us"].min()) // 1000)
        if due:
            self.due.update((min(due),))
        elif before is not None:
            self.due.clear()
        wake = [min(due) + 1] if due else []
        wake += [int(rest["at_us"].min()) // 1000 + 1] if len(rest) else []
        if wake:
            self.handle.registerTimer(min(wake))
        if silent:
            rows = [(status, attempts, decide(status, attempts), last) for status, attempts, _, _, last in silent.values()]
            yield _table(silent, ["status", "attempts", "decision", "last_us"], rows)


def _packed(part: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(part), WAITING)
    for c in WAITING.names:
        out[c] = part[c].to_numpy()
    return out


def _table(jobs: dict[Job, State], columns: list[str], rows: list[tuple]) -> pd.DataFrame:
    numbers = pd.Series([None if nameless else number for number, nameless in jobs], dtype="Int64")
    return pd.DataFrame(rows, columns=columns).assign(job_id=numbers)


def decide(status: str, attempts: int) -> str:
    """What becomes of a job that has been silent for the idle time."""
    if status in TERMINAL:
        return "acknowledge"
    if attempts >= MAX_ATTEMPTS:
        return "fail"
    return "reprocess" if status == "queued" else "stuck"


class SilentJobs(StatefulProcessor):
    """Decides what to do with a job that hasn't sent anything for the idle time by the clock on the wall.

    No later event of any job is needed: a timer of the state store wakes the job. Events are applied as they come, those
    of a batch in the order of their times. A decided job is forgotten, and a finished one that is never decided goes when
    its state's time to live is over.
    """

    def __init__(self, idle_seconds: float):
        self.idle_ms = int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", JOB_STATE, ttlDurationMs=max(10 * self.idle_ms, 60_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, rejected, events, last = self.state.get() if self.state.exists() else ("none", 0, 0, 0, 0)
        for part in rows:
            for at_us, _, act in sorted(part[["at_us", "tie", "action"]].itertuples(index=False, name=None)):
                target = MOVES.get((status, act))
                rejected += target is None
                attempts += target == "processing"
                status, events, last = target or status, events + 1, max(last, at_us)
        self.state.update((status, int(attempts), int(rejected), int(events), int(last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, attempts, _, _, last = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "decision": [decide(status, attempts)], "last_us": [last]})

    def close(self) -> None:
        pass


def _job_events(events: DataFrame, job: str, action: str, ts: str, tiebreak: str) -> DataFrame:
    return events.select(
        F.col(job).alias("job_id"),
        F.col(action).alias("action"),
        F.unix_micros(F.col(ts)).alias("at_us"),
        F.col(tiebreak).alias("tie"),
        F.col(ts).alias("ts"),
    )


def _bucketed_events(events: DataFrame, job: str, action: str, ts: str, tiebreak: str) -> DataFrame:
    """Job events by bucket of jobs, without nulls. An event without a time has no place in a job's life."""
    act = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col(action))  # 0 for one that no move knows
    return events.where(F.col(ts).isNotNull()).select(
        F.pmod(F.xxhash64(F.col(job)), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.coalesce(F.col(job), F.lit(0)).cast("long").alias("job"),
        F.col(job).isNull().alias("nameless"),
        F.coalesce(act, F.lit(0)).cast("int").alias("act"),
        F.unix_micros(F.col(ts)).alias("at_us"),
        F.coalesce(F.col(tiebreak).cast("long"), F.lit(-(1 << 63))).alias("tie"),
        F.col(ts).alias("ts"),
    )


def job_states(events: DataFrame, job: str, action: str, ts: str, tiebreak: str, delay: str = "10 minutes") -> DataFrame:
    """Stateful fold of job events in the order of their times (update mode, state provider ``ROCKSDB``)."""
    return (
        _bucketed_events(events, job, action, ts, tiebreak)
        .withWatermark("ts", delay)
        .groupBy("bucket")
        .transformWithStateInPandas(JobState(), STATE_ROW, "Update", "EventTime")
    )


def idle_decisions(events: DataFrame, job: str, action: str, ts: str, tiebreak: str, delay: str = "10 minutes") -> DataFrame:
    """Decisions for jobs that fell silent, by event time (append mode, state provider ``ROCKSDB``)."""
    return (
        _bucketed_events(events, job, action, ts, tiebreak)
        .withWatermark("ts", delay)
        .groupBy("bucket")
        .transformWithStateInPandas(IdleJobs(), DECISION_ROW, "Append", "EventTime")
    )


def silent_decisions(events: DataFrame, job: str, action: str, ts: str, tiebreak: str, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Decisions for jobs that fell silent, by the clock (append mode, state provider ``ROCKSDB``).

    For live streams: run it with a processing-time trigger, which also wakes jobs when nothing arrives.
    """
    rows = _job_events(events, job, action, ts, tiebreak).drop("ts")
    return rows.groupBy("job_id").transformWithStateInPandas(SilentJobs(idle_seconds), DECISION_ROW, "Append", "ProcessingTime")


SLICE_ROW = "job_id long, slice timestamp, events long, at_us long, outcome array<struct<state:string,attempts:long,rejected:long>>"


# Jobs whose events wait together in a slice of time: state rows are counted by slices and buckets and not by jobs.
SLICE_BUCKETS = 512


def job_slices(events: DataFrame, job: str, action: str, ts: str, tiebreak: str, delay: str = "10 minutes", length: str = "1 second") -> DataFrame:
    """What the events of a short slice of time do to a job, whatever its state: one row per job and slice (append mode).

    The state is kept by slice and bucket of jobs, so a job with very many events spreads over all tasks, and none of them
    holds more than a slice's events. A slice is given out once, when the watermark has passed it.
    """
    step = action_of(F.col(action))
    bucket = F.pmod(F.xxhash64(F.col(job)), F.lit(SLICE_BUCKETS)).cast("int").alias("bucket")
    rows = events.select(bucket, F.col(job).alias("job_id"), step.alias("act"), F.unix_micros(F.col(ts)).alias("at"), F.col(tiebreak).alias("tie"), F.col(ts).alias("ts"))
    waiting = rows.withWatermark("ts", delay).groupBy(F.window("ts", length), "bucket").agg(F.collect_list(F.struct("job_id", "at", "tie", "act")).alias("run"))
    runs = waiting.select(F.col("window.start").alias("slice"), F.explode(_by_job(F.array_sort("run"))).alias("run"))
    return runs.select(
        F.col("run")[0]["job_id"].alias("job_id"),
        "slice",
        F.size("run").cast("long").alias("events"),
        F.element_at("run", -1)["at"].alias("at_us"),
        outcome_of(F.transform("run", lambda e: e["act"])).alias("outcome"),
    )


def _by_job(ordered: Column) -> Column:
    """An array of events in the order of their jobs, cut where another job begins."""

    def cut(run: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(1), F.size(run)),
            lambda i: (i == 1) | ~F.get(run, i - 1)["job_id"].eqNullSafe(F.get(run, F.greatest(i - 2, F.lit(0)))["job_id"]),
        )
        return F.transform(F.array(first), lambda at: F.transform(at, lambda i, k: F.slice(run, i, F.coalesce(F.get(at, k + 1), F.size(run) + 1) - i)))[0]

    # a lambda's argument is evaluated once
    return F.transform(F.array(ordered), cut)[0]


def chain_into(path: str, span: str = "hour"):
    """A batch writer for ``foreachBatch``: chains a batch's slices onto the jobs' states and writes the changed ones.

    Slices are chained per job and span (an hour or more, many slices long), then per job. The states before are read from the folders of earlier
    batches only, so a batch that is repeated writes the same folder again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.where("job_id IS NOT NULL")
        spans = batch.groupBy("job_id", F.date_trunc(span, "slice").alias("span")).agg(
            F.sum("events").alias("events"), F.max("at_us").alias("last_us"), chained(F.array_sort(F.collect_list(F.struct("slice", "outcome")))).alias("outcome")
        )
        maps = spans.groupBy("job_id").agg(
            F.sum("events").alias("more"), F.max("last_us").alias("newer"), chained(F.array_sort(F.collect_list(F.struct("span", "outcome")))).alias("outcome")
        )
        before = states_before(spark, path, batch_id)
        known = maps.join(before, "job_id", "left") if before is not None else maps.withColumns(
            {"status": F.lit("none"), **{c: F.lit(0).cast("long") for c in ("attempts", "rejected", "events", "last_us")}}
        )
        start = F.struct(
            F.coalesce("status", F.lit("none")).alias("state"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected")
        )
        after = follow(start, F.col("outcome"))
        out = known.withColumn("after", after).select(
            "job_id", (F.coalesce("events", F.lit(0)) + F.col("more")).cast("long").alias("events"), F.col("after.state").alias("status"), F.col("after.attempts").alias("attempts"),
            F.col("after.rejected").alias("rejected"), F.greatest("newer", F.coalesce("last_us", F.col("newer"))).alias("last_us"),
        )
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def states_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The newest state of each job in the batches before ``batch_id``."""
    try:
        written = spark.read.schema(STATE_ROW + ", batch long").option("basePath", path).parquet(path)
    except AnalysisException:  # nothing has been written yet
        return None
    return newest_per_key(written.where(F.col("batch") < batch_id), ["job_id"])


def run_sliced_states(slices: DataFrame, label: str, closing=None, span: str = "hour") -> DataFrame:
    """Run ``job_slices`` over what is available now; the newest state of every job. ``span`` is that of ``chain_into``."""
    spark = slices.sparkSession
    out, checkpoint = work_dir(spark, f"{label}-out"), work_dir(spark, f"{label}-state")

    def once() -> None:
        slices.writeStream.foreachBatch(chain_into(out, span)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    once()
    if closing is not None:
        closing.close()
        once()
    return states_before(spark, out, 1 << 62)
