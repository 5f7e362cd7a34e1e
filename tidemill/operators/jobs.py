"""Analytics over job tables and job metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.quantiles import exact_quantiles
from tidemill.plans.joins import join_null_safe
from tidemill.plans.session import cut_lineage
from tidemill.plans.skew import ordered_pieces

# Job types that are always reported, states that count as outstanding,
# error categories, histogram bounds in seconds, and limits.
JOB_TYPES = ["dataset", "image", "route"]
OUTSTANDING = ["queued", "processing"]
TERMINAL = ["completed", "failed"]
ERROR_CATEGORIES = [
    "timeout",
    "cancelled",
    "processor",
    "validation",
    "storage",
    "filesystem",
    "database",
    "configuration",
    "retry_limit",
]
DURATION_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
MAX_OUTSTANDING = 100
MAX_ATTEMPTS = 3
IDLE_SECONDS = 30
KEEP_PER_OWNER = 10


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def owner_jobs(jobs: DataFrame, *, user_id: int | None = None, session_id: int | None = None, statuses=None) -> DataFrame:
    """The jobs of one owner, newest first."""
    if (user_id is None) == (session_id is None):
        raise ValueError("exactly one owner is required")
    mine = F.col("user_id") == user_id if user_id is not None else F.col("session_id") == session_id
    found = jobs.where(mine)
    if statuses:
        found = found.where(F.col("status").isin(list(statuses)))
    return found.orderBy(F.desc("created_at"), F.desc("id"))


def queue_depth(jobs: DataFrame, types: list[str] = JOB_TYPES) -> DataFrame:
    """Queued jobs per type; the known types are listed even when nothing waits."""
    counts = jobs.where("status = 'queued'").groupBy("type").agg(F.count(F.lit(1)).alias("depth"))
    zeros = jobs.sparkSession.createDataFrame([(t, 0) for t in types], "type string, depth bigint")
    return counts.unionByName(zeros).groupBy("type").agg(F.max("depth").alias("depth"))


def outstanding(jobs: DataFrame, limit: int = MAX_OUTSTANDING) -> DataFrame:
    n = F.count_if(F.col("status").isin(OUTSTANDING))
    return jobs.agg(n.alias("outstanding")).select(
        "outstanding", F.lit(limit).cast("long").alias("job_limit"), (F.col("outstanding") >= limit).alias("rejects_new")
    )


def latency_stats(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Average and lower-rank 95th percentile of queue, processing and total time in seconds."""
    # written down once: jobs may come from a join that every pass over them would repeat
    timed = cut_lineage(
        jobs.where("completed_at is not null").select(
            *keys,
            seconds_between(F.col("created_at"), F.col("started_at")).alias("queue"),
            seconds_between(F.col("started_at"), F.col("completed_at")).alias("processing"),
            seconds_between(F.col("created_at"), F.col("completed_at")).alias("total"),
        )
    )
    cells = timed.unpivot(keys, ["queue", "processing", "total"], "phase", "seconds").where("seconds is not null")
    by = keys + ["phase"]
    stats = cut_lineage(
        cells.groupBy(*by).agg(
            F.count(F.lit(1)).alias("jobs"), F.avg("seconds").alias("avg_seconds"), F.min("seconds").alias("lo"), F.max("seconds").alias("hi")
        )
    )
    sizes = stats.select(*by, F.col("jobs").alias("n"), "lo", "hi")
    p95 = exact_quantiles(cells, by, "seconds", {"p95_seconds": 0.95}, "lower", sizes)
    return join_null_safe(stats.drop("lo", "hi"), p95, by)


def lower_rank_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    return exact_quantiles(df, keys, value, {"percentile": p}, "lower")


def throughput(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Finished jobs per second between the first submission and the last completion."""
    done = jobs.where("completed_at is not null")
    span = seconds_between(F.min("created_at"), F.max("completed_at"))
    return done.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jobs"), F.try_divide(F.count(F.lit(1)).cast("double"), span).alias("jobs_per_second")
    )


def error_category(c: Column) -> Column:
    return F.when(c.isin(ERROR_CATEGORIES), c).otherwise(F.lit("unknown"))


def error_breakdown(failures: DataFrame) -> DataFrame:
    """Failures by job type and error category; categories nobody declared count as unknown."""
    return failures.groupBy("type", error_category(F.col("error_type")).alias("error_type")).agg(
        F.count(F.lit(1)).alias("failures")
    )


def bound_label(bound: float) -> str:
    return f"{bound:g}"


def duration_buckets(df: DataFrame, keys: list[str], seconds: str, bounds: list[float] = DURATION_BOUNDS) -> DataFrame:
    """Cumulative histogram: how many durations are at most each bound."""
    wide = df.groupBy(*keys).agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)], F.count(seconds).alias("_inf")
    )
    rows = [
        F.struct(F.lit(bound_label(b)).alias("le"), F.lit(float(b)).alias("bound"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ]
    rows.append(
        F.struct(F.lit("+Inf").alias("le"), F.lit(None).cast("double").alias("bound"), F.col("_inf").alias("cumulative"))
    )
    return wide.select(*keys, F.inline(F.array(*rows)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile estimated inside the first bucket that reaches it.

    The first bucket starts at 0; ranks in the unbounded bucket give the top finite bound.
    A series has one row per bound, so its window is small.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("bound").asc_nulls_last())
    whole = Window.partitionBy(*keys)
    ranked = (
        buckets.withColumn("below", F.coalesce(F.lag("cumulative").over(order), F.lit(0)))
        .withColumn("start", F.coalesce(F.lag("bound").over(order), F.lit(0.0)))
        .withColumn("rank", F.lit(q) * F.max("cumulative").over(whole))
        .withColumn("top", F.max("bound").over(whole))
    )
    hit = ranked.where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("cumulative")))
    inside = F.col("start") + (F.col("bound") - F.col("start")) * (F.col("rank") - F.col("below")) / (
        F.col("cumulative") - F.col("below")
    )
    return hit.select(*keys, F.when(F.col("bound").isNull(), F.col("top")).otherwise(inside).alias("quantile"))


def expired_jobs(jobs: DataFrame, keep: int = KEEP_PER_OWNER) -> DataFrame:
    """Jobs beyond the newest ``keep`` of their owner.

    Only ``keep`` rows per owner and task are shuffled to find each owner's oldest kept job;
    the older ones are then an ordinary join, so an owner with very many jobs is never sorted
    in one place.
    """
    owner = ["user_id", "session_id"]
    newest = Window.partitionBy(*owner).orderBy(F.desc("created_at"), F.desc("id"))
    edge = (
        jobs.select(*owner, "created_at", "id")
        .withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= keep)
        .where(F.col("rn") == keep)
        .select(
            F.col("user_id").alias("edge_user"),
            F.col("session_id").alias("edge_session"),
            F.col("created_at").alias("edge_created"),
            F.col("id").alias("edge_id"),
        )
    )
    same = F.col("user_id").eqNullSafe(F.col("edge_user")) & F.col("session_id").eqNullSafe(F.col("edge_session"))
    older = F.struct("created_at", "id") < F.struct(F.col("edge_created").alias("created_at"), F.col("edge_id").alias("id"))
    return jobs.join(edge, same).where(older).select(*jobs.columns)


def gain(now: Column, before: Column) -> Column:
    """What a counter has grown by; a drop counts as a restart from zero."""
    return F.when(before.isNull(), F.lit(0.0)).when(now < before, now).otherwise(now - before)


def counted_slices(samples: DataFrame, keys: list[str], window: Column, ts: str, value: str, tiebreak: str, slice_seconds: int) -> DataFrame:
    """Short slices of each series: (keys, _win, _slice, piece, _n, _gain, _first, _last).

    Neighbouring samples are compared inside a slice; no task sorts a whole series, and a slice that is still
    too large is cut into pieces. ``window`` numbers the windows that slices don't cross, by microseconds ``_at``.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    base = samples.select(*keys, at.alias("_at"), F.col(tiebreak).alias("_tie"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    base = base.select(*keys, window.alias("_win"), F.floor(F.col("_at") / F.lit(slice_seconds * 1_000_000)).alias("_slice"), "_at", "_tie", "_v")
    base = ordered_pieces(base, [*keys, "_win", "_slice"], ["_at", "_tie"])
    in_slice = Window.partitionBy(*keys, "_win", "_slice", "piece").orderBy("_at", "_tie")
    order = F.struct("_at", "_tie")
    return (
        base.withColumn("_gain", gain(F.col("_v"), F.lag("_v").over(in_slice)))
        .groupBy(*keys, "_win", "_slice", "piece")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_gain").alias("_gain"),
            F.min_by("_v", order).alias("_first"),
            F.max_by("_v", order).alias("_last"),
        )
    )


def counter_rate(
    samples: DataFrame, keys: list[str], ts: str, value: str, tiebreak: str, window_seconds: int = 300, slice_seconds: int = 1
) -> DataFrame:
    """Per-second rate of a counter in fixed windows, a drop counting as a restart from zero.

    The slices of a window are chained through their first and last samples.
    """
    window = F.floor(F.col("_at") / F.lit(window_seconds * 1_000_000))
    slices = counted_slices(samples, keys, window, ts, value, tiebreak, slice_seconds)
    chain = Window.partitionBy(*keys, "_win").orderBy("_slice", "piece")
    return (
        slices.withColumn("_gain", F.col("_gain") + gain(F.col("_first"), F.lag("_last").over(chain)))
        .groupBy(*keys, "_win")
        .agg(F.sum("_n").alias("samples"), F.sum("_gain").alias("increase"))
        .where("samples >= 2")
        .select(
            *keys,
            F.timestamp_micros(F.col("_win") * window_seconds * 1_000_000).cast("timestamp_ntz").alias("window_start"),
            "samples",
            "increase",
            (F.col("increase") / window_seconds).alias("rate"),
        )
    )


def range_rates(
    samples: DataFrame, keys: list[str], ts: str, value: str, tiebreak: str, range_seconds: int = 300, step_seconds: int = 60, slice_seconds: int = 1
) -> DataFrame:
    """Per-second rate of a counter over the last ``range_seconds`` at every step: (keys, step_end, samples, increase, rate).

    The range ends with the step and leaves its beginning out; at least two samples have to lie in it. Nothing
    is extrapolated to its edges. Ranges overlap, so samples are first reduced to buckets that ranges are made
    of; each bucket goes to the steps it counts for, where a handful of buckets are chained in order of time.
    A series of very many samples is cut into slices as in ``counter_rate``.
    """
    width = math.gcd(range_seconds, step_seconds)
    window = F.ceil(F.col("_at") / F.lit(width * 1_000_000))
    slices = counted_slices(samples, keys, window, ts, value, tiebreak, slice_seconds)
    chain = Window.partitionBy(*keys, "_win").orderBy("_slice", "piece")
    order = F.struct("_slice", "piece")
    buckets = (
        slices.withColumn("_gain", F.col("_gain") + gain(F.col("_first"), F.lag("_last").over(chain)))
        .groupBy(*keys, "_win")
        .agg(F.sum("_n").alias("n"), F.sum("_gain").alias("gain"), F.min_by("_first", order).alias("first"), F.max_by("_last", order).alias("last"))
    )
    in_range, in_step = range_seconds // width, step_seconds // width
    # steps whose range holds the bucket
    low = F.ceil(F.col("_win") / in_step)
    high = F.floor((F.col("_win") + in_range - 1) / in_step)
    steps = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    placed = buckets.select(*keys, F.explode(steps).alias("_step"), F.struct("_win", "n", "gain", "first", "last").alias("b"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("gain"), F.lit(None).cast("double").alias("last"))

    def add(a: Column, b: Column) -> Column:
        return F.struct((a["n"] + b["n"]).alias("n"), (a["gain"] + b["gain"] + gain(b["first"], a["last"])).alias("gain"), b["last"].alias("last"))

    ranges = placed.groupBy(*keys, "_step").agg(F.aggregate(F.sort_array(F.collect_list("b")), start, add).alias("r")).where("r.n >= 2")
    at = F.timestamp_micros(F.col("_step") * step_seconds * 1_000_000).cast("timestamp_ntz")
    return ranges.select(*keys, at.alias("step_end"), F.col("r.n").alias("samples"), F.col("r.gain").alias("increase"), (F.col("r.gain") / range_seconds).alias("rate"))


def quantile_steps(
    samples: DataFrame, by: list[str], series: list[str], q: float, ts: str, value: str, tiebreak: str, range_seconds: int = 300, step_seconds: int = 60
) -> DataFrame:
    """Quantile of observations at every step, from the counters of a cumulative histogram: (by, step_end, quantile).

    Each series (``by``, ``series`` and ``bound``, null for no bound) has a counter; their rates are added up over ``series``
    and interpolated inside the first bucket that reaches the rank. Steps without any observation are left out.
    """
    rates = range_rates(samples, [*by, *series, "bound"], ts, value, tiebreak, range_seconds, step_seconds)
    added = rates.groupBy(*by, "bound", "step_end").agg(F.sum("rate").alias("cumulative"))
    return histogram_quantile(added, [*by, "step_end"], q)


def latest_gauge(samples: DataFrame, series: list[str], by: list[str], value: str, order: list[str]) -> DataFrame:
    """Sum of the newest value of every series, grouped by some of its labels."""
    newest = samples.groupBy(*series).agg(F.max_by(F.col(value), F.struct(*order)).alias("value"))
    return newest.groupBy(*by).agg(F.count(F.lit(1)).alias("series"), F.sum("value").alias("value"))


def recovery_decisions(
    jobs: DataFrame, now: Column, last_seen: str, idle_seconds: int = IDLE_SECONDS, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """What to do about each job nobody has acknowledged yet.

    A job that stays in ``processing`` cannot be claimed again, so it is reported as stuck
    instead of being sent for another attempt.
    """
    idle = seconds_between(F.col(last_seen), now)
    decision = (
        F.when(idle < idle_seconds, F.lit("wait"))
        .when(F.col("status").isin(TERMINAL), F.lit("acknowledge"))
        .when(F.col("attempts") >= max_attempts, F.lit("fail"))
        .when(F.col("status") == "queued", F.lit("reprocess"))
        .otherwise(F.lit("stuck"))
    )
    return jobs.withColumn("idle_seconds", idle).withColumn("decision", decision)


# Job states and the moves allowed between them.
STATES = ["none", "queued", "processing", "completed", "failed"]
MOVES = {
    ("none", "enqueue"): "queued",
    ("queued", "start"): "processing",
    ("processing", "complete"): "completed",
    ("queued", "fail"): "failed",
    ("processing", "fail"): "failed",
}


def action_of(c: Column) -> Column:
    """The action, or ``other`` for one that no move knows."""
    return F.coalesce(*[F.when(c == act, F.lit(act)) for act in sorted({a for _, a in MOVES})], F.lit("other"))


def _cell(state: str) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(0).cast("long").alias("attempts"), F.lit(0).cast("long").alias("rejected"))


# a state's position, attempts and rejected moves in one number, while the actions of a run are gone through
ATTEMPT, REJECTION = 8, 1 << 33


def outcome_of(actions: Column) -> Column:
    """What a run of actions makes of every possible state: one (state, attempts, rejected) per entry of ``STATES``.

    A run is one row's array, so it has far fewer than 2 ** 30 actions.
    """
    names = sorted({a for _, a in MOVES})
    changes = []
    for act in [None, *names]:  # position 0: an action that no move knows
        for k in range(ATTEMPT):
            to = MOVES.get((STATES[k], act)) if k < len(STATES) else None
            changes.append(REJECTION if to is None else STATES.index(to) - k + ATTEMPT * (to == "processing"))
    table = F.array(*[F.lit(c).cast("long") for c in changes])
    position = F.array(*map(F.lit, names))
    numbers = F.transform(actions, lambda a: F.coalesce(F.array_position(position, a), F.lit(0)) * ATTEMPT)
    start = F.array(*[F.lit(k).cast("long") for k in range(len(STATES))])
    ends = F.aggregate(
        numbers, start, lambda acc, a: F.transform(acc, lambda c: c + F.get(table, (a + c.bitwiseAND(F.lit(ATTEMPT - 1))).cast("int")))
    )
    state = F.array(*map(F.lit, STATES))
    return F.transform(
        ends,
        lambda c: F.struct(
            F.get(state, c.bitwiseAND(F.lit(ATTEMPT - 1)).cast("int")).alias("state"),
            F.shiftright(c.bitwiseAND(F.lit(REJECTION - 1)), 3).alias("attempts"),
            F.shiftright(c, 33).alias("rejected"),
        ),
    )


def follow(cell: Column, outcome: Column) -> Column:
    """A state after what ``outcome`` does to it."""
    position = F.array(*[F.lit(s) for s in STATES])
    found = F.array(F.element_at(outcome, F.array_position(position, cell["state"]).cast("int")))

    def add(hit: Column) -> Column:
        return F.struct(
            hit["state"].alias("state"),
            (cell["attempts"] + hit["attempts"]).alias("attempts"),
            (cell["rejected"] + hit["rejected"]).alias("rejected"),
        )

    # a lambda's argument is looked up once
    return F.transform(found, add)[0]


def chained(steps: Column) -> Column:
    """The outcome of consecutive steps, each with an ``outcome`` of its own."""
    return F.aggregate(steps, F.array(*map(_cell, STATES)), lambda acc, m: F.transform(acc, lambda c: follow(c, m["outcome"])))


def fold_job_states(events: DataFrame, job: str, action: str, ts: str, tiebreak: str) -> DataFrame:
    """Final state, attempts and rejected moves per job from its ordered events.

    A run of events maps every possible state to an outcome, and such maps can be chained.
    Events are therefore reduced per (job, minute), then per (job, day), so the job's own
    group only sees one short map per day. A minute with too many events is cut into pieces.
    """
    timed = events.select(
        F.col(job).alias("job_id"),
        action_of(F.col(action)).alias("act"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(tiebreak).alias("tie"),
        F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(60_000_000)).alias("minute"),
    )
    run = F.transform(F.array_sort(F.collect_list(F.struct("at", "tie", "act"))), lambda e: e["act"])
    minutes = (
        ordered_pieces(timed, ["job_id", "minute"], ["at", "tie"])
        .groupBy("job_id", "minute", "piece")
        .agg(run.alias("run"), F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
        .select(
            "job_id",
            "minute",
            "piece",
            F.floor(F.col("minute") / F.lit(1440)).alias("day"),
            "n",
            "at",
            outcome_of(F.col("run")).alias("outcome"),
        )
    )
    in_order = F.array_sort(F.collect_list(F.struct("minute", "piece", "outcome")))
    days = minutes.groupBy("job_id", "day").agg(
        F.sum("n").alias("n"),
        F.max("at").alias("at"),
        chained(in_order).alias("outcome"),
    )
    by_day = F.array_sort(F.collect_list(F.struct("day", "outcome")))
    folded = days.groupBy("job_id").agg(
        F.sum("n").alias("events"),
        F.max("at").alias("at"),
        F.aggregate(by_day, _cell("none"), lambda acc, m: follow(acc, m["outcome"])).alias("final"),
    )
    return folded.select(
        "job_id",
        "events",
        F.col("final.state").alias("status"),
        F.col("final.attempts").alias("attempts"),
        F.col("final.rejected").alias("rejected"),
        F.timestamp_micros("at").cast("timestamp_ntz").alias("last_seen"),
    )


def artifact_key(job_id: Column, path: Column) -> Column:
    """Storage key of a result file: ``jobs/<id>/<file name>``."""
    return F.concat(F.lit("jobs/"), job_id.cast("string"), F.lit("/"), F.regexp_extract(path, r"([^/\\]*)$", 1))
