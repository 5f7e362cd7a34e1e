"""Exact order statistics per group, without one task ever holding a large group.

Groups are first counted in equal-width buckets; only the buckets that hold a wanted rank are shuffled and
sorted. Where such a bucket has more rows of different values than the configured limit, its group is solved by
selection: a mergeable sketch proposes
two pivots for every wanted rank, an exact count says on which side of the pivots the rank
lies, and only the rows between the pivots stay. Pivots affect speed only, never the answer,
because every step is decided by exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.plans.joins import join_null_safe
from tidemill.plans.session import cut_lineage, group_rows, hint_small

SKETCH_K = 4096
GRID = 512
# groups up to this length are sorted directly; longer ones in buckets of about this many rows, up to a number of buckets
SORTED_ROWS = 200_000
BUCKET_ROWS = 1_000
MOST_BUCKETS = 4_096


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    method: str = "linear",
    sizes: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per group: ``keys`` plus one double column per entry of ``probs``.

    ``linear`` interpolates between the two neighbouring ranks, ``lower`` takes the element
    at rank ``floor((n - 1) * p)`` of the sorted values. Nulls are left out; groups with
    nothing but nulls do not appear. ``sizes`` takes (keys..., n, lo, hi) per group with values, if the
    caller has counted them already. ``counts`` takes (keys..., ``value``, n): the same rows counted by value, which are
    then read in place of the rows, except for groups that have to be narrowed by sketches.
    """
    if method not in ("linear", "lower"):
        raise ValueError(f"unknown quantile method {method!r}")
    limit = group_rows(df.sparkSession)
    names, keys = keys, [f"_key{i}" for i in range(len(keys))] or ["_all"]
    source = [F.col(name) for name in names] or [F.lit(0)]
    named = [c.alias(key) for c, key in zip(source, keys)]
    data = df.select(*named, F.col(value).cast("double").alias("v")).where("v is not null")
    if counts is not None:
        counts = counts.select(*named, F.col(value).cast("double").alias("v"), F.col("n").alias("w")).where("v is not null")
    if sizes is not None:
        sizes = sizes.select(*named, "n", F.col("lo").cast("double"), F.col("hi").cast("double"))
    solved = _solve(data, keys, probs, method, limit, sizes, counts)
    return solved.select(*[F.col(key).alias(name) for name, key in zip(names, keys)], *probs)


def approximate_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """As ``exact_quantiles`` with ``lower``, in one pass and within a rank error of rows / ``accuracy``."""
    found = F.percentile_approx(F.col(value).cast("double"), list(probs.values()), accuracy)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(found.alias("_q"))
        .select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    )


def _solve(
    data: DataFrame, keys: list[str], probs: dict[str, float], method: str, limit: int, sizes: DataFrame | None, counts: DataFrame | None
) -> DataFrame:
    # what is read: rows, or values with their numbers of rows
    cells, more, number = (data, [], F.count(F.lit(1))) if counts is None else (counts, ["w"], F.sum("w"))
    if sizes is None:
        counted = cells.groupBy(*keys).agg(number.alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        sizes = cut_lineage(counted)
    groups, worst = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    if (worst or 0) <= min(SORTED_ROWS, limit):
        rows = join_null_safe(cells, hint_small(sizes, groups), keys)
        counted = rows.groupBy(*keys, "n", "v").agg(number.alias("c"))
        return _pick(counted.selectExpr(*keys, "n", "v", "c", "0 AS bucket", "0 AS base"), keys, probs, method)
    sizes = sizes.withColumn("buckets", F.expr(f"least(bigint(ceil(n / {min(BUCKET_ROWS, limit)})), {MOST_BUCKETS})"))
    # the position grows with v, so buckets are in the order of their values
    bucket = "if(hi > lo AND hi - lo < double('inf'), least(floor((v - lo) / (hi - lo) * buckets), buckets - 1), 0) AS bucket"
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranks = _ranks(probs, method)
    placed = join_null_safe(cells, hint_small(sizes, groups), keys).selectExpr(*keys, "v", *more, "n", bucket)
    # a bucket of one value is an answer; the others' rows are read again
    wanted = cut_lineage(
        placed.groupBy(*keys, "n", "bucket")
        .agg(number.alias("c"), F.count(F.lit(1)).alias("cells"), F.min("v").alias("v"), F.max("v").alias("most"))
        .withColumn("upto", F.sum("c").over(order))
        .where(_any_hit(ranks))
        .selectExpr(*keys, "n", "bucket", "upto - c AS base", "c", "cells", "v", "v < most AS mixed")
    )
    picked = None
    if worst > limit:
        # too many rows in one bucket: the range is far wider than where most values lie
        dense = cut_lineage(wanted.where(f"cells > {limit} AND mixed").select(*keys).distinct())
        many = dense.count()
        if many:
            dense = hint_small(dense, many)
            large = cut_lineage(join_null_safe(sizes.select(*keys, "n"), dense, keys, "left_semi"))
            picked = _select_ranks(join_null_safe(data, dense, keys, "left_semi"), large, keys, probs, method, limit)
            wanted = join_null_safe(wanted, dense, keys, "left_anti")
    mixed = wanted.where("mixed").drop("c", "v")
    bounds = join_null_safe(sizes.drop("n"), mixed.groupBy(*keys).agg(F.collect_set("bucket").alias("wanted")), keys)
    again = join_null_safe(cells, hint_small(bounds, groups), keys).selectExpr(*keys, "v", *more, "wanted", bucket).where("array_contains(wanted, bucket)")
    counted = again.groupBy(*keys, "bucket", "v").agg(number.alias("c"))
    counted = join_null_safe(counted, hint_small(mixed, groups * len(ranks)), [*keys, "bucket"])
    columns = [*keys, "n", "bucket", "base", "v", "c"]
    found = _pick(counted.select(*columns).unionByName(wanted.where("NOT mixed").select(*columns)), keys, probs, method)
    return found if picked is None else found.unionByName(picked)


def _ranks(probs: dict[str, float], method: str) -> dict[str, str]:
    """The ranks wanted of a group of n values, by name."""
    ends = {}
    for i, p in enumerate(probs.values()):
        ends[f"below{i}"] = f"bigint(floor((n - 1) * double('{float(p)!r}')))"
        if method == "linear":
            ends[f"above{i}"] = f"bigint(ceil((n - 1) * double('{float(p)!r}')))"
    return ends


def _hit(rank: str) -> str:
    return f"({rank} < upto AND {rank} >= upto - c)"


def _any_hit(ranks: dict[str, str]) -> str:
    return " OR ".join(map(_hit, ranks.values()))


def _pick(counts: DataFrame, keys: list[str], probs: dict[str, float], method: str) -> DataFrame:
    """The wanted ranks from the value counts of the buckets that hold them; ``base`` rows of the group lie below a bucket."""
    ranks = _ranks(probs, method)
    by_value = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counts.withColumn("upto", F.col("base") + F.sum("c").over(by_value))
        .where(_any_hit(ranks))
        .groupBy(*keys, "n")
        .agg(*[F.expr(f"max(if({_hit(r)}, v, NULL)) AS {k}") for k, r in ranks.items()])
    )
    if method == "lower":
        return found.select(*keys, *[F.col(f"below{i}").alias(name) for i, name in enumerate(probs)])
    return found.select(
        *keys,
        *[
            F.expr(f"below{i} + (above{i} - below{i}) * ((n - 1) * double('{float(p)!r}') - {ranks[f'below{i}']})").alias(name)
            for i, (name, p) in enumerate(probs.items())
        ],
    )


def _select_ranks(data, large, keys, probs, method, limit) -> DataFrame:
    # two wanted ranks per probability: below and above the exact position
    spots = [(p, up) for p in probs.values() for up in (False, True)]
    targets = large
    for i, (p, up) in enumerate(spots):
        place = (F.col("n") - 1) * F.lit(float(p))
        rank = F.ceil(place) if up and method == "linear" else F.floor(place)
        targets = (
            targets.withColumn(f"k{i}", rank.cast("long"))
            .withColumn(f"n{i}", F.col("n"))
            .withColumn(f"lo{i}", F.lit(None).cast("double"))
            .withColumn(f"hi{i}", F.lit(None).cast("double"))
            .withColumn(f"ans{i}", F.lit(None).cast("double"))
        )
    targets = cut_lineage(targets)
    m = len(spots)
    before = None
    while True:
        open_rows = F.greatest(F.lit(0), *[F.when(F.col(f"ans{i}").isNull(), F.col(f"n{i}")) for i in range(m)])
        worst = targets.agg(F.max(open_rows).alias("w")).first().w
        if worst is None or worst <= limit:
            break
        if before is not None and worst >= before:
            raise RuntimeError(f"no progress in narrowing {worst} rows around a rank")
        before = worst
        targets = cut_lineage(_narrow(data, targets, keys, m))
        # every later pass reads only the rows that can still matter
        joined = _attach(data, targets, keys)
        alive = F.lit(False)
        for i in range(m):
            alive = alive | _inside(i)
        data = cut_lineage(joined.where(alive).select(*keys, "v"))
    return _finish(data, targets, keys, probs, m)


def _attach(data: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Give each row the targets of its group. Targets are written tables, so counting them is cheap."""
    return join_null_safe(data, hint_small(targets, targets.count()), keys, "inner")


def _inside(i: int) -> Column:
    v, lo, hi = F.col("v"), F.col(f"lo{i}"), F.col(f"hi{i}")
    return F.col(f"ans{i}").isNull() & (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def _narrow(data: DataFrame, targets: DataFrame, keys: list[str], m: int) -> DataFrame:
    joined = _attach(data, targets, keys)
    # sketches meet in two steps, so no task merges those of all input partitions
    salted = joined.groupBy(*keys, (F.spark_partition_id() % 64).alias("salt")).agg(
        *[F.kll_sketch_agg_double(F.when(_inside(i), F.col("v")), F.lit(SKETCH_K)).alias(f"s{i}") for i in range(m)]
    )
    sketches = salted.groupBy(*keys).agg(*[F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in range(m)])
    grid = F.array(*[F.lit(j / GRID) for j in range(GRID + 1)])
    pivots = join_null_safe(sketches, targets, keys, "inner")
    for i in range(m):
        cell = F.floor((F.col(f"k{i}") + F.lit(0.5)) / F.col(f"n{i}") * GRID).cast("int")
        values = F.when(F.col(f"ans{i}").isNull(), F.kll_sketch_get_quantile_double(f"s{i}", grid))
        pivots = (
            pivots.withColumn("_grid", values)
            .withColumn(f"a{i}", F.get("_grid", F.greatest(cell - 1, F.lit(0))))
            .withColumn(f"b{i}", F.get("_grid", F.least(cell + 2, F.lit(GRID))))
            .drop("_grid")
        )
    pivots = cut_lineage(pivots.drop(*[f"s{i}" for i in range(m)]))
    probe = _attach(data, pivots, keys)
    v = F.col("v")
    counts = []
    for i in range(m):
        a, b, inside = F.col(f"a{i}"), F.col(f"b{i}"), _inside(i)
        counts += [
            F.count_if(inside & (v < a)).alias(f"lt{i}"),
            F.count_if(inside & (v == a)).alias(f"ea{i}"),
            F.count_if(inside & (v > a) & (v < b)).alias(f"mid{i}"),
            F.count_if(inside & (v == b) & (b > a)).alias(f"eb{i}"),
        ]
    found = join_null_safe(probe.groupBy(*keys).agg(*counts), pivots, keys, "inner")
    out = [F.col(k) for k in keys] + [F.col("n")]
    for i in range(m):
        k, n, a, b = (F.col(f"{x}{i}") for x in ("k", "n", "a", "b"))
        lo, hi, ans = (F.col(f"{x}{i}") for x in ("lo", "hi", "ans"))
        to_a = F.col(f"lt{i}")
        past_a = to_a + F.col(f"ea{i}")
        to_b = past_a + F.col(f"mid{i}")
        past_b = to_b + F.col(f"eb{i}")

        def zone(done, below, at_a, between, at_b, above):
            return (
                F.when(ans.isNotNull(), done)
                .when(k < to_a, below)
                .when(k < past_a, at_a)
                .when(k < to_b, between)
                .when(k < past_b, at_b)
                .otherwise(above)
            )

        out += [
            zone(k, k, k, k - past_a, k, k - past_b).alias(f"k{i}"),
            zone(n, to_a, n, F.col(f"mid{i}"), n, n - past_b).alias(f"n{i}"),
            zone(lo, lo, lo, a, lo, b).alias(f"lo{i}"),
            zone(hi, a, hi, b, hi, hi).alias(f"hi{i}"),
            zone(ans, F.lit(None), a, F.lit(None), b, F.lit(None)).cast("double").alias(f"ans{i}"),
        ]
    return found.select(*out)


def _finish(data, targets, keys, probs, m) -> DataFrame:
    """Rank the few rows left per target and interpolate."""
    joined = _attach(data, targets, keys)
    left = F.filter(
        F.array(*[F.when(_inside(i), F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k"))) for i in range(m)]),
        lambda s: s.isNotNull(),
    )
    freq = (
        joined.select(*keys, "v", F.explode(left).alias("t"))
        .groupBy(*keys, "t", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    upto = F.sum("c").over(Window.partitionBy(*keys, "t.i").orderBy("v"))
    ranked = freq.withColumn("upto", upto).where(
        (F.col("t.k") < F.col("upto")) & (F.col("t.k") >= F.col("upto") - F.col("c"))
    )
    ends = ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("t.i") == i, F.col("v"))).alias(f"v{i}") for i in range(m)]
    )
    solved = join_null_safe(targets, ends, keys, "left")
    out = []
    for j, (name, p) in enumerate(probs.items()):
        low = F.coalesce(F.col(f"ans{2 * j}"), F.col(f"v{2 * j}"))
        high = F.coalesce(F.col(f"ans{2 * j + 1}"), F.col(f"v{2 * j + 1}"))
        place = (F.col("n") - 1) * F.lit(float(p))
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return solved.select(*keys, *out)
