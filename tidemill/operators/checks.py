"""Filters, key checks and many-to-one joins that report rule violations as rows.

All joins are equi-joins on the checked key. Sides that only answer "does this key exist"
are reduced to distinct keys first; the fact side may hold hot keys, which adaptive
execution splits (see ``plans.session``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.plans.joins import join_null_safe
from tidemill.plans.session import cut_lineage


def project_features(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Target plus the named features, or every other column when none are named."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column")
    if features is None:
        features = [c for c in df.columns if c != target]
    unknown = [c for c in features if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    if not features:
        raise ValueError("no features to use")
    if target in features:
        raise ValueError("the target cannot be a feature")
    return df.select(*features, target)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def exactly_one(left: Column, right: Column) -> Column:
    return left.isNotNull() != right.isNotNull()


def owner_violations(df: DataFrame, user: str = "user_id", session: str = "session_id") -> DataFrame:
    """Rows that do not have exactly one owner."""
    both = F.col(user).isNotNull() & F.col(session).isNotNull()
    return df.where(~exactly_one(F.col(user), F.col(session))).withColumn(
        "problem", F.when(both, F.lit("two owners")).otherwise(F.lit("no owner"))
    )


def reconcile_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only: ``(keys..., side)``, one shuffle for both directions."""
    tagged = (
        left.select(*keys, F.lit(1).alias("in_left"), F.lit(0).alias("in_right"))
        .unionByName(right.select(*keys, F.lit(0).alias("in_left"), F.lit(1).alias("in_right")))
        .groupBy(*keys)
        .agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
        .where("in_left + in_right = 1")
    )
    side = F.when(F.col("in_left") == 1, F.lit("left_only")).otherwise(F.lit("right_only"))
    return tagged.select(*keys, side.alias("side"))


def existing(df: DataFrame, reference: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``reference``; ``on`` maps df column to reference column."""
    return _by_reference(df, reference, on, "left_semi")


def orphans(df: DataFrame, reference: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``df`` whose non-null key does not occur in ``reference``."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    return _by_reference(df.where(present), reference, on, "left_anti")


def _by_reference(df: DataFrame, reference: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    known = reference.select(*[F.col(r).alias(f"_ref_{l}") for l, r in on.items()]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(l) == F.col(f"_ref_{l}") for l in on])
    return df.join(known, cond, how)


def duplicate_keys(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Keys that occur more than once, how often, and where the first two are; null is a key like any other."""
    # written down, so that no task counts all its keys and sorts its rows at the same time
    counts = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # only two rows per key leave each task; the rows stay sorted, so the second is the first's neighbour
    w = Window.partitionBy(*keys).orderBy(position)
    firsts = (
        df.select(*keys, position)
        .withColumn("rn", F.row_number().over(w))
        .where("rn <= 2")
        .withColumn("second", F.lead(F.struct(position)).over(w))
        .where("rn = 1 AND second IS NOT NULL")
        .select(*keys, F.col(position).alias("first_position"), F.col("second")[position].alias("second_position"))
    )
    return join_null_safe(counts, firsts, keys)


def valid_session_rows(df: DataFrame, sessions: DataFrame, key: str, ts: str, expires: str = "expires_at") -> DataFrame:
    """Rows whose session exists and has not expired at the time of the row."""
    return df.join(sessions.select(key, expires), key).where(F.col(ts) <= F.col(expires)).drop(expires)


def reassign_owner(jobs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Hand the rows of a session to its user: ``mapping`` is (session_id, new_user_id), unique by session."""
    joined = jobs.join(mapping, "session_id", "left")
    moved = F.col("new_user_id").isNotNull()
    return joined.select(
        *[
            F.when(moved, F.col("new_user_id")).otherwise(F.col("user_id")).alias(c)
            if c == "user_id"
            else F.when(~moved, F.col("session_id")).alias(c)
            if c == "session_id"
            else F.col(c)
            for c in jobs.columns
        ]
    )
