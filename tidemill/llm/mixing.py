"""Mixing sources to target weights: dependent rounding of fractional copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import addressed, fresh_name, groups_of, with_decisions, word_count
from tidemill.llm.sharding import number_rows
from tidemill.plans.joins import join_null_safe
from tidemill.plans.session import cut_lineage

# Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
# No source is taken more often than this.
MOST = 2
# A group of the reduction tree has about this many rows, and this many groups meet one level up.
GROUP = 4096
# Closer to a whole number than this counts as whole.
WHOLE = 1e-9


def source_targets(sizes: DataFrame, budget_percent: int = 150, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size); one per source.

    Sources in code point order, null last, take the weights in turn and share ``budget_percent`` of all
    sizes; a share above ``most`` times its source's size stops there and its rest goes to the others by
    weight. Each round is one sum over the sources; it ends when no share is above its limit.
    """
    nulls = fresh_name(sizes, "nulls")
    numbered, count = number_rows(sizes.withColumn(nulls, F.col("source").isNull()), [nulls, "source"], "rank")
    w = F.get(F.lit(list(weights)), (F.col("rank") % len(weights)).cast("int"))
    rows = numbered.drop(nulls).withColumns({"weight": w, "top": F.col("source_size") * most})
    total = rows.agg(F.sum("source_size")).first()[0] if count else 0
    budget = float(total or 0) * budget_percent / 100
    level = 0.0
    while True:
        # shares at this level: level * weight, where that is below the limit
        capped = F.col("top") <= F.lit(level) * F.col("weight")
        held, free = rows.agg(
            F.sum(F.when(capped, F.col("top")).otherwise(F.lit(0))), F.sum(F.when(~capped, F.col("weight")).otherwise(F.lit(0)))
        ).first()
        new = (budget - (held or 0)) / free if free else level
        if not free or new <= level * (1 + 1e-12):
            break
        level = new
    target = F.least(F.col("top").cast("double"), F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def pivot(part: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Pivotal rounding of the probabilities ``part`` in the given order; all but one become 0 or 1.

    Two fractions meet: together below 1, one of them takes all and the other becomes 0; above 1, one
    becomes 1 and the other keeps the rest. Which one is drawn so that expectations stay. The one
    still fractional meets the next. Expectation and (but for one row) the sum are kept.
    """
    out = part.copy()
    held = -1
    for k in np.flatnonzero((part > WHOLE) & (part < 1 - WHOLE)):
        if held < 0:
            held = k
            continue
        a, b = out[held], out[k]
        both = a + b
        if both < 1:
            first = noise[k] < a / both
            winner, loser = (held, k) if first else (k, held)
            out[winner], out[loser] = both, 0.0
            held = winner
        else:
            first = noise[k] < (1 - b) / (2 - both) if both < 2 else True
            winner, loser = (held, k) if first else (k, held)
            out[winner], out[loser] = 1.0, both - 1
            held = loser
        if out[held] <= WHOLE or out[held] >= 1 - WHOLE:
            out[held] = round(out[held])
            held = -1
    return out


def _pivot_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round each (rank, bucket) group, larger rows first, so that pairs have like sizes."""
    for group in groups_of(batches, ["rank", "bucket"]):
        part = pivot(group.column("part").to_numpy(), group.column("noise").to_numpy())
        at = group.schema.get_field_index("part")
        yield from group.set_column(at, "part", pa.array(part)).combine_chunks().to_batches()


def round_parts(rows: DataFrame) -> DataFrame:
    """Round ``part`` of the rows (row, rank, size, noise, order, part) to 0 or 1, source by source.

    Rows of a source are dealt into groups of bounded size; each group leaves one fractional row
    at most. The left ones of many groups meet in groups of the next level, until one per source is left,
    which is drawn by itself. Every level is written down.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(GROUP))).cast("long")
    level = rows.join(counts.select("rank", buckets.alias("buckets")), "rank").withColumn("bucket", F.pmod("order", F.col("buckets")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = None
    while True:
        dealt = level.repartition(parts, "rank", "bucket").sortWithinPartitions("rank", "bucket", F.col("size").desc(), "order")
        ready = cut_lineage(dealt.mapInArrow(_pivot_groups, dealt.schema))
        left = (F.col("part") > WHOLE) & (F.col("part") < 1 - WHOLE)
        whole = ready.where(~left | (F.col("buckets") == 1))
        done = whole if done is None else done.unionByName(whole)
        rest = ready.where(left & (F.col("buckets") > 1))
        if rest.isEmpty():
            break
        up = F.ceil(F.col("buckets") / F.lit(GROUP)).cast("long")
        level = rest.withColumn("buckets", up).withColumn("bucket", F.pmod("bucket", F.col("buckets")))
    part = F.col("part")
    last = F.when((part > WHOLE) & (part < 1 - WHOLE), (F.col("noise") < part).cast("long")).otherwise(F.round(part).cast("long"))
    return done.select("row", last.alias("extra"))


def number_equals(rows: DataFrame, key: str, place: str, name: str) -> DataFrame:
    """Number the rows with equal ``key`` 0, 1, 2, ... as ``name``.

    Rows are counted by key and file, and numbered within these, so one key's rows meet in a task only as far as they lie in one file.
    """
    file = F.col(f"{place}.file")
    per_file = rows.groupBy(F.col(key).alias("k"), file.alias("f")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("f").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_file.select("k", "f", F.coalesce(before, F.lit(0)).alias("before")).where("before > 0")
    inside = F.row_number().over(Window.partitionBy(key, file).orderBy(f"{place}.index")) - 1
    numbered = rows.withColumn(name, inside.cast("long"))
    return numbered.join(offsets, (F.col(key) == F.col("k")) & (file == F.col("f")), "left").withColumn(name, F.col(name) + F.coalesce("before", F.lit(0))).drop("k", "f", "before")


def plan_copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 0, stored: bool = False) -> DataFrame:
    """How often each row goes into the mix: (row, key, source, size, source_size, target, copies), one per row.

    ``row`` is the row's place in the stored table: of ``docs``, if they are ``stored`` (see ``addressed``), else of a
    copy. A row's size is its number of words. All rows of a source have the same fractional number of copies, its
    target over its size; the whole part is taken as it is and the rest is rounded dependently. Draws depend on the
    seed and on key, source and text alone. Rows that are equal in these are told apart by a number, whichever takes
    which, so reruns agree however the rows are stored. Null texts and sources without words are never taken. An empty table gives no rows.
    """
    chosen = [F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")]
    placed = addressed(docs.select(*chosen), "row", stored)
    known_by = F.xxhash64("key", "source", "text", F.col("key").isNull(), F.col("source").isNull()).alias("identity")
    rows = cut_lineage(placed.select("row", "key", "source", word_count(F.col("text")).alias("size"), known_by))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = cut_lineage(targets.withColumn("rank", F.monotonically_increasing_id()))
    known = join_null_safe(number_equals(rows, "identity", "row", "number"), targets, ["source"])
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    planned = cut_lineage(known.select("row", "key", "source", "size", "source_size", "target", "rank", "identity", "number", F.coalesce(rate, F.lit(0.0)).alias("rate")))
    order = F.xxhash64(F.lit(seed), "identity", "number")
    noise = F.pmod(F.xxhash64(F.lit(seed + 1), "identity", "number"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    parts = planned.select("row", "rank", "size", noise.alias("noise"), order.alias("order"), (F.col("rate") - F.floor("rate")).alias("part"))
    extra = round_parts(parts.where((F.col("part") > WHOLE) & (F.col("part") < 1 - WHOLE)))
    whole = F.floor(F.col("rate") + F.lit(WHOLE)).cast("long")
    return planned.join(extra, "row", "left").select(
        "row", F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", (whole + F.coalesce("extra", F.lit(0))).alias("copies")
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 0, stored: bool = False) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as planned, all columns kept; see ``plan_copies``.

    Rows with equal key, source and text that differ in other columns may take each other's copies.
    """
    row, n, each = (fresh_name(docs, x) for x in ("row", "copies", "each"))
    placed = addressed(docs, row, stored)
    copies = plan_copies(placed.drop(row), text, source, key, seed, True).where("copies > 0").select(F.col("row").alias("place"), F.col("copies").alias("value"))
    joined = with_decisions(placed, row, copies, n, MOST).where(F.col(n) > 0)
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(row, n, each)
