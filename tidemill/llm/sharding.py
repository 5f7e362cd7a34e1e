"""Reproducible shuffle into shards: a keyed permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fresh_name, let
from tidemill.plans.session import cut_lineage

ROUNDS = 6
# More steps outside the range than this don't occur: each is left again with probability 2 / sqrt(rows).
LONGEST_WALK = 64


def number_rows(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> tuple[DataFrame, int]:
    """Number all rows 0, 1, ... by ``order`` (nulls first) and count them.

    Rows are range-partitioned and sorted, and written once to the shared folder with their place inside
    the partition; one offset per partition completes the number. Rows equal in ``order`` may take
    each other's numbers, so it should be unique; a key that is repeated very often is still split
    over partitions, by the order in which rows were read.
    """
    spark = df.sparkSession
    tie, place = fresh_name(df, "tie"), fresh_name(df, "place")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(f"`{c}`") for c in order], F.col(tie)]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = cut_lineage(ranged.drop(tie).withColumn(place, F.monotonically_increasing_id()))
    # the upper bits are the partition, the lower 33 the place inside it; one row per partition goes to the driver
    sizes = placed.groupBy(F.shiftright(F.col(place), 33).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for part, n in sizes:
        starts += [0] * (part - len(starts)) + [total]
        total += n
    start = F.get(F.lit(starts or [0]), F.shiftright(F.col(place), 33).cast("int"))
    number = F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + start
    return placed.withColumn(name, number.cast("long")).drop(place), total


def _noise(value: Column, turn: Column, seed: int, width: int) -> Column:
    """A pseudo-random number below ``width`` from a value, a round and a seed."""
    hexed = F.substring(F.md5(F.concat_ws("|", F.lit(seed), turn.cast("string"), value.cast("string"))), 1, 12)
    return F.conv(hexed, 16, 10).cast("long") % F.lit(width)


def sides(total: int) -> tuple[int, int]:
    """Width of the two halves; their product is the smallest grid of the kind that holds ``total``."""
    left = max(1, math.isqrt(max(total - 1, 0)) + 1)
    return left, max(1, -(-total // left))


def _pass(x: Column, seed: int, left: int, right: int, back: bool = False) -> Column:
    """All rounds: in each, one half moves by a hash of the other one."""
    sign = F.lit(-1 if back else 1)

    def turn(y: Column, t: Column) -> Column:
        a, b = F.floor(y / F.lit(right)).cast("long"), y % F.lit(right)
        upper = F.pmod(a + sign * _noise(b, t, seed, left), F.lit(left)) * F.lit(right) + b
        return F.when(t % 2 == 0, upper).otherwise(a * F.lit(right) + F.pmod(b + sign * _noise(a, t, seed, right), F.lit(right)))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, x, turn)


def permute(number: Column, total: int, seed: int = 0, back: bool = False) -> Column:
    """The place of a row number in a keyed permutation of 0 .. total - 1 (or, with ``back``, its inverse).

    A Feistel network with additive halves permutes a grid of at most total + sqrt(total) cells; a place
    beyond the end is sent through the network again until it falls inside (cycle walking). No walk is
    longer than the number of cells beyond the end; a walk over the limit fails instead of going on.
    """
    left, right = sides(total)
    steps = min(left * right - total + 1, LONGEST_WALK)
    first = _pass(number.cast("long"), seed, left, right, back)
    if steps == 1:
        return first

    def step(y: Column, _: Column) -> Column:
        return F.when(y >= F.lit(total), _pass(y, seed, left, right, back)).otherwise(y)

    def walk(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, step)

    def inside(y: Column) -> Column:
        return F.when(y < F.lit(total), y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))

    return let(first, lambda x: F.when(x < F.lit(total), x).otherwise(let(walk(x), inside)))


def shard_of(place: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place: places are dealt out in turn, so shards differ by one row at most."""
    return (place % F.lit(shards)).cast("int"), F.floor(place / F.lit(shards)).cast("long")


def row_at(shard: Column, slot: Column, total: int, shards: int, seed: int = 0) -> Column:
    """The row number that lies at a slot: the way back from ``shard_rows``."""
    return permute(slot * F.lit(shards) + shard, total, seed, back=True)


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to all rows.

    Shard and slot follow from the row's number by ``order``, the number of rows, the number of shards
    and the seed alone. Law: shards' row counts differ by one at most. Columns that ``df`` already has
    under these names are replaced. Null keys sort first; rows with equal keys take adjacent numbers, in
    any order. An empty table stays empty.
    """
    number = fresh_name(df, "number")
    numbered, total = number_rows(df.drop("shard", "slot"), order, number)
    place = fresh_name(df, "place")
    return (
        numbered.withColumn(place, permute(F.col(number), total, seed))
        .withColumns(dict(zip(("shard", "slot"), shard_of(F.col(place), shards))))
        .drop(number, place)
    )
