"""Cutting very large groups into consecutive pieces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans.joins import join_null_safe
from tidemill.plans.session import cut_lineage, group_rows, hint_small

MOST_PARTITIONS = 10_000


def ordered_pieces(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``piece``, so that no (keys, piece) group is much larger than the row limit.

    Groups within the limit are one piece. Larger ones are range-partitioned by ``order`` (which
    must be unique inside a group), and the partition number is the piece: pieces of a group
    follow each other in that order. The numbers are written down before they are used.
    """
    limit = group_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = cut_lineage(sizes)
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return df.withColumn("piece", F.lit(0).cast("long"))
    names = hint_small(large.select(*keys), large.count())
    whole = join_null_safe(df, names, keys, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    cut = (
        join_null_safe(df, names, keys, "left_semi")
        .repartitionByRange(min(MOST_PARTITIONS, math.ceil(2 * total / limit)), *keys, *order)
    )
    if 2 * total / limit > MOST_PARTITIONS:
        # partitions are limited, so each one is cut further by the place of its sorted rows
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        piece = F.spark_partition_id().cast("long") * F.lit(1 << 20) + F.floor(place / F.lit(limit))
        cut = cut.sortWithinPartitions(*keys, *order).withColumn("piece", piece)
    else:
        cut = cut.withColumn("piece", F.spark_partition_id().cast("long"))
    return whole.unionByName(cut_lineage(cut))
