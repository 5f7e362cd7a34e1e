"""Correlation of wide tables: sums of products of all pairs of columns, made in blocks while the table is read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.columns import name_sql
from tidemill.plans.session import cut_lineage

# Columns of a block; bytes of sums that a task holds. More columns than these allow take further reads.
BLOCK = 256
SUMS_BYTES = 256 << 20
# Sums of each pair of columns over the rows that have both: rows, first, first squared, second, second squared, product.
SUMS = 6


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Rows of the array column as a matrix; missing cells are NaN."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, columns)


def _ranges(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count, mean, least and greatest value of each column, over the rows of a task."""
        n, total = np.zeros(columns), np.zeros(columns)
        lo, hi = np.full(columns, np.inf), np.full(columns, -np.inf)
        for batch in batches:
            x = _matrix(batch, columns)
            here = ~np.isnan(x)
            more = here.sum(0)
            with np.errstate(invalid="ignore"):
                step = np.where(here, x - total, 0).sum(0)  # around the mean so far
            n += more
            total += np.divide(step, n, out=np.zeros(columns), where=n > 0)
            lo, hi = np.minimum(lo, np.where(here, x, np.inf).min(0, initial=np.inf)), np.maximum(hi, np.where(here, x, -np.inf).max(0, initial=-np.inf))
        at = np.flatnonzero(n)
        cols = [pa.array(at.astype(np.int32)), *[pa.array(v[at]) for v in (n, total, lo, hi)]]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "n", "mean", "lo", "hi"])

    return run


def _products(pairs: list[tuple[int, int]], centre: np.ndarray):
    columns = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of some pairs of blocks over the rows of a task, one row per pair of blocks."""
        sums = {p: np.zeros((SUMS, min(BLOCK, columns - p[0] * BLOCK), min(BLOCK, columns - p[1] * BLOCK))) for p in pairs}
        for batch in batches:
            x = _matrix(batch, columns) - centre
            here = ~np.isnan(x)
            gaps = not here.all()
            x[~here] = 0.0
            m = here.astype(np.float64)
            for (a, b), s in sums.items():
                i, j = slice(a * BLOCK, (a + 1) * BLOCK), slice(b * BLOCK, (b + 1) * BLOCK)
                s[5] += x[:, i].T @ x[:, j]
                if gaps:
                    s[0] += m[:, i].T @ m[:, j]
                    s[1] += x[:, i].T @ m[:, j]
                    s[2] += (x[:, i] ** 2).T @ m[:, j]
                    s[3] += m[:, i].T @ x[:, j]
                    s[4] += m[:, i].T @ x[:, j] ** 2
                else:
                    s[0] += len(x)
                    s[1] += x[:, i].sum(0)[:, None]
                    s[2] += (x[:, i] ** 2).sum(0)[:, None]
                    s[3] += x[:, j].sum(0)[None, :]
                    s[4] += (x[:, j] ** 2).sum(0)[None, :]
        for (a, b), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["a", "b", "sums"])

    return run


def _correlate(columns: int, flat: np.ndarray):
    def finish(a: int, b: int, s: np.ndarray) -> pa.RecordBatch:
        n, sx, xx, sy, yy, xy = s
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = xx - sx * sx / n, yy - sy * sy / n
            # only rounding noise is left of a constant column
            vx, vy = np.where(vx > xx * 1e-12, vx, np.nan), np.where(vy > yy * 1e-12, vy, np.nan)
            corr = np.clip((xy - sx * sy / n) / (np.sqrt(vx) * np.sqrt(vy)), -1, 1)
        i, j = (x.ravel() for x in np.indices(corr.shape))
        i, j, corr = i + a * BLOCK, j + b * BLOCK, corr.ravel()
        corr[flat[i] | flat[j]] = np.nan
        half = i <= j
        return pa.RecordBatch.from_arrays([pa.array(i[half].astype(np.int32)), pa.array(j[half].astype(np.int32)), pa.array(corr[half], mask=np.isnan(corr[half]))], names=["i", "j", "corr"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add up the tasks' sums of each pair of blocks; these come sorted by block."""
        last, total = None, None
        for batch in batches:
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sums"))):
                s = np.frombuffer(data).reshape(SUMS, min(BLOCK, columns - a * BLOCK), -1)
                if (a, b) == last:
                    total = total + s
                    continue
                if last is not None:
                    yield finish(*last, total)
                last, total = (a, b), s
        if last is not None:
            yield finish(*last, total)

    return run


def wide_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all pairs of columns (column_x, column_y, corr), over the rows where both are present.

    A first read finds each column's mean and range. A second one multiplies blocks of centred columns
    as matrices; each task adds up its own sums, and those of all tasks meet by pair of blocks. So the number of reads
    doesn't depend on the number of columns, until the sums of a task exceed ``SUMS_BYTES`` (about 3,300 columns).
    """
    spark = df.sparkSession
    k = len(columns)
    cells = df.selectExpr(f"array({', '.join(f'double({name_sql(c)})' for c in columns)}) AS cells")
    found = cells.mapInArrow(_ranges(k), "i int, n double, mean double, lo double, hi double")
    # one row per column
    stats = found.groupBy("i").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
    centre, flat = np.zeros(k), np.ones(k, bool)
    centre[stats.i], flat[stats.i] = stats["mean"], stats.lo == stats.hi

    blocks = -(-k // BLOCK)
    pairs = [(a, b) for a in range(blocks) for b in range(a, blocks)]
    step = max(1, SUMS_BYTES // (SUMS * 8 * BLOCK * BLOCK))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = None
    for s in range(0, len(pairs), step):
        some = cells.mapInArrow(_products(pairs[s : s + step], centre), "a int, b int, sums binary")
        sums = some if sums is None else sums.unionByName(some)
    merged = sums.repartition(parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_correlate(k, flat), "i int, j int, corr double")
    half = cut_lineage(merged)
    names = spark.createDataFrame(list(enumerate(columns)), "i int, name string")
    both = half.unionByName(half.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    # one row per column
    named = both.join(F.broadcast(names.withColumnRenamed("name", "column_x")), "i").join(F.broadcast(names.select(F.col("i").alias("j"), F.col("name").alias("column_y"))), "j")
    return named.select("column_x", "column_y", "corr")
