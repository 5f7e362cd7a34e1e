"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.session import broadcast_rows, cut_lineage, tune

# White space between words; a word is a run of other characters.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

SETTINGS = {
    # Arrow batches are bounded by rows and by bytes, so that long texts don't add up in a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Shuffle files go when their query ends; results that are read again are written tables.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

# A node with more pairs than this counts as a hub when components are found.
HUB = 256

# Decisions about rows are broadcast up to so many words of 64 rows each, about 40 MB.
DECISION_WORDS = 1_000_000


def settle(spark: SparkSession) -> SparkSession:
    """The library's session settings, small Arrow batches and shuffle files that go when they are done with."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return tune(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def word_array(text: Column) -> Column:
    """All words of a text, in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"[{SPACE}]+"))).cast("long")


def addressed(docs: DataFrame, name: str, stored: bool = False) -> DataFrame:
    """Add the place of each row, a struct of its file's hash and its index in the file.

    The place is a property of the stored rows: it doesn't depend on how a scan is cut into partitions, and no
    copy with numbers is needed. ``stored`` says that ``docs`` is a table as read from Parquet files, at most with
    some columns or rows left out; others are written first.
    """
    if stored:
        try:
            at = docs.metadataColumn("_metadata")
            return docs.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("index")))
        except AnalysisException:
            pass
    return addressed(cut_lineage(docs), name, True)


def with_decisions(docs: DataFrame, place: str, decisions: DataFrame, name: str, most: int = 1) -> DataFrame:
    """Add ``name``, the small number that ``decisions`` (place, value from 1 to ``most``) has for a row's place, else 0.

    Decisions about 64 neighbours are packed into a word per binary digit, so they are far smaller than the rows.
    Up to ``DECISION_WORDS`` words are broadcast and the rows stay where they are; more are joined.
    """
    digits = most.bit_length()
    index = F.col("place.index")
    here = decisions.select(F.col("place.file").alias("file"), F.shiftright(index, 6).alias("word"), index.bitwiseAND(F.lit(63)).cast("int").alias("bit"), "value")
    each = lambda k: F.bit_or(F.when(F.getbit("value", F.lit(k)) == 1, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))).alias(f"d{k}")
    packed = cut_lineage(here.withColumn("value", F.col("value").cast("long")).groupBy("file", "word").agg(*[each(k) for k in range(digits)]))
    words = packed.count()
    bits = fresh_name(docs, "bits")
    side = packed.select(F.struct("file", "word").alias(f"{bits}word"), F.struct(*[f"d{k}" for k in range(digits)]).alias(bits))
    side = F.broadcast(side) if words <= DECISION_WORDS else side
    key = F.struct(F.col(f"{place}.file").alias("file"), F.shiftright(F.col(f"{place}.index"), 6).alias("word"))
    bit = F.col(f"{place}.index").bitwiseAND(F.lit(63)).cast("int")
    value = sum(((F.getbit(F.col(f"{bits}.d{k}"), bit) * (1 << k)).cast("int") for k in range(digits)), F.lit(0))
    return docs.join(side, key == F.col(f"{bits}word"), "left").withColumn(name, F.coalesce(value, F.lit(0))).drop(f"{bits}word", bits)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): one row (node, root) for each node that has a pair.

    The root is the smallest node of its component. Pairs are contracted by alternating large-star and
    small-star steps until nothing changes; each step is joins and minima over pairs, written to the
    shared folder. Minima are combined before the shuffle, and nodes with very many pairs get theirs by a broadcast
    of these few, so a hub's pairs are never gathered in one place.
    """
    pairs = _stored_pairs(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    seen = None
    while pairs[1] != seen:
        seen = pairs[1]
        e = pairs[0]
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        near = with_least(both, "u", "v").select("u", "v", F.least("u", "low").alias("low"))
        large = near.where("v > u").select(F.col("low").alias("lo"), F.col("v").alias("hi")).distinct()
        small = with_least(large, "hi", "lo").select(F.explode(F.array(F.struct(F.col("low").alias("lo"), F.col("hi")), F.struct(F.col("low").alias("lo"), F.col("lo").alias("hi")))).alias("p")).select("p.*")
        pairs = _stored_pairs(small.where("lo <> hi").distinct())
    stars = pairs[0]
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def with_least(pairs: DataFrame, node: str, other: str) -> DataFrame:
    """Add ``low``, the smallest ``other`` that a pair's ``node`` has.

    Nodes with more than ``HUB`` pairs are at most a ``HUB``-th of the pairs; if they are few enough, their minima are
    broadcast and their pairs stay where they are. All others are joined.
    """
    lows = cut_lineage(pairs.groupBy(node).agg(F.min(other).alias("low"), F.count(F.lit(1)).alias("n")))
    hubs = lows.where(F.col("n") > HUB)
    if not 0 < hubs.count() <= broadcast_rows(pairs.sparkSession):
        return pairs.join(lows.drop("n"), node)
    marked = pairs.join(F.broadcast(hubs.select(node, F.col("low").alias("hub_low"))), node, "left")
    at_hubs = marked.where("hub_low IS NOT NULL").withColumnRenamed("hub_low", "low")
    return at_hubs.unionByName(marked.where("hub_low IS NULL").drop("hub_low").join(lows.where(F.col("n") <= HUB).drop("n"), node))


def _stored_pairs(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The written pairs, and a fingerprint that changes with them."""
    kept = cut_lineage(pairs)
    mark = kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi")), F.bit_xor(F.xxhash64(F.lit(7), "lo", "hi"))).first()
    return kept, tuple(mark)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives its worker's free memory back at the end of a task: workers are kept and go on to other operators."""

    @wraps(run)
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n items, the smallest item it reaches over the links (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label, new)  # the old root learns of it too
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches that are sorted by them; one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
