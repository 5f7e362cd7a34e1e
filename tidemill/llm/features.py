"""Hashed text features and models that are fitted by mixing the parameters of shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import groups_of, tidy
from tidemill.plans.session import cut_lineage

# A training shard has about this many documents; a sample has at most LARGEST_SAMPLE of them.
SHARD_ROWS = 3000
LARGEST_SAMPLE = 24_000

# Trained states are averaged in tasks, each with one of so many ranges of buckets.
RANGES = 16

# Words hashed at a time when texts are scored.
STEP_WORDS = 200_000

_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4E, 0x165667B19E3779F8, 0xD6E8FEB86659FD92)]

STRIDE = _ODD[3]


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def spread(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Buckets for hashes of one kind of feature."""
    x = (h ^ (h >> np.uint64(31))) * _ODD[kind % 4] + np.uint64(kind)
    return ((x ^ (x >> np.uint64(29))) * _ODD[0] >> np.uint64(64 - bits)).astype(np.int64)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _ODD[1] + b) * _ODD[2]


def in_steps(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes; a longer text has a range of its own."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def labelled_sample(rows: DataFrame, labels: DataFrame, grade: str, key: str, most: int = LARGEST_SAMPLE) -> DataFrame:
    """The texts of at most ``most`` labelled keys: (key, text, grade, shard).

    The keys with the smallest hashes are taken, so the sample doesn't depend on the order of rows. Several
    rows or labels of one key count once. The number of shards follows from the size.
    """
    order = F.xxhash64(F.lit("sample"), F.col(key).cast("string"))
    graded = labels.where(F.col(key).isNotNull() & F.col(grade).isNotNull()).groupBy(key).agg(F.max(grade).alias("grade"))
    known = graded.join(rows.select(key).distinct(), key, "left_semi")
    picked = cut_lineage(known.withColumn("order", order).orderBy("order", key).limit(most))
    shards = max(1, round(picked.count() / SHARD_ROWS))
    # at most ``most`` rows of two numbers
    chosen = F.broadcast(picked.select(key, "grade", F.pmod("order", F.lit(shards)).cast("int").alias("shard"), "order"))
    # of a key that stands in several rows, the smallest text; combined before the shuffle
    return rows.join(chosen, key).groupBy(key, "grade", "shard", "order").agg(F.min("text").alias("text"))


def pack_shards(sample: DataFrame, featurise: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """One row per shard with its documents as sparse rows: (shard, grades, starts, buckets, values), all binary.

    ``featurise`` gives row starts, buckets and values of some texts. A shard has a bounded number of documents.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["shard"]):
            starts, buckets, values = featurise([t or b"" for t in group.column("text").to_pylist()])
            data = [group.column("grade").to_numpy().astype(np.float64), starts.astype(np.int64), buckets.astype(np.int32), values.astype(np.float32)]
            cols = [pa.array([group.column("shard")[0].as_py()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in data]]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "grades", "starts", "buckets", "values"])

    dealt = sample.select("shard", "order", F.col("text").cast("binary").alias("text"), F.col("grade").cast("double")).repartition("shard").sortWithinPartitions("shard", "order")
    return cut_lineage(dealt.mapInArrow(tidy(pack), "shard int, grades binary, starts binary, buckets binary, values binary"))


def common_buckets(sample: DataFrame, buckets_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int, least: int) -> np.ndarray:
    """Which buckets at least ``least`` texts of the whole sample have, as packed bits.

    ``buckets_of`` gives buckets and owners of some texts. Each task adds up its texts' counts before the shuffle.
    """

    width = -(-(1 << bits) // RANGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RANGES * width, np.uint8)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for a, b in in_steps(texts, STEP_WORDS * 6):
                keys, owners = buckets_of(texts[a:b])
                found, more = np.unique(np.unique(owners << bits | keys) & ((1 << bits) - 1), return_counts=True)
                # counts above ``least`` don't matter
                n[found] = np.minimum(n[found] + more, least)
        for part, here in enumerate(n.reshape(RANGES, width)):
            if here.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([here.tobytes()], pa.binary())], names=["part", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["part"]):
            n = np.zeros(width, np.int64)
            for x in group.column("n"):
                n += np.frombuffer(x.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_arrays([group.column("part")[:1].combine_chunks(), pa.array([np.packbits(n >= least).tobytes()], pa.binary())], names=["part", "n"])

    if not 0 < least < 256:
        raise ValueError("the least number of texts has to be from 1 to 255")
    counts = sample.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "part int, n binary")
    known = np.zeros((RANGES, width), bool)
    for row in counts.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, n binary").collect():
        known[row["part"]] = np.unpackbits(np.frombuffer(row["n"], np.uint8), count=width)
    return np.packbits(known.ravel()[: 1 << bits])


def shard_rounds(packed: DataFrame, learn: Callable[..., dict[str, np.ndarray]], state: dict[str, np.ndarray], size: int, rounds: int) -> dict[str, np.ndarray]:
    """Parameter mixing: in each round every shard learns from the common state, and the results are averaged.

    ``learn(state, grades, starts, buckets, values)`` returns the new state. Arrays of ``size`` numbers start
    at 0 and are kept in single precision. A shard sends what it changed, as bits and numbers, and tasks
    average that, each a range of buckets, so the driver holds the common state and its mean change only.
    Smaller arrays are averaged as they are, with the first range.
    """
    sc = packed.sparkSession.sparkContext
    names = list(state)
    large = [k for k in names if len(state[k]) == size]
    shards = packed.count()
    width = -(-size // RANGES)
    schema = ", ".join(f"{k} binary" for k in ["used", *names])

    def rows(part: int, extra: list, used: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
        """One row with the changed numbers of a range."""
        data = [np.packbits(used), *[values[k][used].astype(np.float32) if k in large else values[k] for k in names]]
        cols = [pa.array([x], pa.int32()) for x in (part, *extra)] + [pa.array([x.tobytes()], pa.binary()) for x in data]
        return pa.RecordBatch.from_arrays(cols, names=["part", *(["shard"] if extra else []), "used", *names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["part"]):
            part = group.column("part")[0].as_py()
            n = max(0, min(width, size - part * width))
            known, sums = np.zeros(n, bool), {k: np.zeros(n) if k in large else 0.0 for k in names}
            for row in group.to_pylist():
                used = np.unpackbits(np.frombuffer(row["used"], np.uint8), count=n).view(bool)
                known |= used
                for k in names:
                    if k in large:
                        sums[k][used] += np.frombuffer(row[k], np.float32)
                    else:
                        sums[k] = sums[k] + np.frombuffer(row[k], np.float64)
            yield rows(part, [], known, {k: v / shards for k, v in sums.items()})

    state = {k: np.zeros(size, np.float32) if k in large else v for k, v in state.items()}
    for _ in range(rounds if shards else 0):
        now = sc.broadcast(state)

        def one(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    data = [np.frombuffer(row[k], t) for k, t in (("grades", np.float64), ("starts", np.int64), ("buckets", np.int32), ("values", np.float32))]
                    new = learn({k: v.astype(np.float64) for k, v in now.value.items()}, *data)
                    for k in large:
                        new[k] -= now.value[k]
                    used = np.any([new[k] != 0 for k in large], axis=0)
                    for part in range(RANGES):
                        at = slice(part * width, (part + 1) * width)
                        if not part or used[at].any():
                            yield rows(part, [row["shard"]], used[at], {k: new[k][at] if k in large else new[k] if not part else new[k][:0] for k in names})

        learned = packed.mapInArrow(tidy(one), f"part int, shard int, {schema}").repartition("part").sortWithinPartitions("part", "shard")
        for row in learned.mapInArrow(merge, f"part int, {schema}").collect():
            low = row["part"] * width
            for k in names:
                if k in large:
                    here = state[k][low : low + width]
                    here[np.unpackbits(np.frombuffer(row["used"], np.uint8), count=len(here)).view(bool)] += np.frombuffer(row[k], np.float32)
                elif not row["part"]:
                    state[k] = np.frombuffer(row[k], np.float64)
        now.destroy()
    return state


def score_batches(batches: Iterator[pa.RecordBatch], score: Callable[[list[bytes]], list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Replace the binary column ``text`` by the scores of its texts."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        parts = [score(texts[a:b]) for a, b in in_steps(texts, STEP_WORDS * 6)]
        cols = [pa.array(np.concatenate(x)) for x in zip(*parts)] if parts else [pa.array([], pa.float64()) for _ in names]
        rest = [k for k in batch.schema.names if k != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], *cols], names=[*rest, *names])


def split_all(texts: list[bytes], table: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts after a byte translation, and where each text's words start."""
    parts = [t.translate(table).split() for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return list(chain.from_iterable(parts)), starts


def joined(texts: list[bytes], sparse: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of many texts, made some texts at a time."""
    starts, buckets, values = [np.zeros(1, np.int64)], [], []
    for a, b in in_steps(texts, STEP_WORDS * 6):
        s, k, v = sparse(texts[a:b])
        starts.append(s[1:] + starts[-1][-1])
        buckets.append(k)
        values.append(v)
    empty = np.zeros(0)
    return np.concatenate(starts), np.concatenate(buckets) if buckets else empty, np.concatenate(values) if values else empty
