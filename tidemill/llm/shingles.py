"""Similarity join of texts on word n-gram sets: MinHash bands for candidates, exact Jaccard for links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import addressed, components, forest, fresh_name, groups_of, tidy, with_decisions
from tidemill.plans.session import cut_lineage

WORDS = 5
# Distinct texts of a candidate component that are compared in one task: two tiles of this many, with about this many n-grams.
TILE_TEXTS = 1024
TILE_GRAMS = 2_000_000
# Columns of the n-gram matrix at a time.
COLUMNS = 4096

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def choose_bands(least: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows per band: the most rows (fewest false candidates) for which at most ``most`` hash
    functions find a pair of similarity ``least`` with probability ``recall``."""
    best = None
    for rows in range(1, most + 1):
        p = least**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no number of bands reaches this recall")
    return best


def gram_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams; a shorter text is one n-gram, one without words none."""
    out = []
    for t in texts:
        words = t.split()
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if len(h) < width:
            mixed = np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=width)], np.uint64)
        else:
            mixed = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * _ODD[k % len(_ODD)]
                mixed ^= mixed >> np.uint64(32)
        out.append(np.unique(mixed))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """MinHash of each non-empty set, folded into one 64-bit value per band."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(33))) * _ODD[1]
    folded = np.zeros((len(sets), bands), np.uint64)
    step = max(1, (1 << 18) // max(1, int(sizes.max())))
    for s in range(0, len(sets), step):
        e = min(len(sets), s + step)
        part = x[starts[s] : starts[e - 1] + sizes[e - 1]]
        at = starts[s:e] - starts[s]
        for k in range(bands * rows):
            low = np.minimum.reduceat((part * a[k] + (b[k] << np.uint64(31))) >> np.uint64(24), at)
            band = k // rows
            folded[s:e, band] = (folded[s:e, band] ^ low) * _ODD[2]
            folded[s:e, band] ^= folded[s:e, band] >> np.uint64(29)
    folded += np.arange(bands, dtype=np.uint64)[None, :] * _ODD[3]
    return folded ^ (folded >> np.uint64(31))


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = gram_sets([t or b"" for t in batch.column("text").to_pylist()], width)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            band: list = [None] * len(sets)
            if full:
                folded = signatures([sets[k] for k in full], bands, rows).view(np.int64)
                for k, f in zip(full, folded):
                    keys[k] = blake2b(sets[k].tobytes(), digest_size=16).digest()
                    band[k] = f
            cols = [batch.column("row"), batch.column("id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "key", "grams", "bands"])

    return run


def _load(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = gram_sets(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    return run


def jaccard_links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the two index lists whose sets have a Jaccard similarity of at least ``least``."""
    if len(first) == 1 and len(second) == 1:
        a, b = sets[first[0]], sets[second[0]]
        common = np.array([[len(np.intersect1d(a, b, assume_unique=True))]], np.float64)
    else:
        used = np.unique(np.concatenate([first, second]))
        sizes = np.array([len(sets[k]) for k in used])
        _, column, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        # an n-gram of one text only is in no intersection
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        column, owner = place[column[keep]], np.repeat(used, sizes)[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        position = np.full((2, used.max() + 1), -1)
        position[0, first], position[1, second] = np.arange(len(first)), np.arange(len(second))
        common = np.zeros((len(first), len(second)), np.float32)
        for s in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [s, s + COLUMNS])
            sides = []
            for which, n in ((0, len(first)), (1, len(second))):
                m = np.zeros((n, COLUMNS), np.float32)
                at = position[which, owner[a:b]]
                m[at[at >= 0], column[a:b][at >= 0] - s] = 1
                sides.append(m)
            common += sides[0] @ sides[1].T
    size = np.array([len(s) for s in sets], np.float64)
    union = size[first][:, None] + size[second][None, :] - common
    i, j = np.nonzero(common >= least * union - 1e-9)
    return first[i], second[j]


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text of a tile pair: how many documents it links to, and the smallest text it reaches there."""
        done, held = [], 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*done)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "links", "reach"])

        for group in groups_of(batches, ["root", "left", "right"]):
            tile, node, n = (group.column(k).to_numpy() for k in ("tile", "node", "n"))
            sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
            first, second = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
            if not len(first) or not len(second) or len(node) < 2:
                continue
            i, j = jaccard_links(sets, first, second, least)
            if left == right:
                i, j = i[i != j], j[i != j]
                links = np.bincount(i, weights=n[j], minlength=len(node)).astype(np.int64)
            else:
                links = (np.bincount(i, weights=n[j], minlength=len(node)) + np.bincount(j, weights=n[i], minlength=len(node))).astype(np.int64)
            at = np.flatnonzero(links)
            done.append((node[at], links[at], node[forest(i, j, len(node))[at]]))
            held += len(at)
            if held > 10_000:
                yield flush()
                done, held = [], 0
        if done:
            yield flush()

    return run


def link_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, width: int = WORDS, recall: float = 0.9999, stored: bool = False
) -> DataFrame:
    """One row per row of ``docs``: (row, key, n_links, class_id, copy_of, kept).

    Two rows link if the Jaccard similarity of their sets of word n-grams is at least ``least``; words are runs
    without white space, compared exactly. A text with fewer words than ``width`` is one n-gram; null texts
    and texts without words link with nothing. ``n_links`` counts all linked rows, ``class_id`` is the
    smallest key reachable by links (itself included), ``copy_of`` the smallest key with the same set. ``kept``
    is true for one row of each class, the first of those with the smallest key (null keys come last).
    ``row`` is the row's place in the stored table: of ``docs``, if they are ``stored`` (see ``addressed``), else of a
    copy. Repeated keys are rows of their own. Other columns are dropped. An empty table gives no rows. A text has to
    fit into a task.

    Rows with equal sets are one text from the start, so large groups of copies cost one row. Texts that share
    a band form candidate components. Only their sets are loaded, dealt into tiles of bounded size, and compared
    tile by tile as matrices; what leaves a task is one row per text, never a row per pair. A link is missed
    only if no band agrees, with probability 1 - ``recall`` at the threshold and less above.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands, rows = choose_bands(least, recall)
    chosen = [F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")]
    # texts are read a second time below
    numbered = addressed(docs.select(*chosen), "row", stored)
    place, kind = (numbered.schema[c].dataType.simpleString() for c in ("row", "id"))
    signed = cut_lineage(numbered.select("row", "id", "text").mapInArrow(tidy(_sign(width, bands, rows)), f"row {place}, id {kind}, key binary, grams long, bands array<bigint>"))

    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("low")
    groups = signed.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), first, F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = cut_lineage(groups.withColumn("node", F.monotonically_increasing_id()))

    member = classes.select("node", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1").select("band", "low")
    candidates = cut_lineage(components(member.join(shared, "band").select(F.col("node").alias("a"), F.col("low").alias("b"))))

    # tiles of a component are filled by hash; the largest text counts for its size
    known = candidates.join(classes.select("node", "n", "grams", F.col("low.row").alias("row")), "node")
    sizes = known.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(TILE_TEXTS)), F.ceil(F.sum("grams") / F.lit(TILE_GRAMS))).cast("int").alias("tiles"))
    placed = cut_lineage(known.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("grams"))
    texts = with_decisions(numbered.select("row", "text"), "row", placed.select(F.col("row").alias("place"), F.lit(1).alias("value")), "chosen").where("chosen = 1")
    wanted = texts.join(placed.select("row", "node"), "row").select("node", "text")
    sets = wanted.mapInArrow(tidy(_load(width)), "node long, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    sides = placed.select("root", "node", "n", "tile", other.alias("other")).select(
        "root", "node", "n", "tile", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right")
    )
    met = sides.join(sets, "node").repartition(parts, "root", "left", "right").sortWithinPartitions("root", "left", "right")
    found = cut_lineage(met.mapInArrow(tidy(_verify(least)), "node long, links long, reach long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("reach").alias("b")))
    full = classes.select("key", "node", "n", "low").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = full.groupBy("root").agg(F.min("low").alias("class"))
    info = full.join(lows, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("low.id").alias("copy_of"), "class")
    joined = signed.select("row", "id", "key").join(info, "key", "left")
    alone = F.col("class").isNull()
    return joined.select(
        "row",
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(alone, F.lit(True)).otherwise(F.col("class.row") == F.col("row")).alias("kept"),
    )


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; see ``link_texts``."""
    row = fresh_name(docs, "row")
    placed = addressed(docs, row, stored)
    kept = link_texts(placed.drop(row), key, text, stored=True).where("kept").select(F.col("row").alias("place"), F.lit(1).alias("value"))
    mark = fresh_name(docs, "kept")
    return with_decisions(placed, row, kept, mark).where(F.col(mark) == 1).drop(row, mark)
