"""Ranked lexical search: Block-Max MaxScore over compressed posting lists, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.features import in_steps
from tidemill.plans.session import cut_lineage

# Bytes of terms: ASCII digits and letters, the latter in lower case, and everything above ASCII.
TERM_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
NO_TERM = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Postings of a block; a shard has about so many documents; a slice of the queries so many terms.
BLOCK = 128
SHARD_DOCS = 8192
SLICE_TERMS = 1_000_000
# Bytes of text that are split at a time.
STEP = 4 << 20
# Heaps of an item are merged in so many groups first.
GROUPS = 64

# A term counts 1000 * ln(...) whole points; term frequency saturates at SCALE // 1000.
SCALE = 1_000_000_000
HALF = 50


def terms(text: Column) -> Column:
    """The terms of a text with repeats; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lower, NO_TERM), lambda t: t != "")


@dataclass(frozen=True)
class Queries:
    """Items as term numbers: those of item k are ``terms[starts[k]:starts[k + 1]]``; ``weights`` is by term number."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def _postings(wanted: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document with a term: its number of terms, and the frequencies of those that are searched for."""
        known = pa.array(wanted.value, pa.binary())
        total = len(known)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for a, b in in_steps(texts, STEP):
                parts = [t.translate(TERM_TABLE).split() for t in texts[a:b]]
                n = np.array([len(p) for p in parts], np.int64)
                words = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()
                number = pc.index_in(words.dictionary, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                at = number[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                hit = at >= 0
                both, tf = np.unique(np.repeat(np.arange(b - a), n)[hit] * total + at[hit], return_counts=True)
                doc, term = np.divmod(both, max(total, 1))
                some = np.flatnonzero(n)
                edges = np.searchsorted(doc, some, side="left"), np.searchsorted(doc, some, side="right")
                term, tf = term.astype("<i4"), tf.astype("<i4")
                cols = [
                    batch.column("key").slice(a, b - a).take(pa.array(some)),
                    pa.array(n[some]),
                    pa.array([term[x:y].tobytes() for x, y in zip(*edges)], pa.binary()),
                    pa.array([tf[x:y].tobytes() for x, y in zip(*edges)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "terms", "tfs"])

    return run


def _frequencies(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of documents per term, added up in the task."""
        df = np.zeros(total, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=total)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    return run


class Lists:
    """Posting lists of one shard: document numbers as differences in one, two or four bytes, a block at a time.

    A posting's impact is SCALE * tf // (1000 * tf + 20 * m) for its document's length norm m. The largest one of
    each block and of each list is kept uncompressed.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, norm: np.ndarray):
        order = np.argsort(term, kind="stable")  # documents stay in order
        term, doc, tf = term[order], doc[order], tf[order].astype(np.int64)
        impact = SCALE * tf // (1000 * tf + 20 * norm[doc])
        self.term, first, size = np.unique(term, return_index=True, return_counts=True)
        self.norm = norm
        blocks = -(-size // BLOCK)
        self.block_at = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(size)), blocks)
        inner = np.arange(len(owner)) - self.block_at[owner]
        self.start = first[owner] + inner * BLOCK
        self.size = np.minimum(BLOCK, size[owner] - inner * BLOCK)
        self.first_doc = doc[self.start] if len(doc) else doc
        self.block_max = np.maximum.reduceat(impact, self.start) if len(doc) else impact
        self.list_max = np.maximum.reduceat(impact, first) if len(doc) else impact
        gap = np.diff(doc, prepend=0)
        if len(doc):
            gap[self.start] = 0
        self.gaps, self.gap_class, self.gap_at = self._pack(gap)
        self.tfs, self.tf_class, self.tf_at = self._pack(tf)

    def _pack(self, values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Values in the narrowest of three widths per block: the three pools, each block's pool and place there."""
        if not len(values):
            return [np.zeros(0, t) for t in (np.uint8, np.uint16, np.uint32)], np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = np.maximum.reduceat(values, self.start)
        width = (top >= 1 << 8).astype(np.int64) + (top >= 1 << 16)
        at, pools = np.zeros(len(top), np.int64), []
        each = np.repeat(width, self.size)
        for k, kind in enumerate((np.uint8, np.uint16, np.uint32)):
            mine = width == k
            at[mine] = np.cumsum(self.size[mine]) - self.size[mine]
            pools.append(values[each == k].astype(kind))
        return pools, width, at

    def _unpack(self, pools, width, at, blocks: np.ndarray, inner: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = np.zeros(len(inner), np.int64)
        kinds = width[blocks]
        for k in range(3):
            if (kinds == k).any():
                mine = (kinds == k)[owner]
                out[mine] = pools[k][at[blocks][owner[mine]] + inner[mine]]
        return out

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the postings of some blocks of one list, in order."""
        size = self.size[blocks]
        owner = np.repeat(np.arange(len(blocks)), size)
        begin = np.cumsum(size) - size
        inner = np.arange(len(owner)) - begin[owner]
        run = np.cumsum(self._unpack(self.gaps, self.gap_class, self.gap_at, blocks, inner, owner))
        doc = run - run[begin][owner] + self.first_doc[blocks][owner]
        tf = self._unpack(self.tfs, self.tf_class, self.tf_at, blocks, inner, owner)
        return doc, SCALE * tf // (1000 * tf + 20 * self.norm[doc])


class Heap:
    """The best documents of an item so far: scores downwards, then keys upwards."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.keys, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """What a document has to reach; an equal score may still win by its key."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, keys: np.ndarray, null: np.ndarray) -> None:
        scores, keys, null = (np.concatenate(x) for x in ((self.scores, scores), (self.keys, keys), (self.null, null)))
        order = np.lexsort((keys, null, -scores))[: self.k]
        self.scores, self.keys, self.null = scores[order], keys[order], null[order]


def best_of(lists: Lists, query: np.ndarray, weights: np.ndarray, heap: Heap, keys: np.ndarray, null: np.ndarray) -> None:
    """Put the documents of a shard that may be among an item's best into its heap.

    Lists are ordered by their bounds. Those whose bounds together stay below the heap's threshold are not
    essential: they can't bring up a document by themselves. The others are added up; then each
    non-essential list, the strongest first, is decoded only in blocks whose maximum lets a document reach the threshold.
    """
    at = np.searchsorted(lists.term, query)
    at = np.minimum(at, max(len(lists.term) - 1, 0))
    here = lists.term[at] == query if len(lists.term) else np.zeros(len(query), bool)
    at, w = at[here], weights[query[here]]
    at, w = at[w > 0], w[w > 0]
    if not len(at):
        return
    bound = w * lists.list_max[at]
    order = np.argsort(bound, kind="stable")
    at, w, bound = at[order], w[order], bound[order]
    below = np.concatenate([[0], np.cumsum(bound)])  # bounds of all lists before
    weak = min(int(np.searchsorted(below[1:], heap.threshold)), len(at) - 1) if below[-1] >= heap.threshold else len(at)
    if weak == len(at):
        return
    total = np.zeros(len(keys), np.int64)
    for k in range(weak, len(at)):
        doc, impact = lists.decode(np.arange(lists.block_at[at[k]], lists.block_at[at[k] + 1]))
        total[doc] += w[k] * impact
    found = np.flatnonzero(total)
    score = total[found]
    for k in range(weak - 1, -1, -1):
        left = score + below[k + 1] >= heap.threshold
        found, score = found[left], score[left]
        if not len(found):
            return
        a, b = lists.block_at[at[k]], lists.block_at[at[k] + 1]
        block = np.searchsorted(lists.first_doc[a:b], found, side="right") - 1 + a
        inside = block >= a
        reach = np.where(inside, w[k] * lists.block_max[np.maximum(block, a)], 0)
        left = score + reach + below[k] >= heap.threshold
        found, score, block, inside = found[left], score[left], block[left], inside[left]
        wanted = np.unique(block[inside])
        if len(wanted):
            doc, impact = lists.decode(wanted)
            place = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
            score = score + np.where(doc[place] == found, w[k] * impact[place], 0)
    left = score >= heap.threshold
    heap.add(score[left], keys[found[left]], null[found[left]])


def _search(sent: Broadcast, k: int, documents: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = sent.value
        heaps = [Heap(k) for _ in range(len(q.starts) - 1)]

        def shard(rows: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(rows)
            n = table.column("n").to_numpy()
            parts = table.column("terms").to_pylist()
            term = np.frombuffer(b"".join(parts), "<i4")
            tf = np.frombuffer(b"".join(table.column("tfs").to_pylist()), "<i4")
            doc = np.repeat(np.arange(len(parts)), [len(p) // 4 for p in parts])
            lists = Lists(term, doc, tf, 100 - HALF + HALF * n * documents // length)
            key = table.column("key").combine_chunks()
            null = key.is_null().to_numpy(zero_copy_only=False)
            keys = key.fill_null(0).to_numpy().astype(np.int64)
            for heap, a, b in zip(heaps, q.starts, q.starts[1:]):
                best_of(lists, q.terms[a:b], q.weights, heap, keys, null)

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= SHARD_DOCS:
                shard(held)
                held, count = [], 0
        if count:
            shard(held)
        for a in range(0, len(heaps), 1000):
            some = heaps[a : a + 1000]
            item = np.repeat(np.arange(a, a + len(some)), [len(h.scores) for h in some])
            keys = pa.array(np.concatenate([h.keys for h in some]), mask=np.concatenate([h.null for h in some]))
            yield pa.RecordBatch.from_arrays([pa.array(item), keys, pa.array(np.concatenate([h.scores for h in some]))], names=["number", "key", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """The ``k`` best documents for each item: (item, rank, key, score), ranks from 1, equal scores by ascending key.

    A document's score sums, over the item's distinct terms, the term's weight times a saturating share of its
    frequency that falls with the document's length (whole numbers throughout). Only scores above 0 are listed.

    The documents are split into terms once; the frequencies of the terms that are searched for are written to the
    shared folder. Each task makes posting lists of its documents, a bounded shard at a time, and keeps a heap of ``k``
    per item, whose threshold carries over from shard to shard. Heaps are merged in two steps. Queries are
    handled in slices of a bounded number of terms, which are broadcast; each slice reads the documents anew.

    Keys are whole numbers. Rows with equal keys are documents of their own; a null key is ranked like any other, after
    the keys of equal scores. Rows of one item are searched as one item; null is an item. Null or empty texts have
    no terms: such documents aren't counted, such items have no rows. Empty tables give no rows. Other columns are dropped.
    """
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    wanted = queries.select(F.col(f"`{item}`").alias("item"), F.explode(terms(F.col(f"`{query}`"))).alias("term")).distinct()
    wanted = cut_lineage(wanted.withColumn("hash", F.xxhash64("item")))
    slices = max(1, -(-wanted.count() // SLICE_TERMS))
    found = None
    for s in range(slices):
        part = _search_slice(source, wanted.where(F.pmod("hash", F.lit(slices)) == s).drop("hash"), k)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _search_slice(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(item, rank, key, score) for a bounded number of rows (item, term)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    items = cut_lineage(wanted.select("item").distinct().orderBy("item").coalesce(1).withColumn("number", F.monotonically_increasing_id()))
    pairs = wanted.join(items, wanted["item"].eqNullSafe(items["item"])).select("number", "term").toPandas()
    vocabulary = sorted(t.encode() for t in set(pairs.term))
    place = {t.decode(): j for j, t in enumerate(vocabulary)}
    pairs = pairs.assign(term=[place[t] for t in pairs.term]).sort_values(["number", "term"])

    postings = cut_lineage(docs.mapInArrow(_postings(sc.broadcast(vocabulary)), "key long, n long, terms binary, tfs binary"))
    documents, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = postings.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term int, df long")
    # one row per term of the slice
    df = np.zeros(len(vocabulary), np.int64)
    rows = counted.groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df[rows.term] = rows.df
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    starts = np.searchsorted(pairs.number.to_numpy(), np.arange(int(pairs.number.max()) + 2 if len(pairs) else 1))
    sent = sc.broadcast(Queries(starts, pairs.term.to_numpy(np.int64), weights))

    best = postings.mapInArrow(_search(sent, k, int(documents), max(1, int(length))), "number long, key long, score long")
    by = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    group = F.pmod(F.xxhash64("key"), F.lit(GROUPS))
    some = best.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("number", "group").orderBy(*by))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*by))).where(F.col("rank") <= k)
    return ranked.join(items, "number").select("item", "rank", "key", "score")
