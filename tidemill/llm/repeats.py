"""Periodic runs in word sequences, found through string synchronising sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.features import in_steps

# A run has at least this many words, and two periods.
LEAST = 12
# The smallest scale. Periods below three times that are looked for one by one.
FIRST = 8
# Fingerprints of up to 2 ** TOP words are kept for comparisons.
TOP = 10
# Bytes of text that are searched at a time; a longer text is searched by itself.
STEP = 3 << 20

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def doubled(prints: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of stretches of ``2 * width`` words from those of ``width`` words."""
    n = max(0, len(prints) - width)
    return mixed(prints[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(prints[width : width + n] + np.uint64(width)))


class Comparer:
    """How far two places of a word sequence agree, by fingerprints of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.levels = [mixed(words.astype(np.int64).view(np.uint64) + np.uint64(1))]
        while len(self.levels) <= TOP and len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            self.levels.append(doubled(self.levels[-1], 1 << (len(self.levels) - 1)))

    def _equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether 2 ** level words from a and from b on are equal, for a < b."""
        prints = self.levels[level]
        inside = (a >= 0) & (b < len(prints))
        out = np.zeros(len(a), bool)
        out[inside] = prints[a[inside]] == prints[b[inside]]
        return out

    def _agree(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        done = np.zeros(len(a), np.int64)
        sign = -1 if back else 1
        top = len(self.levels) - 1
        going = np.arange(len(a))
        while len(going):
            at = sign * done[going] - ((1 << top) if back else 0)
            going = going[self._equal(top, a[going] + at, b[going] + at)]
            done[going] += 1 << top
        for level in range(top - 1, -1, -1):
            at = sign * done - ((1 << level) if back else 0)
            done += self._equal(level, a + at, b + at).astype(np.int64) << level
        return done

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from a and b on (a < b)."""
        return self._agree(a, b, False)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before a and b (a < b)."""
        return self._agree(a, b, True)


def stretches(words: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of at least ``least`` words that have this period."""
    same = np.flatnonzero(words[:-period] == words[period:])
    if not len(same):
        return same, same
    cuts = np.flatnonzero(np.diff(same) > 1)
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(same) - 1]])
    start, end = same[first], same[last] + 1 + period
    enough = end - start >= least
    return start[enough], end[enough]


def smallest_only(compare: Comparer, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each stretch has no smaller period; one that has, has a divisor of its period as well."""
    good = np.ones(len(start), bool)
    rest, factor = period.copy(), 2
    while (rest > 1).any():
        # every period's prime factors in turn; what is left above the root is prime
        prime = np.where(rest % factor == 0, factor, np.where(factor * factor > rest, rest, 0))
        at = np.flatnonzero((prime > 1) & (rest > 1))
        if len(at):
            shorter = period[at] // prime[at]
            has = compare.forward(start[at], start[at] + shorter) >= end[at] - start[at] - shorter
            good[at[has]] = False
            while True:
                again = (prime > 1) & (rest > 1) & (rest % np.maximum(prime, 1) == 0)
                if not again.any():
                    break
                rest[again] //= prime[again]
        rest[~good] = 1
        factor += 1
    return good


def synchronising(prints: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Positions whose window of ``scale`` + 1 fingerprints has its smallest one at an end.

    The choice depends on the next ``2 * scale`` words only, so equal contexts are chosen alike. Of any
    ``scale`` positions in a row at least one is chosen, unless all of the words there are highly periodic:
    ``periodic`` marks the positions whose ``scale`` words have a period of a third of that or less.
    """
    x = np.where(periodic[: len(prints)], _NONE, prints)
    low, width = x, 1
    while width < scale:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if len(low) < 2:
        return np.zeros(0, np.int64)
    low = np.minimum(low[:-1], low[1:])  # scale + 1 of them
    n = min(len(low), max(0, len(x) - scale))
    low = low[:n]
    return np.flatnonzero((low != _NONE) & ((low == x[:n]) | (low == x[scale : scale + n])))


def equal_contexts(at: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, distance) of chosen positions with equal contexts and low <= distance < high.

    Contexts that aren't highly periodic recur at distances of a sixth of their length at least, so there are few.
    """
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    places, gaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first, lag = np.arange(len(at)), 0
    while len(first):
        lag += 1
        first = first[first + lag < len(at)]
        near = (context[first] == context[first + lag]) & (at[first + lag] - at[first] < high)
        first = first[near]
        gap = at[first + lag] - at[first]
        places.append(at[first][gap >= low])
        gaps.append(gap[gap >= low])
    return np.concatenate(places), np.concatenate(gaps)


def periodic_neighbours(compare: Comparer, start: np.ndarray, end: np.ndarray, period: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, distance) from highly periodic stretches that follow each other with the same root.

    A run all of whose first period lies in one such stretch has its second one in the next; its period is the
    shift that brings their roots together, plus a multiple of the small period.
    """
    none = np.zeros(0, np.int64)
    long = end - start >= low
    start, end, period = start[long], end[long], period[long]
    if len(start) < 2:
        return none, none
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    big = int(end.max()) + 2
    key = period * big + start
    # the next stretch begins less than a period before the end of this one, or at it
    nxt = np.searchsorted(key, period * big + end - period, side="right")
    ok = nxt < len(key)
    nxt = np.minimum(nxt, len(key) - 1)
    ok &= (period[nxt] == period) & (start[nxt] <= end) & (start[nxt] > start)
    a, b = np.flatnonzero(ok), nxt[ok]
    # rotations of the second stretch's root against the first one's
    turns = period[a]
    pair = np.repeat(np.arange(len(a)), turns)
    turn = np.arange(len(pair)) - np.repeat(np.cumsum(turns) - turns, turns)
    x, y = start[a][pair], start[b][pair] + turn
    fits = compare.forward(x, y) >= period[a][pair]
    pair, shift = pair[fits], (y - x)[fits]
    a, b = a[pair], b[pair]
    r = period[a]
    most = np.minimum(np.minimum(end[a] - start[a], end[b] - start[b]) + r, high - 1)
    least = low + (shift - low) % r
    count = np.maximum(0, (most - least) // r + 1)
    each = np.repeat(np.arange(len(a)), count)
    step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    gap = least[each] + step * r[each]
    place = np.maximum(start[a][each], start[b][each] - gap)
    return place, gap


def runs_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run in some texts, in no order.

    ``words`` holds the texts' word numbers one after the other, the longest text first, each followed by a
    number that occurs nowhere else; ``lengths`` are the texts' numbers of words.
    """
    empty = np.zeros(0, np.int64)
    if len(words) < LEAST:
        return empty, empty, empty
    compare = Comparer(words)
    starts, ends, periods = [empty], [empty], [empty]
    for p in range(1, min(3 * FIRST, len(words))):
        # short stretches of the smallest periods only tell where the first scale is highly periodic
        s, e = stretches(words, p, max(2 * p, FIRST if 3 * p <= FIRST else LEAST))
        starts.append(s)
        ends.append(e)
        periods.append(np.full(len(s), p))
    start, end, period = np.concatenate(starts), np.concatenate(ends), np.concatenate(periods)
    smallest = smallest_only(compare, start, end, period)
    start, end, period = start[smallest], end[smallest], period[smallest]

    bounds = np.cumsum(lengths + 1)
    scale, prints = FIRST, compare.levels[min(FIRST.bit_length() - 1, len(compare.levels) - 1)]
    while True:
        # texts too short for a run of this scale's periods are left out; they stand at the end
        n = int(np.searchsorted(-lengths, -6 * scale, side="right"))
        if not n:
            break
        size = int(bounds[n - 1])
        prints = prints[: max(0, size - scale + 1)]
        high = 3 * period <= scale
        marked = np.zeros(size + 1, np.int64)
        at = np.flatnonzero(high & (end - start >= scale) & (start < size))
        np.add.at(marked, start[at], 1)
        np.add.at(marked, np.minimum(end[at] - scale + 1, size), -1)
        chosen = synchronising(prints, scale, np.cumsum(marked)[:size] > 0)
        context = doubled(prints, scale)
        chosen = chosen[chosen < len(context)]
        places, gaps = equal_contexts(chosen, context[chosen], 3 * scale, 6 * scale)
        more_places, more_gaps = periodic_neighbours(compare, start[high], end[high], period[high], 3 * scale, 6 * scale)
        places, gaps = np.concatenate([places, more_places]), np.concatenate([gaps, more_gaps])
        s = places - compare.backward(places, places + gaps)
        e = places + gaps + compare.forward(places, places + gaps)
        enough = e - s >= 2 * gaps
        found = np.unique(np.stack([s[enough], gaps[enough], e[enough]]), axis=1)
        s, p, e = found
        smallest = smallest_only(compare, s, e, p)
        start, end, period = np.concatenate([start, s[smallest]]), np.concatenate([end, e[smallest]]), np.concatenate([period, p[smallest]])
        scale, prints = 2 * scale, context
    long = end - start >= LEAST
    return start[long], (end - start)[long], period[long]


def search(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs (start, length, period) of each text by start and period, and its words without repeats."""
    parts = [t.split() for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat: list[bytes] = []
    for k in order:
        flat += parts[k]
        flat.append(b"")
    numbers = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths[order] + 1)])
    numbers[bounds[1:] - 1] = -1 - np.arange(len(parts))
    start, length, period = runs_of(numbers, lengths[order])
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]

    marked = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(marked, start + period, 1)
    np.add.at(marked, start + length, -1)
    dropped = np.cumsum(marked)[:-1] > 0
    edges = np.searchsorted(start, bounds)
    runs: list = [[]] * len(parts)
    kept: list = [b""] * len(parts)
    for j, k in enumerate(order):
        a, b = edges[j], edges[j + 1]
        words = parts[k]
        if a < b:
            runs[k] = list(zip((start[a:b] - bounds[j]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
            words = [words[i] for i in np.flatnonzero(~dropped[bounds[j] : bounds[j + 1] - 1])]
        kept[k] = b" ".join(words)
    return runs, kept


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        rest = batch.schema.names[:-1]
        for a, b in in_steps(texts, STEP):
            runs, kept = search(texts[a:b])
            flat = [r for rows in runs for r in rows]
            numbers = np.array(flat, np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(3)], fields=list(RUN))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
            cols = [*[batch.column(c).slice(a, b - a) for c in rest], pa.ListArray.from_arrays(offsets, items), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, "runs", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All periodic runs of each text's words, and the text without their repeats: (key, runs, collapsed).

    ``runs`` holds (start, length, period) by start and period: stretches of words with smallest period p and at
    least max(12, 2 p) words that no neighbour extends. ``collapsed`` has the words that no run contains after
    its first period, joined by spaces. Words are separated by ASCII white space.

    Small periods are looked for one by one. Larger ones are proposed at scales of 8, 16, 32, ... words by pairs
    of equal contexts at positions of a synchronising set; stretches with a small period, where such a set has no
    positions, propose theirs through their neighbours. Each proposal is extended and checked, so the result is
    that of comparing all pairs of positions. Texts are searched in tasks and never move; a text has to fit into one.

    A null or empty text has no runs and collapses to an empty one. Rows with equal keys are each searched. An
    empty table gives no rows. Other columns are dropped.
    """
    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    found = chosen.mapInArrow(_detect, schema)
    return found.select(F.col("key").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))
