"""Periodic runs against a comparison of all pairs of positions."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from tidemill.llm import catalog, repeats

SF_DIR = "/root/testdata/sf0.001"


def brute(words):
    """Runs by definition: every period's maximal stretches, unless a smaller period covers them."""
    x = np.array([hash(w) for w in words])
    n, found = len(x), []
    for p in range(1, n // 2 + 1):
        same = np.concatenate([[False], x[:-p] == x[p:], [False]])
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for s, e in zip(edges[::2], edges[1::2] + p):
            if e - s >= max(12, 2 * p) and not any(p % q == 0 and a <= s and e <= a + m for a, m, q in found):
                found.append((int(s), int(e - s), p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def sequences(rng):
    """Random, Fibonacci, Thue-Morse and nested periodic sequences."""
    n, k = rng.randrange(300), rng.choice([1, 2, 2, 3, 30])
    yield [rng.randrange(k) for _ in range(n)]
    a, b = [0], [1]
    while len(b) < n:
        a, b = b, b + a
    yield b[:n]
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    yield t[:n]
    out = []
    u = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
    for _ in range(rng.randrange(1, 8)):
        out += (u * 60)[: rng.randrange(10, 90)] + [rng.randrange(3)] * rng.randrange(2)
    yield out
    v = [rng.randrange(2) for _ in range(rng.randrange(20, 150))] * rng.randrange(2, 5)
    v[rng.randrange(len(v))] = 7
    yield v


@pytest.mark.parametrize("seed", range(8))
def test_runs_match_all_pairs_of_positions(seed):
    rng = random.Random(seed)
    texts = [[str(x) for x in s] for _ in range(6) for s in sequences(rng)]
    runs, kept = repeats.search([" ".join(t).encode() for t in texts])
    for words, r, k in zip(texts, runs, kept):
        want = brute(words)
        assert r == want
        assert k.decode() == collapse(words, want)


def test_few_positions_are_chosen_and_none_is_missed():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50, 20_000)
    scale = 16
    compare = repeats.Comparer(words)
    at = repeats.synchronising(compare.levels[4], scale, np.zeros(len(words) + 1, bool))
    assert len(at) < 4 * len(words) / scale
    assert np.diff(at).max() <= scale


def test_unusual_rows(spark):
    long = " ".join(["a b c d e f g"] * 30_000)
    rows = [(1, None, "x"), (1, "", "x"), (None, "a " * 12, "y"), (2, "  \t\n", None), (3, long, "z"), (3, long, "z"), (4, "a " * 11, "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, `runs.collapsed` string").withColumnRenamed("runs.collapsed", "key")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in repeats.find_runs(df).collect()), key=str)
    one = (3, [(0, 210_000, 7)], "a b c d e f g")
    want = [(1, [], ""), (1, [], ""), (None, [(0, 12, 1)], "a"), (2, [], " "), one, one, (4, [], " ".join("a" * 11))]
    assert got == sorted(want, key=str)
    empty = repeats.find_runs(df.where("false"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "runs", "collapsed"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_the_query_matches_all_pairs_of_positions(spark):
    docs = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in catalog.QUERIES["op11_word_runs"](spark, SF_DIR).collect()}
    assert got.keys() == docs.keys()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, text in docs.items():
        words = [w.decode() for w in text.encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = brute(words)
        r = got[i]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs))
        assert r.collapsed_sha256 == sha(collapse(words, runs))
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert sum(r.n_runs > 0 for r in got.values()) > 5
