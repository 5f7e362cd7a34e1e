"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from tidemill.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(search.UPPER, search.UPPER.lower())


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, items, k):
    """(item, rank, key, score) by scoring every document; items are (id, text), docs (key, text)."""
    counts = [(key, Counter(split(t))) for key, t in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(split(text))
    out = []
    for item, ts in wanted.items():
        scored = []
        for key, c, n in counts:
            m = 50 + (50 * n * n_docs) // total
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, key is None, key))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r[0], r[1], r[2], r[3]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("k", "block", "shard"), [(1, 4, 7), (5, 128, 50), (3, 2, 1000)])
def test_ranking_matches_scores_of_all_documents(spark, monkeypatch, k, block, shard):
    rng = random.Random(k)
    vocabulary = [f"W{j}" for j in range(60)] + ["émile", "Ünder9"]
    weights = [1 / (j + 1) for j in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))) for i in range(300)]
    docs += [(1000 + i, "w0 " * (300 + i) + "w59") for i in range(3)]
    items = [(i, ", ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(25)]

    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    got = search.search(table, spark.createDataFrame(items, "item_id long, text string"), k)
    assert found(got) == ranking(docs, items, k)


def test_small_shards_and_blocks_give_the_same(monkeypatch):
    """One heap over many shards with tiny blocks: the same best as one list of all scores; blocks are left out."""
    import numpy as np

    rng = np.random.default_rng(5)
    monkeypatch.setattr(search, "BLOCK", 4)
    decoded = []
    plain = search.Lists.decode
    monkeypatch.setattr(search.Lists, "decode", lambda self, blocks: decoded.append(len(blocks)) or plain(self, blocks))
    terms, total_docs = 12, 900
    share = np.linspace(0.9, 0.02, terms)
    has = rng.random((total_docs, terms)) < share
    tf = np.where(has, rng.integers(1, 700, (total_docs, terms)) * (rng.random((total_docs, terms)) < 0.1) + 1, 0) * has
    norm = rng.integers(50, 90_000, total_docs)
    weights = rng.integers(0, 5000, terms)
    query = np.arange(terms)
    impact = np.where(tf > 0, search.SCALE * tf // np.maximum(1, 1000 * tf + 20 * norm[:, None]), 0)
    score = (impact * weights).sum(1)
    heap, blocks = search.Heap(10), 0
    for a in range(0, total_docs, 90):
        doc, term = np.nonzero(tf[a : a + 90])
        lists = search.Lists(term, doc, tf[a : a + 90][doc, term], norm[a : a + 90])
        blocks += len(lists.start)
        search.best_of(lists, query, weights, heap, np.arange(a, a + 90), np.zeros(90, bool))
    order = np.lexsort((np.arange(total_docs), -score))[:10]
    assert heap.keys.tolist() == order.tolist() and heap.scores.tolist() == score[order].tolist()
    assert sum(decoded) < blocks


def test_slices_of_queries_give_the_same(spark, monkeypatch):
    docs = [(i, f"common t{i % 7} t{i % 3} rest{i}") for i in range(40)]
    items = [(i, f"t{i} common") for i in range(7)]
    monkeypatch.setattr(search, "SLICE_TERMS", 4)
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert found(got) == ranking(docs, items, 4)


def test_unusual_rows(spark):
    long = "Alpha " * 200_000 + "beta"
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, None), (3, ""), (4, "--- !"), (5, long), (None, None), (6, "gamma")]
    items = [(1, "ALPHA, alpha"), (1, "beta"), (None, "gamma"), (2, None), (3, ""), (4, "nowhere")]
    d = spark.createDataFrame([(*r, "x", 0.5) for r in docs], "doc_id long, text string, number string, score double")
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, rank string")
    got = search.search(d, q)
    assert found(got) == ranking(docs, items, 50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(d.where("false"), q).collect() == []
    assert search.search(d, q.where("false")).collect() == []
    assert search.search(d.where("text is null"), q).collect() == []
