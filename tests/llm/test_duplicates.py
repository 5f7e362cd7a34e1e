"""Near-duplicate vectors and texts against brute force."""

import collections
import itertools
from pathlib import Path

import numpy as np
import pytest

from tidemill.llm import common, mixing, shingles, vectors
from tidemill.plans.session import cut_lineage, shared_dir


def plain_components(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("hub", [256, 20, 1])
def test_components_of_pairs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 480)] + [(500, 500 + k) for k in range(60)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = plain_components(600, links)
    used = {x for p in links for x in p if p[0] != p[1]}
    assert got == {x: label[x] for x in used}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_of_links():
    rng = np.random.default_rng(3)
    links = rng.integers(0, 200, (150, 2))
    assert common.forest(links[:, 0], links[:, 1], 200).tolist() == plain_components(200, links.tolist())
    assert common.forest(np.zeros(0, int), np.zeros(0, int), 3).tolist() == [0, 1, 2]


def cosine_links(rows, least=0.95):
    good = [(i, np.array(v, float) / max(map(abs, v))) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for x, (i, a) in enumerate(good):
        for j, b in good[:x]:
            if len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= least:
                out.append((i, j))
    return out


@pytest.mark.parametrize("tile", [4096, 16])
def test_vectors_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 40))
    points = [list(map(float, b + rng.normal(size=40) * s)) for b in base for s in (0, 0.1, 0.25, 0.33)]
    odd = [None, [], [0.0] * 40, [None] * 40, [float("nan")] * 40, [float("inf")] + [1.0] * 39, [1.0, 0.0], [2.0, 0.0], [1e-200, 0.0], points[5], points[5], [-0.0] * 40]
    rows = [(i, v) for i, v in enumerate(points + odd)] + [(0, points[9]), (None, points[9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as key", "3 as unit").repartition(3)
    got = vectors.link_vectors(df).toPandas()
    links = cosine_links(rows)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    label = plain_components(len(rows), links)
    ids = [i for i, _ in rows]
    lowest = {r: min((ids[k] for k in range(len(rows)) if label[k] == r and ids[k] is not None), default=None) for r in set(label)}
    want = sorted((str(ids[k]), int(degree[k]), str(lowest[label[k]]), ids[k] == lowest[label[k]]) for k in range(len(rows)))
    text = lambda x: "None" if x is None or x != x else str(int(x))
    assert sorted((text(a), int(b), text(c), bool(d)) for a, b, c, d in zip(got.vec_id, got.n_links, got.component_id, got.kept)) == want


def test_no_vectors(spark):
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = vectors.link_vectors(spark.createDataFrame([(4, None), (5, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in one) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(1)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(300, 64)), rng.normal(size=(200, 64))))
    b[:50] = a[:50] + rng.normal(size=(50, 64)) * 0.03
    b /= np.linalg.norm(b, axis=1)[:, None]
    found = {(int(i), int(j)) for x, y in vectors.compare(a, b, 0.9) for i, j in zip(x, y)}
    assert found == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.9))))


def vector_rows(rng, n=400, dim=24):
    """Directions in a few bunches with near and exact copies, as float values."""
    middle = rng.normal(size=(12, dim)) * 2
    points = middle[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.2, 0.8, 1.5], (n, 1))
    points[::40] = points[7]
    return [(k, list(map(float, v.astype(np.float32)))) for k, v in enumerate(points)]


def test_vectors_around_many_pivots_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 64)
    monkeypatch.setattr(vectors, "MEMBERS", 5)
    rows = vector_rows(np.random.default_rng(6))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    links = cosine_links(rows)
    degree, label = np.bincount(np.array(links).ravel(), minlength=len(rows)), plain_components(len(rows), links)
    assert len(links) > 500 and got == {k: (degree[k], min(j for j in range(len(rows)) if label[j] == label[k])) for k in range(len(rows))}


def test_linking_vectors_takes_little_disk(spark, monkeypatch, tmp_path):
    """Stored tables stay below three times the input and go when they are done with; many tiles meet without a copy of the vectors."""
    monkeypatch.setattr(vectors, "TILE", 256)
    rng = np.random.default_rng(9)
    spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(rng.normal(size=(3000, 64)))], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "in"))
    size = lambda d: sum(f.stat().st_size for f in Path(d).rglob("*.parquet"))
    shared = shared_dir(spark)
    before, stored, plans = size(shared), [], []

    def seen(table):
        out = cut_lineage(table)
        stored.append(size(shared) - before)
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(vectors, "cut_lineage", seen)
    assert vectors.link_vectors(spark.read.parquet(str(tmp_path / "in"))).count() == 3000
    assert max(stored) < 3 * size(tmp_path / "in")
    assert size(shared) - before < size(tmp_path / "in"), "no copy of the vectors is left"
    meeting = [p for p in plans if "CartesianProduct" in p]
    assert len(meeting) == 1 and "Exchange" not in meeting[0]


def test_cones_never_lose_a_pair():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(rng.normal(size=(500, 16)))
    b = unit(np.concatenate([a[:200] + rng.normal(size=(200, 16)) * 0.06, rng.normal(size=(300, 16))]))
    pivots = a[rng.choice(500, 40, False)]

    def side(x):
        cosines = x @ pivots.T
        cell, angle = cosines.argmax(1), np.arccos(np.clip(cosines.max(1), -1, 1))
        order = np.argsort(angle)
        out = vectors.Side(x[order])
        out.cell, out.angle = cell[order], angle[order].astype(np.float32)
        return out

    a, b = side(a), side(b)
    want = set(zip(*(x.tolist() for x in np.nonzero(a.unit @ b.unit.T >= 0.95))))
    found, compared = [], 0
    for x, y, turned in ((a, b, False), (b, a, True)):
        blocks = list(vectors.cones(x, y, pivots.astype(np.float32), 0.95))
        compared += sum(len(rows) * len(at) for rows, at in blocks)
        for i, j in vectors.compare(x, y, 0.95, blocks):
            first = x.angle[i] <= y.angle[j] if turned else x.angle[i] < y.angle[j]
            found += list(zip(*((j[first].tolist(), i[first].tolist()) if turned else (i[first].tolist(), j[first].tolist()))))
    assert len(want) > 100 and set(found) == want and len(found) == len(want)
    assert compared < 500 * 500, "less than half, seen from both sides"


def grams(text, width=5):
    words = (text or "").encode().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def near_copies(rng, n):
    vocabulary = [f"w{k}" for k in range(2000)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(30, 150))))
        texts.append(" ".join(words))
        for edits in (0, 1, 1, 2, 4):
            copy = list(words)
            for _ in range(edits):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(vocabulary))
            texts.append("  ".join(copy) if edits == 0 else " ".join(copy))
    return texts


@pytest.mark.parametrize("tile", [1024, 3])
def test_texts_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(shingles, "TILE_TEXTS", tile)
    rng = np.random.default_rng(4)
    texts = near_copies(rng, 25) + [None, "", " \n", "one two", "one two", "one\ntwo", "two one", "a b c d e", "a b c d e f", "x " * 3000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "quite another text with the same number as one before it"), (None, texts[0])]
    df = cut_lineage(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as node", "'k' as key", "4 as id").repartition(3))
    got = shingles.link_texts(df).toPandas()
    sets = [grams(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    label = plain_components(len(rows), links)
    ids = [i for i, _ in rows]
    lowest = {r: min((ids[k] for k in range(len(rows)) if label[k] == r and ids[k] is not None), default=None) for r in set(label)}
    text = lambda x: "None" if x is None or x != x else str(int(x))
    want = sorted((text(ids[k]), int(degree[k]), text(lowest[label[k]])) for k in range(len(rows)))
    assert sorted((text(a), int(b), text(c)) for a, b, c in zip(got.doc_id, got.n_links, got.class_id)) == want
    assert got.kept.sum() == len(set(label)), "one row of each class stays"
    kept = shingles.one_per_class(df)
    assert kept.columns == df.columns and kept.count() == len(set(label))


def test_no_texts(spark):
    none = cut_lineage(spark.createDataFrame([], "doc_id long, text string"))
    assert shingles.link_texts(none).count() == 0
    blank = cut_lineage(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in shingles.link_texts(blank).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_bands_follow_from_the_recall():
    for least, recall in ((0.8, 0.9999), (0.8, 0.9), (0.5, 0.95)):
        bands, rows = shingles.choose_bands(least, recall)
        assert bands * rows <= 128 and 1 - (1 - least**rows) ** bands >= recall
        assert (rows + 1) * np.log(1 - recall) / np.log(1 - least ** (rows + 1)) > 128 - (rows + 1)
    with pytest.raises(ValueError):
        shingles.choose_bands(0.01, 0.999999)


def test_jaccard_of_tiles():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, int(rng.integers(1, 40))).astype(np.uint64)) for _ in range(30)]
    first, second = np.arange(12), np.arange(12, 30)
    got = set(zip(*(x.tolist() for x in shingles.jaccard_links(sets, first, second, 0.4))))
    assert got == {(i, j) for i in first for j in second if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))}


def test_rows_stay_the_same_when_scans_are_cut_differently(spark, monkeypatch):
    """Each write is followed by another plan for scans, as when executors come or go between two jobs."""
    rng = np.random.default_rng(8)
    texts = near_copies(rng, 25)
    df = cut_lineage(spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(40))
    want_links = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in shingles.link_texts(df).collect()}
    plan = {r.doc_id: r.copies for r in mixing.plan_copies(df).collect()}
    size = "spark.sql.files.maxPartitionBytes"
    before, turn = spark.conf.get(size), itertools.cycle(["1k", "1g"])

    def shifting(table):
        out = cut_lineage(table)
        spark.conf.set(size, next(turn))
        return out

    for module in (common, shingles, mixing):
        monkeypatch.setattr(module, "cut_lineage", shifting)
    try:
        links = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in shingles.link_texts(df).collect()}
        kept = sorted(r.doc_id for r in shingles.one_per_class(df).collect())
        mixed = collections.Counter(r.doc_id for r in mixing.mix(df).collect())
    finally:
        spark.conf.set(size, before)
    assert links == want_links
    assert kept == sorted(k for k, v in want_links.items() if v[2])
    assert mixed == {k: n for k, n in plan.items() if n}
