"""The two classifiers: what they learn, held-out accuracy and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import features, quality, toxicity
from tidemill.plans.session import cut_lineage


def corpus(n=400):
    rng = np.random.default_rng(5)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, int(rng.integers(20, 120))))
        toxic, junk = k % 4 == 0, k % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(int(rng.integers(0, len(text))), rng.choice(["nasty", "vile", "rotten"]))
        if junk:
            text = [w.upper() + "!!" for w in text]
        rows.append((k, " ".join(text)))
        labels.append((k, int(not junk), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    odd = [(9001, None), (9002, ""), (9003, "  \n "), (9004, "x " * 50_000), (None, "nasty vile rotten"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"toxicity": F.lit("old"), "grade": F.lit("old"), "order": F.lit(1)})
    extra = [(None, 1, 1), (9001, None, None), (7, 0, 1)]
    return cut_lineage(docs), spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int")


def test_toxicity_generalises(spark, tables):
    docs, labels = tables
    known = docs.where(~toxicity.held_out("doc_id")).select("doc_id", "text")
    model = toxicity.fit(known, labels.select("doc_id", F.col("toxic").alias("label")), "doc_id", "label")
    assert 0 < len(model.buckets) < 5000
    got = toxicity.score(docs, model).toPandas()
    assert len(got) == docs.count() and set(got.columns) == {"doc_id", "grade", "order", "toxicity"}
    assert got.toxicity.between(0, 1).all()
    scored = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id").toxicity
    out = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = [(scored[k] >= 0.3) == (k % 4 == 0) for k in out]
    assert np.mean(right) > 0.95
    assert scored[9001] == scored[9002] == scored[9003]


def test_toxicity_without_labels(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where("false").select("doc_id", F.col("toxic").alias("label")), "doc_id", "label")
    assert set(toxicity.score(docs, model).select("toxicity").distinct().toPandas().toxicity) == {0.5}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_a_step_of_the_learner_matches_the_formulas():
    s = toxicity.Settings(bits=4, passes=1, rounds=1)
    state = {"z": np.zeros(16), "n": np.zeros(16), "bias": np.zeros(2)}
    out = toxicity.learner(s)(state, np.array([1.0]), np.array([0, 2]), np.array([3, 5]), None)
    # the first score is one half, so each gradient is -1/2 and the weight before was 0
    assert np.allclose(out["z"][[3, 5]], -0.5) and np.allclose(out["n"][[3, 5]], 0.25) and out["z"].nonzero()[0].tolist() == [3, 5]
    assert np.allclose(toxicity.weights_of(np.array([-6.0, 3.0]), np.array([4.0, 4.0]), s), [2 / (3 / s.alpha + s.l2), 0.0])


def test_skip_grams_and_words_are_features():
    keys = lambda t: set(toxicity.buckets_of([t], 22)[0].tolist())
    assert len(keys(b"a b c")) == 3 + 3 + 2 + 1
    assert len(keys(b"a x c") & keys(b"a y c")) == 2 * 2 + 1
    assert keys(b"A, b.") == keys(b"a b")


def test_quality_selects_good_text(spark, tables):
    docs, labels = tables
    graded = quality.graded(labels)
    assert {r.grade for r in graded.collect()} == {0, 1, 2}
    model = quality.fit(docs.select("doc_id", "text"), graded, "doc_id", "grade", quality.Settings(rounds=3))
    assert (np.diff(model.theta) > 0).all()
    got = quality.grade(docs, model).toPandas()
    assert len(got) == docs.count() and got.expected_grade.between(0, 2).all() and (got.tail_1 >= got.tail_2).all()
    kept = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id").tail_1 >= quality.SELECT
    assert np.mean([kept[k] == (k % 5 != 0) for k in range(400)]) > 0.97
    assert quality.grade(docs.where("false"), model).count() == 0


def test_quality_without_grades(spark, tables):
    docs, labels = tables
    model = quality.fit(docs.select("doc_id", "text"), quality.graded(labels.where("false")), "doc_id", "grade")
    assert not model.weights.any() and (np.diff(model.theta) > 0).all()


def test_gradient_of_the_ordinal_loss():
    """One step goes down the numeric gradient of -log p in every parameter."""
    s = quality.Settings(bits=3, passes=1, rate=1e-4, decay=0.0)
    rng = np.random.default_rng(1)
    x, at = np.array([0.7, 0.2]), np.array([1, 4])

    def loss(w, cut, y):
        theta, t = quality.thresholds(cut), w[at] @ x
        upper = quality.sigmoid(np.append(theta, np.inf)[y] - t) if y < 2 else 1.0
        return -np.log(upper - (quality.sigmoid(theta[y - 1] - t) if y else 0.0))

    for y in range(3):
        w, cut = rng.normal(size=8), np.array([-0.3, 0.2])
        state = {"w": w.copy(), "g2": np.zeros(8), "cut": cut.copy(), "cut2": np.ones(2)}
        out = quality.learner(s)(state, np.array([float(y)]), np.array([0, 2]), at, x)
        slope = [(loss(w + d, cut, y) - loss(w - d, cut, y)) / 2e-6 for d in np.eye(8) * 1e-6]
        assert np.allclose(np.sqrt(out["g2"])[at], np.abs(np.array(slope)[at]), rtol=1e-4)
        assert (np.sign(w - out["w"])[at] == np.sign(slope)[at]).all()
        slope = np.array([(loss(w, cut + d, y) - loss(w, cut - d, y)) / 2e-6 for d in np.eye(2) * 1e-6])
        assert np.allclose(out["cut2"] - 1, slope**2, rtol=1e-3, atol=1e-9)


def test_the_sample_is_bounded_and_repeatable(spark, tables):
    docs, labels = tables
    graded = labels.select("doc_id", F.col("toxic").alias("grade"))
    once, again = (
        features.labelled_sample(docs.select("doc_id", "text").repartition(n), graded, "grade", "doc_id", 50).select("doc_id").toPandas().doc_id.tolist() for n in (2, 5)
    )
    assert len(set(once)) == 50 and sorted(once) == sorted(again)


def test_rare_features_are_counted_over_all_shards(spark, monkeypatch):
    """Words of eight toxic documents are learned, also where the eight stand in different shards."""
    monkeypatch.setattr(features, "SHARD_ROWS", 300)
    rng = np.random.default_rng(9)
    filler = [f"word{k}" for k in range(100)]
    rows = []
    for k in range(2400):
        text = list(rng.choice(filler, 20))
        rows.append((k, " ".join([*text, f"{k // 6 % 50:02d}rare"] if k % 6 == 0 else text), int(k % 6 == 0)))
    df = cut_lineage(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "label"), "doc_id", "label")
    weights = dict(zip(model.buckets.tolist(), model.weights))
    rare = [toxicity.buckets_of([f"{k:02d}rare".encode()], 22)[0] for k in range(50)]
    assert all(weights.get(b, 0) > 0 for found in rare for b in found.tolist())
