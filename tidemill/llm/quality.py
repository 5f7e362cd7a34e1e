"""Quality grades: ordinal regression with cumulative links on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import features
from tidemill.llm.common import tidy

# Lower case for words; for shapes, letters become a or A, digits 0, bytes of other letters a.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))

# A document is selected if it is at least of grade 1 with this probability.
SELECT = 0.5


@dataclass(frozen=True)
class Settings:
    """Hash bits, step size, decay, and how long to learn; ``grades`` is the number of grades."""

    bits: int = 18
    grades: int = 3
    rate: float = 0.5
    decay: float = 1e-6
    passes: int = 3
    rounds: int = 4
    sample: int = features.LARGEST_SAMPLE


def sparse(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, buckets and values of some texts.

    Features are words, word shapes, neighbouring shapes and whether a word repeats the one before or one seen
    shortly before; a value is the square root of its share among the text's words, so length doesn't matter.
    """
    words, starts = features.split_all(texts, LOWER)
    shapes, _ = features.split_all(texts, SHAPE)
    n = np.diff(starts)
    text = np.repeat(np.arange(len(texts)), n)
    h = features.hash_words(words)
    form = features.hash_words([w[:1] + w[-2:] for w in shapes])
    long = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 24).astype(np.uint64)
    keys, owners = [features.spread(h, 0, bits), features.spread(form, 1, bits), features.spread(features.pair(long, long), 2, bits)], [text] * 3
    same = text[1:] == text[:-1]
    keys.append(features.spread(features.pair(form[:-1], form[1:]), 3, bits)[same])
    owners.append(text[1:][same])
    for gap in (1, 2, 3):
        again = (text[gap:] == text[:-gap]) & (h[gap:] == h[:-gap])
        keys.append(np.full(again.sum(), gap, np.int64))
        owners.append(text[gap:][again])
    both = np.concatenate(owners) << bits | np.concatenate(keys)
    found, count = np.unique(both, return_counts=True)
    owner = found >> bits
    value = np.sqrt(count / np.maximum(n, 1)[owner])
    return np.searchsorted(owner, np.arange(len(texts) + 1)), found & ((1 << bits) - 1), value


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def thresholds(cut: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free parameters: the first, then the logarithms of the gaps."""
    return np.cumsum(np.concatenate([cut[:1], np.exp(np.clip(cut[1:], -8, 8))]))


def learner(s: Settings):
    def learn(state: dict, grades: np.ndarray, starts: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> dict:
        """Adaptive gradient steps, one document at a time; weights are shared by all thresholds."""
        w, g2, cut, cut2 = state["w"], state["g2"], state["cut"], state["cut2"]
        for _ in range(s.passes):
            for k, y in enumerate(grades.astype(int)):
                at = buckets[starts[k] : starts[k + 1]]
                x = values[starts[k] : starts[k + 1]].astype(np.float64)
                t = w[at] @ x
                theta = thresholds(cut)
                below = sigmoid(np.append(theta, np.inf)[y] - t) if y < s.grades - 1 else 1.0
                above = sigmoid(theta[y - 1] - t) if y > 0 else 0.0
                p = max(below - above, 1e-9)
                d_below = below * (1 - below) if y < s.grades - 1 else 0.0
                d_above = above * (1 - above) if y > 0 else 0.0
                # gradients of -log p
                g = (d_below - d_above) / p * x + s.decay * w[at]
                g2[at] += g * g
                w[at] -= s.rate * g / np.sqrt(g2[at] + 1e-8)
                d_theta = np.zeros(len(theta))
                if y < s.grades - 1:
                    d_theta[y] -= d_below / p
                if y > 0:
                    d_theta[y - 1] += d_above / p
                d_cut = np.cumsum(d_theta[::-1])[::-1]
                d_cut[1:] *= np.exp(np.clip(cut[1:], -8, 8))
                cut2 += d_cut * d_cut
                cut -= s.rate * 0.2 * d_cut / np.sqrt(cut2 + 1e-8)
        return state

    return learn


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    theta: np.ndarray
    bits: int


def fit(docs: DataFrame, labels: DataFrame, key: str, grade: str, settings: Settings = Settings()) -> Model:
    """Learn from at most ``settings.sample`` documents (key, text) with a grade 0 .. grades - 1.

    Without graded documents all weights are 0 and the thresholds are evenly spaced around 0.
    """
    s = settings
    sample = features.labelled_sample(docs, labels, grade, key, s.sample)
    packed = features.pack_shards(sample, lambda t: features.joined(t, lambda x: sparse(x, s.bits)))
    size = s.grades - 1
    start = {"w": np.zeros(1 << s.bits), "g2": np.zeros(1 << s.bits), "cut": np.append(-(size - 1) / 2, np.zeros(size - 1)), "cut2": np.ones(size)}
    state = features.shard_rounds(packed, learner(s), start, 1 << s.bits, s.rounds)
    return Model(state["w"], thresholds(state["cut"]), s.bits)


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``expected_grade`` and ``tail_1``, ``tail_2``, ... (probability of that grade or better) for each whole text.

    Null and empty texts are graded by the thresholds alone. All rows and columns are kept but the text;
    columns that already have the new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    size = len(model.theta)
    names = [f"tail_{k + 1}" for k in range(size)]
    rest = [c for c in docs.columns if c not in (text, "text", "expected_grade", *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value

        def scores(texts: list[bytes]) -> list[np.ndarray]:
            starts, buckets, values = sparse(texts, m.bits)
            owner = np.repeat(np.arange(len(texts)), np.diff(starts))
            total = np.bincount(owner, weights=m.weights[buckets] * values, minlength=len(texts))
            tails = [1 - sigmoid(theta - total) for theta in m.theta]
            return [np.sum(tails, axis=0), *tails]

        yield from features.score_batches(batches, scores, ["expected_grade", *names])

    chosen = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("binary").alias("text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest], "expected_grade double", *[f"{n} double" for n in names]])
    return chosen.mapInArrow(tidy(run), schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 for bad text, 1 for good but toxic text, 2 for good text."""
    good, toxic = F.coalesce("quality", F.lit(0)) == 1, F.coalesce("toxic", F.lit(0)) == 1
    return labels.where(F.col("quality").isNotNull()).select("doc_id", F.when(~good, 0).when(toxic, 1).otherwise(2).alias("grade"))
