"""Toxicity scores: logistic regression on hashed word n-grams and skip-grams, fitted by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import features
from tidemill.llm.common import tidy
from tidemill.plans.session import cut_lineage

# ASCII letters in lower case, punctuation as white space; other bytes stay.
TABLE = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256))

# Bytes of a word's stem, 8 at most.
STEM = 5


@dataclass(frozen=True)
class Settings:
    """Hash bits, learning rates and penalties; ``least`` documents of the whole sample must have a
    feature that is learned, however large the sample or its shards are."""

    bits: int = 22
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    passes: int = 2
    rounds: int = 4
    least: int = 2
    sample: int = features.LARGEST_SAMPLE


def buckets_of(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word pairs and pairs with one word between, and the text of each, unordered.

    Words count twice, as they are and cut to their first bytes: rare forms of a word share what is learned.
    """
    words, starts = features.split_all(texts, TABLE)
    h = features.hash_words(words)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    stems = np.array(words, dtype=f"S{STEM}").astype("S8").view(np.uint64)
    keys, owners = [features.spread(h, 0, bits), features.spread(stems * features.STRIDE, 3, bits)], [text, text]
    for gap in (1, 2):
        same = text[gap:] == text[:-gap]
        keys.append(features.spread(features.pair(h[:-gap], h[gap:]), gap, bits)[same])
        owners.append(text[gap:][same])
    return np.concatenate(keys), np.concatenate(owners)


def featuriser(bits: int, common: Broadcast):
    def featurise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct buckets per text, of those that ``common`` has (packed bits), numbered without the others."""
        known = np.unpackbits(common.value).view(bool)
        rank = np.cumsum(known, dtype=np.int32) - np.int32(1)
        found = [np.zeros(0, np.int64)]
        for a, b in features.in_steps(texts, features.STEP_WORDS * 6):
            keys, owners = buckets_of(texts[a:b], bits)
            enough = known[keys]
            found.append(np.unique((owners[enough] + a) << bits | keys[enough]))
        both = np.concatenate(found)
        starts = np.searchsorted(both >> bits, np.arange(len(texts) + 1))
        return starts, rank[both & ((1 << bits) - 1)], np.zeros(0, np.float32)

    return featurise


def weights_of(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """The proximal weights: zero up to the L1 limit, then with a rate per coordinate."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def learner(s: Settings):
    def learn(state: dict, grades: np.ndarray, starts: np.ndarray, buckets: np.ndarray, _: np.ndarray) -> dict:
        """Documents one after the other, each updating the coordinates that it has."""
        z, n, b = state["z"], state["n"], state["bias"]
        for _ in range(s.passes):
            for k, y in enumerate(grades):
                at = buckets[starts[k] : starts[k + 1]]
                zi, ni = z[at], n[at]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + root) / s.alpha + s.l2))
                bias = -b[0] / ((s.beta + np.sqrt(b[1])) / s.alpha)
                g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
                z[at] = zi + g - (np.sqrt(ni + g * g) - root) / s.alpha * w
                n[at] = ni + g * g
                b[0] += g - (np.sqrt(b[1] + g * g) - np.sqrt(b[1])) / s.alpha * bias
                b[1] += g * g
        return state

    return learn


@dataclass(frozen=True)
class Model:
    """Non-zero weights by bucket; their number is bounded by the number of buckets."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def fit(docs: DataFrame, labels: DataFrame, key: str, label: str, settings: Settings = Settings()) -> Model:
    """Learn from at most ``settings.sample`` labelled documents (key, text).

    Each shard of the sample runs FTRL over its documents; states are averaged between rounds. Without any
    labelled document the model has no weights and scores everything 0.5.
    """
    s = settings
    sample = cut_lineage(features.labelled_sample(docs, labels, label, key, s.sample))
    common = sample.sparkSession.sparkContext.broadcast(features.common_buckets(sample, lambda t: buckets_of(t, s.bits), s.bits, s.least))
    packed = features.pack_shards(sample, featuriser(s.bits, common))
    learned = np.flatnonzero(np.unpackbits(common.value, count=1 << s.bits)).astype(np.int32)
    size = max(3, len(learned))  # not as few as the bias has
    state = features.shard_rounds(packed, learner(s), {"z": np.zeros(size), "n": np.zeros(size), "bias": np.zeros(2)}, size, s.rounds)
    w = weights_of(state["z"].astype(np.float64), state["n"].astype(np.float64), s)
    kept = np.flatnonzero(w)
    z0, n0 = state["bias"]
    return Model(learned[kept], w[kept], float(-z0 / ((s.beta + np.sqrt(n0)) / s.alpha)), s.bits)


def scores(texts: list[bytes], dense: np.ndarray, bias: float, bits: int) -> np.ndarray:
    keys, owners = buckets_of(texts, bits)
    w = dense[keys]
    hit = np.flatnonzero(w)
    # a feature counts once per text
    both = np.unique(owners[hit] << bits | keys[hit])
    total = np.bincount(both >> bits, weights=dense[both & ((1 << bits) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``toxicity`` (0 to 1) for each whole text; null and empty texts get the bias alone.

    All rows and columns are kept but the text, which the score replaces; a column ``toxicity`` is replaced too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, "toxicity", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = np.zeros(1 << m.bits)
        dense[m.buckets] = m.weights
        yield from features.score_batches(batches, lambda t: [scores(t, dense, m.bias, m.bits)], ["toxicity"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("binary").alias("text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest], "toxicity double"])
    return chosen.mapInArrow(tidy(run), schema)


def held_out(key: str):
    """Every fourth key by its hash is never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2
