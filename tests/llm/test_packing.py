"""Packing: exact ids, gapless sequences and little padding."""

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import packing
from tidemill.llm.catalog import tokenizer_file
from tidemill.plans.session import cut_lineage


@pytest.fixture(scope="module")
def content():
    return tokenizer_file()


def plain_ids(content, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "one two\nthree", "it's 3,5 don't!!", "é ü x y", "tab\tx\r\ny", "<|endoftext|> x", "a<|endoftext|>b c", "<|endoftext|", "a <|endoftext|> <|endoftext|>",
    "\x01 a b", "x\x1cy z", "a\u0085b c", "ñandú ção 漢字 かな 🙂 ok", "word " * 50, "  lead", "trail \n", "no\nspace\nlines", "a ,b . c", "​ z", "A'll 'll",
]


def split(ids, ends):
    return [x.tolist() for x in np.split(ids, ends)[: len(ends)]]


def test_ids_are_the_tokenizer_s(content):
    words = packing.WordIds(content)
    encode = lambda texts: split(*words(pa.array(texts, pa.string())))
    rng = np.random.default_rng(0)
    alphabet = list("ab,. \n\t'1é") + ["  ", "\r\n", "!!", "ing", "'s"]
    texts = TEXTS + ["".join(rng.choice(alphabet, int(rng.integers(1, 60)))) for _ in range(500)]
    for _ in range(2):
        assert encode(texts) == plain_ids(content, texts)
    assert encode(texts[::-1]) == plain_ids(content, texts[::-1])
    assert encode([]) == [] and encode([""]) == [[]] and encode(["<|endoftext|> x"]) == [[50256, 2124]]


def test_forgetting_keeps_ids_right(content, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = packing.WordIds(content)
    texts = [f"some words {k} here and there {k * k}" for k in range(40)]
    for _ in range(3):
        assert split(*words(pa.array(texts))) == plain_ids(content, texts)


def checked(rows, texts, content, length):
    """Each id in exactly one piece, sequences gapless and short enough; the share of padding."""
    want = {k: [*ids, 0] for k, ids in zip(texts, plain_ids(content, texts.values()))}
    got: dict = {k: [] for k in texts}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(got[r.doc_id]) == r.start and r.length * 4 == len(r.ids) and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert got == want
    sizes: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert sizes.get(r.sequence_id, 0) == r.offset
        sizes[r.sequence_id] = r.offset + r.length
    assert max(sizes.values()) <= length
    return 1 - sum(sizes.values()) / (length * len(sizes))


@pytest.mark.parametrize("parts", [1, 20])
def test_pieces_cover_all_documents(spark, content, parts, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 4)
    rng = np.random.default_rng(1)
    texts = {k: " ".join(["lorem ipsum"] * int(rng.integers(0, 200))) for k in range(400)} | {1000: "long " * 5000, 1001: "", 1002: "fits " * 126}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as key", "2 as part", "3 as ids").repartition(parts)
    rows = packing.pack(cut_lineage(df).repartition(parts), content, length=128).collect()
    assert checked(rows, texts, content, 128) < 0.05


def test_odd_tables(spark, content):
    rows = [(1, None), (1, None), (None, "a b"), (2, "")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), content).collect()
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in out) == [(0, 3, 3), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert sorted(r.offset for r in out)[0] == 0 and len({(r.sequence_id, r.offset) for r in out}) == 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for none in (spark.createDataFrame([], docs.schema), docs.where("false"), docs.limit(0), cut_lineage(docs.where("false"))):
        assert packing.pack(none, content).count() == 0


def test_best_fit_and_fullest_first():
    w = packing.Windows(10)
    assert w.place(6, "a") is None
    w.start(6, "a"), w.start(3, "b")
    assert w.place(4, "c") == 0, "fills the first window exactly"
    assert w.place(8, "d") is None and w.place(2, "e") == -1
    w.start(8, "f")
    assert w.fullest() == 2
