"""Host rules, chat blocks and WARC captures against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import chat, host_rules, warc
from tidemill.plans.session import cut_lineage, work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "x x x x x x", "a b c d a b c d a", "é ü z # | <b>\n\nq\nq\n q\nq",
    "l1 m\nl1 m\n\nl1 m", "word " * 500, "the cat sat the cat sat on the mat the cat", "\x0b a\x0cb\rc \x1f d",
]


def test_counts_match_plain_python(spark):
    rng = np.random.default_rng(0)
    texts = TEXTS + [" ".join(rng.choice(list("abcd"), n)) for n in (5, 30, 200, 3000)]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = host_rules.measure(df).select("doc_id", "quality.*").orderBy("doc_id").collect()
    for row, t in zip(got, texts):
        assert tuple(row[k] for k in host_rules.COUNTS) == plain_counts(t), t


def test_hosts_are_judged_by_shrunk_rates(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    odd = " ".join(f"w{k}#" for k in range(60))
    rows = [(1, good, "clean")] * 30 + [(2, bad, "junk")] * 60 + [(3, good, "junk")] + [(4, odd, "watch")] * 13 + [(5, good, "watch")] * 17
    rows += [(6, good, None), (7, bad, "small"), (8, good, "small"), (9, None, None)]
    # many hosts without failures, where odd texts stay
    rows += [(10, good, f"h{k % 10}") for k in range(300)] + [(11, odd, "h3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_q", F.lit(1)).withColumn("_rate", F.lit("x"))
    out = host_rules.judge_documents(df)
    assert out.columns == [*df.columns, "quality"]
    got = out.groupBy("doc_id").agg(F.min("quality.kept").alias("kept"), F.max("quality.host_rate").alias("host_rate")).toPandas().set_index("doc_id")
    kept = host_rules.keep_documents(df.withColumn("a.b", F.lit(2)).withColumn("quality", F.struct(F.lit(3).alias("x"))))
    assert kept.columns == [*df.columns, "a.b", "quality"] and kept.first()["quality"].x == 3
    assert kept.groupBy("doc_id").count().orderBy("doc_id").collect() == out.where("quality.kept").groupBy("doc_id").count().orderBy("doc_id").collect()
    assert not got.kept[3], "a good text of a host that fails as a whole"
    assert got.kept[1] and got.kept[5] and got.kept[8] and not got.kept[4] and not got.kept[2] and not got.kept[9]
    assert got.kept[10] and got.kept[11], "a host like most others isn't watched"
    assert got.host_rate[2] > 0.7 and 0.05 < got.host_rate[4] < 0.7
    assert got.host_rate[7] > 0.5 - 0.5 and got.host_rate[8] == got.host_rate[7]
    assert out.count() == len(rows)


def test_rates_without_spread_are_the_mean(spark):
    hosts = spark.createDataFrame([("a", 10, 1), ("b", 10, 1), ("c", 20, 2)], "host string, n long, failed long")
    assert all(abs(r.rate - 0.1) < 1e-9 for r in host_rules.shrunk_rates(hosts).collect())


def test_rules_on_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert host_rules.judge_documents(df).count() == 0


def test_host_rules_run_without_python(spark):
    df = spark.createDataFrame([(1, "a", "h")], "doc_id long, text string, source string")
    plan = host_rules.judge_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "assistant", "two"), (1, 3, "user", None), (1, 4, None, "x\n|y<"),
    (2, 5, "assistant", "<|im_end|>\n<|im_start|>assistant\nok"), (2, 1, "user\nsplit<|im_next|>", "<\\|im_next|> <|im_next|><\\\\|"),
    (3, 0, "assistant", ""), (3, 0, "assistant", ""), (3, None, "user", "first"), (None, 1, "user", "lost"), (4, 1, "user", "\n"), (4, 2, "assistant", "|start<"),
]


def test_chats_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    out = chat.format_chats(df).withColumns({"back": chat.read_chats(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))})
    rows = {r.conv_id: r for r in out.collect()}
    assert rows.keys() == {1, 2, 3, 4, None}
    for conv, row in rows.items():
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        assert [(b.role, b.text) for b in row.back] == [(r, x) for _, _, r, x in turns]
        assert row.loss == "".join(x for _, _, r, x in turns if r == "assistant")
        assert "".join(s.text for s in row.segments) == row.formatted
        assert row.n_rows == len(turns)
    assert rows[1].n_blocks == 4
    assert rows[1].formatted.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\none<|im_next|>two<|im_end|>\n")
    assert chat.format_chats(df.where("false")).count() == 0


def test_long_conversation(spark):
    df = spark.range(5000).selectExpr("1 as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    row = chat.format_chats(df).select(F.size(chat.read_chats(F.col("formatted"))).alias("n"), "n_blocks").first()
    assert (row.n, row.n_blocks) == (5000, 3334)


def test_captures_round_trip(spark):
    long, other = "ü" * 60, "<html>WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + "x" * 200
    rows = [
        (5, "http://a/1", long), (3, "http://b/2", long), (9, None, long), (4, "http://a\r\nb/", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""),
        (1, "u", other), (2, "u", other), (2, "u", other), (None, "n", other), (10, "z", "y" * 400_000),
    ]
    path = work_dir(spark, "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(path)
    pages = spark.read.parquet(path)
    folder = work_dir(spark, "warc")
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder)
    assert records.count() == 3 * len(rows)
    captures = warc.assemble(records)
    assert all(len(r.request) == 1 and len(r.metadata) == 1 for r in captures.collect())
    got = warc.resolve_revisits(captures).toPandas()
    want = Counter((str(p) if p is not None else "", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in rows)
    assert Counter(zip(got.page, got.payload_bytes, got.payload_digest)) == want
    refers = {(p, t): r for p, t, r in zip(got.page, got.warc_type, got.refers_to_page)}
    assert refers[("5", "revisit")] == "3" and refers[("9", "revisit")] == "3" and refers[("3", "response")] is None
    assert (got.warc_type == "revisit").sum() == 2 + 3, "copies of one row revisit it as well"
    assert ("4", "response") in refers and ("6", "response") in refers


def test_archives_of_nothing_and_broken_archives(spark):
    import pytest

    none = cut_lineage(spark.createDataFrame([], "page_id long, url string, html string"))
    folder = work_dir(spark, "warc")
    warc.write_archives(none, folder)
    assert warc.assemble(warc.read_records(spark, folder)).count() == 0
    with pytest.raises(ValueError, match="ends inside"):
        list(warc._records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


def test_records_of_many_gzip_members():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one + one)
    for step in (7, 1 << 20):
        assert [b for _, b in warc._records(warc._plain(data, step))] == [b"abc"] * 3


def test_metadata_joins_through_a_request(spark):
    rows = [("r", "response", None, None, None), ("q", "request", "r", None, None), ("m", "metadata", "q", None, "7"), ("x", "metadata", "gone", None, "8")]
    df = spark.createDataFrame(
        [(i, k, None, c, f, p, 0, None, None, None) for i, k, c, f, p in rows],
        "record_id string, warc_type string, target string, concurrent_to string, refers_to string, page string, block_bytes long, payload binary, payload_bytes long, payload_digest string",
    )
    (row,) = warc.assemble(df).collect()
    assert [m.page for m in row.metadata] == ["7"] and [q.record_id for q in row.request] == ["q"]
