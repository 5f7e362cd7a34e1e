"""The registered queries over the smallest tables, against their SQL twins or plain rules."""

import hashlib
import os
import sys
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from tidemill.llm import catalog

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from check_oracle import TABLES, canon  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(catalog.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_toxicity_and_quality_cover_all_documents(spark, duck):
    ids = {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}
    toxic = catalog.QUERIES["op1_ftrl_toxicity"](spark, SF_DIR).toPandas()
    assert set(toxic.doc_id) == ids and len(toxic) == len(ids)
    assert (toxic.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in toxic.doc_id]).all()
    assert ((toxic.score >= 0.3) == (toxic.predicted == 1)).all() and toxic.score.between(0, 1).all()
    grades = catalog.QUERIES["op3_ordinal_quality"](spark, SF_DIR).toPandas()
    assert set(grades.doc_id) == ids and (grades.kept == (grades.tail_1 >= 0.5)).all()


def test_vectors_match_brute_force(spark, duck):
    import numpy as np

    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = {i: int((x @ v >= 0.95).sum()) - 1 for (i, _), v in zip(rows, x)}
    got = catalog.QUERIES["op5_vector_links"](spark, SF_DIR).toPandas()
    assert dict(zip(got.vec_id, got.n_links)) == links


def test_the_mix_comes_near_its_targets(spark):
    got = catalog.QUERIES["op8_pivotal_mix"](spark, SF_DIR).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    total = got["size"].sum()
    # sources with equal targets are told apart by their sizes
    by = got.groupby(["target", "source_size"]).agg(taken=("taken", "sum"), longest=("size", "max")).reset_index()
    assert abs(by.target.sum() - 1.5 * total) < 1e-3
    assert ((by.taken - by.target).abs() <= by.longest).all()


@pytest.fixture(scope="module")
def token_ids(duck):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(catalog.tokenizer_file())
    rows = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    return {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in rows}


def test_pieces_hold_all_ids(spark, token_ids):
    import numpy as np

    got = catalog.QUERIES["op7_open_windows"](spark, SF_DIR).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in token_ids.items()}
    for r in got.itertuples():
        piece = np.array(token_ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 1024 and fill.sum() / (1024 * len(fill)) > 0.9


def plain_stages(duck, spark):
    """Rows that the first three stages leave, by plain rules over the stages' own verdicts."""
    from tests.llm.test_duplicates import grams

    rows = {i: (t or "", s) for i, t, s in duck.execute("SELECT doc_id, text, source FROM documents").fetchall()}
    kept = {r.doc_id for r in catalog.QUERIES["op3_ordinal_quality"](spark, SF_DIR).where("kept").collect()}
    docs = spark.createDataFrame([(i, *rows[i]) for i in sorted(kept)], "doc_id long, text string, source string")
    kept = {r.doc_id for r in catalog.host_rules.judge_documents(docs).where("quality.kept").collect()}
    sets = {i: grams(rows[i][0]) for i in sorted(kept)}
    left, seen = set(), set()
    for i in sorted(kept):
        if i in seen:
            continue
        left.add(i)
        group = [i]
        while group:
            a = group.pop()
            seen.add(a)
            group += [b for b in kept - seen if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and not seen.add(b)]
    return left


def test_the_pipeline_matches_plain_rules(spark, duck, token_ids):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "n-gram Jaccard join", "mix", "pack"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut_lineage(stage(spark, docs, SF_DIR))
        if name != "pack":
            assert out.columns == columns
        after[name] = docs = out
    left = plain_stages(duck, spark)
    assert sorted(r.doc_id for r in after["n-gram Jaccard join"].select("doc_id").collect()) == sorted(left)
    mixed = after["mix"].groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert set(mixed.index) <= left and mixed.max() <= 2
    pieces = after["pack"].toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == {i: int(n) * len(token_ids[i]) for i, n in mixed.items()}
    run = corpus_pipeline.run(spark, SF_DIR).toPandas()
    key = lambda df: sorted(zip(df.doc_id, df.start, df.length, (hashlib.md5(bytes(x)).hexdigest() for x in df.ids)))
    assert key(run) == key(pieces)


def test_native_queries_run_without_python(spark):
    for name in ("op6_host_rules", "op10_feistel_shards"):
        plan = catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_cross_join_between_rows(spark, name):
    plan = catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_hosts_get_different_verdicts(spark):
    """Documents that fail a soft rule only: kept or not by what their host's rate is."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    judged = catalog.host_rules.judge_documents(docs).where("quality.soft_failed AND NOT quality.base_failed")
    by = {r[0]: r[1] for r in judged.groupBy("source").agg({"quality.kept": "max"}).collect()}
    assert set(by.values()) == {True, False}
    kept = {r.doc_id for r in catalog.QUERIES["op6_host_rules"](spark, SF_DIR).where("kept").collect()}
    assert kept & {r.doc_id for r in judged.collect()}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_take_unusual_tables(spark, tmp_path, stage):
    """Nulls in every column, repeated rows, an empty table, and columns named like those that stages make."""
    from pyspark.sql import functions as F

    name, run = stage
    few = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    long = few.limit(1).withColumn("text", F.repeat(F.lit("some words that go on "), 40_000))
    none = few.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema])
    odd = few.unionByName(few.limit(5)).unionByName(none).unionByName(none).unionByName(few.limit(3).withColumn("text", F.lit(""))).unionByName(long)
    extra = ["quality", "a.b", "row", "rate", "id", "key", "grade", "tail_1", "_metadata", "kept", "_0", "expected_grade"]
    for rows in (odd, odd.where("false")):
        path = str(tmp_path / f"t{rows.count()}")
        rows.withColumns({c: F.lit(c) for c in extra}).write.parquet(path)
        docs = spark.read.parquet(path)
        out = run(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        got = out.collect()
        assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}
        assert got or not docs.count() or name == "quality rules"
        assert all(r[c] == c for r in got for c in extra)
