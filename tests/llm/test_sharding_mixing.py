"""Feistel shards and the pivotal mix: exact laws, brute force and odd inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing, sharding
from tidemill.plans.session import cut_lineage

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.mark.parametrize("total", [1, 2, 3, 5, 17, 100, 1000])
def test_permutation_and_its_inverse(spark, total):
    from pyspark.sql import functions as F

    rows = spark.range(total).select("id", sharding.permute(F.col("id"), total, 3).alias("p"))
    rows = rows.withColumn("back", sharding.permute(F.col("p"), total, 3, back=True)).toPandas()
    assert sorted(rows.p) == list(range(total))
    assert (rows.back == rows.id).all()


def test_shards_are_even_gapless_and_repeatable(spark):
    df = spark.range(1003).selectExpr("id", "cast(id % 7 as string) as slot", "'x' as shard", "id as _number", "id as _place")
    first, second = (sharding.shard_rows(df.repartition(n), ["id"], 24).toPandas() for n in (3, 5))
    assert set(first.columns) == {"id", "shard", "slot", "_number", "_place"}
    sizes = first.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in first.groupby("shard"))
    assert first.set_index("id")[["shard", "slot"]].sort_index().equals(second.set_index("id")[["shard", "slot"]].sort_index())


def test_a_slot_leads_back_to_its_row(spark):
    from pyspark.sql import functions as F

    out = sharding.shard_rows(spark.range(500), ["id"], 7, seed=2)
    back = out.select("id", sharding.row_at(F.col("shard"), F.col("slot"), 500, 7, seed=2).alias("n")).toPandas()
    assert (back.id == back.n).all()


def test_shards_with_nulls_repeats_and_no_rows(spark):
    rows = [(None, "a"), (1, "b"), (1, "b"), (1, "b"), (None, None)] + [(5, "c")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_rows(df, ["doc_id"], 4).toPandas()
    assert len(out) == 45 and out.groupby("shard").size().max() == 12
    assert sharding.shard_rows(df.where("false"), ["doc_id"], 4).count() == 0
    assert sharding.shard_rows(df.limit(1), ["doc_id"], 4).count() == 1


def brute_targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    names = sorted([k for k in sizes if k is not None]) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    budget, capped = sum(sizes.values()) * 1.5, {}
    while True:
        free = [k for k in names if k not in capped]
        left = budget - sum(capped.values())
        share = {k: left * w[k] / sum(w[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 2 * sizes[k]]
        if not over:
            return {**capped, **share}
        capped |= {k: 2.0 * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 30, None: 60}, {"a": 5}, {"é": 100, "z": 1, "B": 0, "a": 7}])
def test_targets_match_the_rule(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_pivot_keeps_the_sum_and_expectations():
    rng = np.random.default_rng(0)
    part = rng.uniform(0.05, 0.95, 9)
    total = np.zeros(9)
    for _ in range(4000):
        out = mixing.pivot(part, rng.uniform(size=9))
        assert abs(out.sum() - part.sum()) < 1e-6
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        total += out
    assert np.abs(total / 4000 - part).max() < 0.04


def corpus(spark, tmp_path, n=900):
    rng = np.random.default_rng(1)
    rows = [(int(k), " ".join(["w"] * int(rng.integers(1, 60))), ["s0", "s1", "s2", None][min(3, int(rng.integers(0, 8)))]) for k in range(n)]
    rows += [(7, "same words here", "s0")] * 50 + [(None, None, "s1"), (None, "", None), (3, " \n ", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path = str(tmp_path / "docs")
    df.selectExpr("*", "1 as row", "2 as size", "3 as copies").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_mix_comes_near_targets_and_reruns_agree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 32)  # several levels of the tree
    docs = corpus(spark, tmp_path)
    plan = mixing.plan_copies(docs).toPandas()
    assert len(plan) == docs.count()
    assert plan.copies.between(0, 2).all()
    by = plan.assign(taken=plan.copies * plan["size"], source=plan.source.fillna("~")).groupby("source").agg(
        taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), longest=("size", "max")
    )
    assert ((by.taken - by.target).abs() <= 2 * by.longest.clip(lower=1)).all()
    again = mixing.plan_copies(docs).toPandas()
    agree = lambda p: sorted(zip(p.doc_id.fillna(-1), p.source.fillna("~"), p["size"], p.copies))
    assert agree(plan) == agree(again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == plan.copies.sum()


def test_the_mix_is_the_same_however_rows_are_stored(spark, tmp_path, monkeypatch):
    """A key with very many rows, equal ones and others, in one file and in five."""
    monkeypatch.setattr(mixing, "GROUP", 32)
    rows = [(5, "w " * (k % 4), "a" if k % 3 else "b") for k in range(600)] + [(k, "v " * (k % 9), "c") for k in range(100)] + [(None, "u u", None)] * 80
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plans = []
    for n, order in ((1, F.col("doc_id")), (5, F.xxhash64("text", "doc_id")), (3, F.rand(2))):
        path = str(tmp_path / f"docs{n}")
        df.orderBy(order).repartition(n).write.parquet(path)
        plan = mixing.plan_copies(spark.read.parquet(path), stored=True).toPandas()
        plans.append(sorted(zip(plan.doc_id.fillna(-1), plan.source.fillna("~"), plan["size"], plan.copies)))
    assert plans[0] == plans[1] == plans[2]


def test_mix_of_nothing(spark):
    docs = cut_lineage(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert mixing.plan_copies(docs).count() == 0
    blank = cut_lineage(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string"))
    assert [r.copies for r in mixing.plan_copies(blank).collect()] == [0, 0]
    assert isinstance(mixing.mix(blank).toPandas(), pd.DataFrame)
