"""The trained models on documents they haven't learned from."""

import os

import pytest
from pyspark.sql import functions as F

from tidemill.llm import catalog, quality, toxicity
from tidemill.llm.common import table

SF_DIR = "/root/testdata/sf0.1"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_toxicity_of_held_out_documents(spark):
    scored = catalog.QUERIES["op1_ftrl_toxicity"](spark, SF_DIR).where("held_out")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = scored.join(labels, "doc_id").groupBy("toxic", "predicted").count().toPandas().set_index(["toxic", "predicted"])["count"]
    hit, wrong, missed = got.get((1, 1), 0), got.get((0, 1), 0), got.get((1, 0), 0)
    print("precision", hit / (hit + wrong), "recall", hit / (hit + missed))
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.8


def test_grades_of_held_out_documents(spark):
    """Learned from three of four labelled documents; the cut at one half tells good text from bad on the others."""
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    grades = quality.graded(table(spark, SF_DIR, "labels")).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    held = toxicity.held_out("doc_id")
    model = quality.fit(docs, grades.where(~held), "doc_id", "grade")
    rows = quality.grade(docs.where(held), model).join(grades, "doc_id").toPandas()
    good = rows.grade > 0
    kept = rows.tail_1 >= quality.SELECT
    print("rows", len(rows), "kept of good", kept[good].mean(), "kept of bad", kept[~good].mean(), "mean grades", rows.groupby("grade").expected_grade.mean().to_dict())
    assert kept[good].mean() > 0.95 and kept[~good].mean() < 0.2
    means = rows.groupby("grade").expected_grade.mean()
    assert means.is_monotonic_increasing and (rows.tail_1 >= rows.tail_2).all()
