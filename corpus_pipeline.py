"""From raw documents to packed sequences: the stages in order, each reading what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import host_rules, mixing, packing, quality, shingles
from tidemill.llm.catalog import tokenizer_file
from tidemill.llm.common import fresh_name, table
from tidemill.plans.session import cut_lineage

# All stages take ``docs`` as a table read from Parquet files (others are written first) with the columns of documents
# and possibly more, under any names. Nulls are allowed in every column; rows are judged one by one, so repeated rows and keys
# stay unless a stage removes copies. An empty table gives an empty one. A whole text has to fit into a task.


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good text with a probability of at least one half, by the classifier learned from the labels.

    The model is learned from the labelled ones of ``docs``; without any, every text has the probability that the
    thresholds give and all are kept or none. A null or empty text is judged by the thresholds alone. Texts are read and judged in one
    pass; nothing is joined.
    """
    labels = quality.graded(table(spark, sf_dir, "labels"))
    model = quality.fit(docs.select("doc_id", "text"), labels, "doc_id", "grade")
    # all columns under names that the scores can't clash with
    names = [f"_{k}" for k in range(len(docs.columns))]
    aside = docs.toDF(*names)
    graded = quality.grade(aside.withColumn("text", F.col(names[docs.columns.index("text")])), model)
    return graded.where(F.col("tail_1") >= quality.SELECT).select(*names).toDF(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their host's verdict. Null texts fail; a null source is a host of its own."""
    return host_rules.keep_documents(docs, stored=True)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, nulls last.

    Texts without words are each kept; of rows with equal doc_id and text one is kept.
    """
    return shingles.one_per_class(docs, stored=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most twice; a null source is a source, texts without words are left out."""
    return mixing.mix(docs, stored=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of bounded length, piece by piece; see ``packing.pack``. Each row is packed, repeated ones too."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_file())


STAGES = [("quality classifier", grade), ("quality rules", rules), ("n-gram Jaccard join", deduplicate), ("mix", mix), ("pack", pack)]

# The trained model, the rounding draws and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
