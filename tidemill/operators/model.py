"""Regression job: imputation, encoding, deterministic split, random forest, evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, NumericType

from tidemill.functions.quantiles import exact_quantiles
from tidemill.operators.checks import drop_null_target, project_features
from tidemill.operators.columns import col, long_numeric, numeric_columns, string_columns
from tidemill.operators.profile import categorical_summary
from tidemill.plans.joins import join_null_safe
from tidemill.plans.session import cut_lineage, without_nan

SEED = 42
TEST_PERCENT = 20
TREES = 100
DEEPEST = 30  # the deepest tree Spark grows; stands for "no limit"
# Training rows in one partition, about; their number decides how rows are dealt out, not the machine.
PART_ROWS = 250_000
# Trees are grown on sums per feature vector if there are at most this many vectors, or this many rows to a vector.
FEW_VECTORS = 100_000
ROWS_A_VECTOR = 16
VECTOR_ROWS = 50_000  # sums in one partition, about
TREES_AT_ONCE = 16


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column: one driver value per column."""
    rows = categorical_summary(df.select(*[col(c) for c in columns])).collect()
    return {r["column_name"]: r["mode"] for r in rows if r["mode"] is not None}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    rows = exact_quantiles(long_numeric(df, columns), ["column_name"], "value", {"median": 0.5}).collect()
    return {r["column_name"]: r["median"] for r in rows}


@without_nan
def impute_mode(df: DataFrame, columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the most frequent value learned from ``source`` (default: the table itself)."""
    fill = modes(df if source is None else source, columns)
    return df.fillna(fill) if fill else df


@without_nan
def impute_median(df: DataFrame, columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the interpolated median; filled columns become double."""
    fill = medians(df if source is None else source, columns)
    out = df.withColumns({c: col(c).cast("double") for c in columns})
    return out.fillna(fill) if fill else out


def in_test_set(keys: list[str], percent: int = TEST_PERCENT, seed: int = SEED) -> Column:
    """A split that depends on the row's key only, not on how the data is partitioned."""
    text = F.concat_ws("|", F.lit(f"{seed}"), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100 < percent


def train_test_split(df: DataFrame, keys: list[str], percent: int = TEST_PERCENT, seed: int = SEED) -> DataFrame:
    return df.withColumn("is_test", in_test_set(keys, percent, seed))


def one_hot_stages(columns: list[str]) -> list:
    """Index and one-hot stages; a category unseen in training gets an all-zero vector."""
    indexed, vectors = [f"{c}__index" for c in columns], [f"{c}__hot" for c in columns]
    return [
        StringIndexer(inputCols=columns, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=vectors, dropLast=True),
    ]


def one_hot(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Add a ``<column>__hot`` vector per column, with categories learned from ``train``.

    The list of categories is part of the model, so it has to fit into the driver's memory.
    """
    encoded = Pipeline(stages=one_hot_stages(columns)).fit(train).transform(df)
    return encoded.drop(*[f"{c}__index" for c in columns])


def hot_slots(df: DataFrame, column: str) -> DataFrame:
    """The non-zero slots of a one-hot column as rows."""
    slots = F.posexplode(vector_to_array(F.col(f"{column}__hot"))).alias("slot", "on")
    return df.select("*", slots).where("on > 0").drop("on", f"{column}__hot")


@dataclass
class ForestResult:
    model: PipelineModel
    target: str
    features: list[str]
    used: list[str]
    configuration: dict
    predictions: DataFrame  # keys..., actual, predicted
    importances: DataFrame  # feature, importance
    evaluation: DataFrame  # r2, mse, rows

    def document(self, spark: SparkSession) -> DataFrame:
        """What was trained on what: one row (model, target, features, features_used, configuration)."""
        row = ("random_forest", self.target, self.features, self.used, {k: int(v) for k, v in self.configuration.items()})
        return spark.createDataFrame([row], "model string, target string, features array<string>, features_used array<string>, configuration map<string, int>")


@without_nan
def train_forest(
    df: DataFrame,
    target: str,
    keys: list[str],
    features: list[str] | None = None,
    n_estimators: int = TREES,
    max_depth: int | None = None,
) -> ForestResult:
    """Train on 80 % of the rows and evaluate on the rest.

    A row is told by its keys and all its values, so rows with equal keys are dealt out one by one (rows that are
    equal throughout together), and the forest is the same however the rows are stored. Rows without a target are left out. Strings are filled with their mode and one-hot encoded,
    numbers with their median; both are learned from the training rows only. Booleans are used
    as 0/1. Columns of other types are listed as features but not used.

    Where rows share few feature vectors, each tree is grown on its sample's sums per vector: a split's gain
    depends on numbers and sums of targets only, and a tree never parts equal vectors.
    """
    if not isinstance(df.schema[target].dataType, (NumericType, BooleanType)):
        raise ValueError(f"target {target!r} is not numeric")
    if max_depth is not None and max_depth > DEEPEST:
        raise ValueError(f"max_depth is at most {DEEPEST}")
    depth = DEEPEST if max_depth is None else max_depth  # the one used is the one reported
    features = [c for c in df.columns if c != target and c not in keys] if features is None else features
    wanted = list(dict.fromkeys(keys + features))
    data = drop_null_target(project_features(df, target, wanted), target)
    flags = [f.name for f in data.schema if isinstance(f.dataType, BooleanType)]
    data = data.withColumns({c: col(c).cast("int") for c in flags}) if flags else data
    identity = [*keys, *(c for c in wanted if c not in keys), target]
    data = train_test_split(data.withColumn(target, col(target).cast("double")), identity)
    # every later step reads the prepared rows several times, so they are written once
    data = cut_lineage(data)
    train, test = data.where(~F.col("is_test")), data.where("is_test")
    sizes_of = {r["is_test"]: r["count"] for r in data.groupBy("is_test").count().collect()}
    if len(sizes_of) < 2:
        raise ValueError("insufficient rows available for training and testing")
    chosen = data.select(*features)
    text, numbers = string_columns(chosen.schema), numeric_columns(chosen.schema)
    filled_train, filled_test = train, test
    if text:
        fill = modes(train, text)
        filled_train, filled_test = filled_train.fillna(fill), filled_test.fillna(fill)
    if numbers:
        fill = dict.fromkeys(numbers, 0.0) | medians(train, numbers)  # a column without any value is constant
        as_double = {c: col(c).cast("double") for c in numbers}
        filled_train = filled_train.withColumns(as_double).fillna(fill)
        filled_test = filled_test.withColumns(as_double).fillna(fill)
    columns = text + numbers
    sizes = cut_lineage(filled_train.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))
    vectors, rows = sizes.count(), sizes_of[False]
    if 2 * vectors <= rows and (vectors <= FEW_VECTORS or ROWS_A_VECTOR * vectors <= rows):
        sums = bootstrap_sums(filled_train, sizes, vectors, rows, columns, target, n_estimators)
        model, weights = grow_on_sums(sums, text, numbers, n_estimators, depth)
        scored = cut_lineage(model.transform(filled_test.select(*columns).distinct()).select(*columns, "predicted"))
        predictions = join_null_safe(filled_test, scored, columns).select(*keys, col(target).alias("actual"), "predicted")
    else:
        forest = RandomForestRegressor(labelCol=target, predictionCol="predicted", numTrees=n_estimators, maxDepth=depth, seed=SEED, featuresCol="features__vector")
        # a forest draws its samples by partition and place, so both follow from the rows alone
        parts = max(4, -(-rows // PART_ROWS))
        spread = filled_train.repartition(parts, *[col(k) for k in identity]).sortWithinPartitions(*[col(k) for k in identity])
        model = Pipeline(stages=[*vector_stages(text, numbers), forest]).fit(spread)
        weights = model.stages[-1].featureImportances.toArray()
        predictions = model.transform(filled_test).select(*keys, col(target).alias("actual"), "predicted")
    return ForestResult(
        model,
        target,
        features,
        columns,
        {"n_estimators": n_estimators, "max_depth": depth},
        predictions,
        fold_importances(data.sparkSession, weights, columns, slot_counts(model, text, numbers)),
        regression_metrics(predictions),
    )


def vector_stages(text: list[str], numbers: list[str]) -> list:
    assemble = VectorAssembler(inputCols=[f"{c}__hot" for c in text] + numbers, outputCol="features__vector")
    return (one_hot_stages(text) if text else []) + [assemble]


def poisson_draws(hashes: np.ndarray, trees: int) -> np.ndarray:
    """How often each tree's sample takes each row: Poisson numbers of mean 1 that depend on the row's hash only."""
    ends = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    z = hashes.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    uniform = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(ends, uniform, side="right").astype(float)


def bootstrap_sums(train: DataFrame, sizes: DataFrame, vectors: int, rows: int, columns: list[str], target: str, trees: int) -> DataFrame:
    """Every tree's bootstrap sample as sums per feature vector: ``(columns..., w0, y0, w1, y1, ...)``, rows taken and their mean target.

    A row is told by its vector, its target and, among equal ones, its number. A vector with very many rows is cut by target.
    """
    large = cut_lineage(sizes.where(F.col("n") > PART_ROWS).withColumn("pieces", F.ceil(F.col("n") / F.lit(PART_ROWS))).drop("n"))
    cut = join_null_safe(train, F.broadcast(large), columns, "left") if large.head(1) else train.withColumn("pieces", F.lit(1))
    names = [col(c) for c in columns]
    piece = F.pmod(F.xxhash64(col(target)), F.coalesce("pieces", F.lit(1))).alias("_piece")
    placed = cut.select(*names, col(target).alias("_y"), piece).repartition(max(4, -(-rows // PART_ROWS)), *names, "_piece")
    equal = placed.groupBy(*names, "_piece", "_y").agg(F.count(F.lit(1)).alias("_n"))
    one = equal.select(*names, "_y", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_k"))
    hashed = one.select(*names, "_y", F.xxhash64(*names).alias("_vector"), F.xxhash64(F.lit(SEED), *names, "_y", "_k").alias("_row"))
    ordered = hashed.sortWithinPartitions("_vector", *names, "_y", "_row")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vector, row, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_vector", "_row", "_y"))
            starts = np.flatnonzero(np.r_[True, vector[1:] != vector[:-1]])
            draws = poisson_draws(row, trees)
            sums = [np.add.reduceat(m, starts, axis=0) for m in (draws, draws * y[:, None])]
            found = batch.select([*columns, "_row"]).take(pa.array(starts))
            lists = [pa.ListArray.from_arrays(np.arange(0, m.size + 1, trees, dtype=np.int32), m.ravel()) for m in sums]
            yield pa.RecordBatch.from_arrays([*found.columns, *lists], names=[*columns, "_row", "w", "wy"])

    schema = ordered.select(*names, "_row").schema.add("w", ArrayType(DoubleType())).add("wy", ArrayType(DoubleType()))
    found = ordered.mapInArrow(add_up, schema)
    # a vector comes in several rows where it goes over the end of a batch or has several pieces
    total = lambda part: F.aggregate("runs", F.array_repeat(F.lit(0.0), trees), lambda acc, r: F.zip_with(acc, r[part], lambda a, b: a + b))
    whole = found.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_row", "w", "wy"))).alias("runs"))
    summed = whole.select(*names, total("w").alias("w"), total("wy").alias("wy")).repartition(-(-vectors // VECTOR_ROWS), *names)
    pairs = [e for t in range(trees) for e in (F.get("w", F.lit(t)).alias(f"w{t}"), F.try_divide(F.get("wy", F.lit(t)), F.get("w", F.lit(t))).alias(f"y{t}"))]
    return cut_lineage(summed.sortWithinPartitions(*names).select(*[F.struct(*names).alias("_x"), *pairs]))


def grow_on_sums(sums: DataFrame, text: list[str], numbers: list[str], trees: int, depth: int) -> tuple[PipelineModel, np.ndarray]:
    """A forest of trees that are each grown on their own sums, and the importance of each slot of the vector."""
    vectors = sums.select("_x.*", *[c for c in sums.columns if c != "_x"])
    encoder = Pipeline(stages=vector_stages(text, numbers)).fit(vectors)
    encoded = cut_lineage(encoder.transform(vectors).select("features__vector", *[c for c in sums.columns if c != "_x"]))

    def grow(t: int):
        sample = encoded.select("features__vector", F.col(f"w{t}").alias("taken"), F.col(f"y{t}").alias("mean")).where("taken > 0")
        tree = RandomForestRegressor(
            featuresCol="features__vector", labelCol="mean", weightCol="taken", predictionCol=f"tree__{t}", numTrees=1, bootstrap=False,
            featureSubsetStrategy="all" if trees == 1 else "onethird", maxDepth=depth, seed=SEED + t,
        )
        return tree.fit(sample)

    spark = sums.sparkSession
    with ThreadPool(min(trees, TREES_AT_ONCE, max(2, spark.sparkContext.defaultParallelism))) as pool:
        grown = pool.map(inheritable_thread_target(spark)(grow), range(trees), chunksize=1)
    mean = " + ".join(f"tree__{t}" for t in range(trees))
    average = SQLTransformer(statement=f"SELECT *, ({mean}) / {trees} AS predicted FROM __THIS__")
    shares = np.sum([tree.featureImportances.toArray() for tree in grown], axis=0)
    return PipelineModel([*encoder.stages, *grown, average]), shares / (shares.sum() or 1.0)


def slot_counts(model: PipelineModel, text: list[str], numbers: list[str]) -> list[int]:
    """Slots of the feature vector that each column has, in the order of the columns."""
    # the encoder leaves out the slot of unseen values
    return [n - 1 for n in (model.stages[1].categorySizes if text else [])] + [1] * len(numbers)


def fold_importances(spark: SparkSession, weights, columns: list[str], slots: list[int]) -> DataFrame:
    """Feature importances with the one-hot slots of a column added up (model-sized data)."""
    ends = np.cumsum(slots)
    parts = np.split(weights, ends[:-1]) if len(ends) else []
    return spark.createDataFrame([(c, float(p.sum())) for c, p in zip(columns, parts)], "feature string, importance double")


def regression_metrics(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """R squared and mean squared error; R squared is null when the actual values are constant."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    n = F.count(F.when(y.isNotNull() & p.isNotNull(), F.lit(1)))
    both = F.when(y.isNotNull() & p.isNotNull(), y)
    return predictions.agg(
        (F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(both) * n)).alias("r2"),
        F.avg((y - p) * (y - p)).alias("mse"),
        n.alias("rows"),
        F.min(both).alias("actual_min"),
        F.max(both).alias("actual_max"),
    )
