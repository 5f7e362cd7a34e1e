"""Running streaming jobs over file sources and reading back what they wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.session import tune, work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A time after all data; one row carrying it closes every open window of a finite stream.
END_OF_STREAM = "2200-01-01 00:00:00"


def table_stream(spark: SparkSession, sf_dir: str, table: str, time_column: str, files_per_batch: int | None = None, **options) -> DataFrame:
    """A Parquet table, one file or a folder of many, as a file stream with its time column ready for watermarks.

    ``files_per_batch`` bounds a micro-batch; without it, one batch takes all files that are there.
    """
    tune(spark)
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    for k, v in options.items():
        reader = reader.option(k, v)
    # a stream reads folders; a single file is found in its own by its name
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        reader, path = reader.option("pathGlobFilter", f"{table}.parquet"), sf_dir
    return reader.parquet(path).withColumn(time_column, F.col(time_column).cast("timestamp"))


def replay_delay(spark: SparkSession, sf_dir: str, table: str, time_column: str, least: str = "10 minutes") -> str:
    """A watermark delay with which a finished table can be replayed in any order of its files.

    Nothing is known about that order, so it is the time the table spans. For a live stream, use the delay
    of its source instead.
    """
    ts = F.col(time_column).cast("timestamp")
    span = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").agg((F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("s")).first()["s"]
    return f"{span + 1} seconds" if span else least


@contextmanager
def state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """A state-store provider for the queries started inside; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider is not None:
        spark.conf.set(key, provider)
    try:
        yield
    finally:
        if provider is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class ClosingSource:
    """A second source that stays empty until the data has been read and then ends the stream."""

    def __init__(self, like: DataFrame, time_column: str):
        self.spark = like.sparkSession
        self.path = work_dir(self.spark, "closing")
        self.time_column = time_column
        self.schema = like.schema
        self._rows(0).write.parquet(self.path)

    def _rows(self, n: int) -> DataFrame:
        one = self.spark.range(n)
        return one.select(
            *[
                (F.lit(END_OF_STREAM) if f.name == self.time_column else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self.schema
            ]
        )

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def close(self) -> None:
        self._rows(1).write.mode("append").parquet(self.path)


def run_append(result: DataFrame, label: str, closing: ClosingSource | None = None, provider: str | None = None, rounds: int = 1) -> DataFrame:
    """Run an append-mode query over what is available now; return the table it wrote.

    A source that admits a bounded batch per run takes several ``rounds``. With a closing source the query runs a second time from its checkpoint, so windows that
    were still open are completed too.
    """
    spark = result.sparkSession
    out, checkpoint = work_dir(spark, f"{label}-out"), work_dir(spark, f"{label}-state")

    def once() -> None:
        with state_store(spark, provider):
            query = (
                result.writeStream.format("parquet")
                .option("path", out)
                .option("checkpointLocation", checkpoint)
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
        query.awaitTermination()

    for _ in range(rounds):
        once()
    if closing is not None:
        closing.close()
        once()
    return spark.read.schema(result.schema).parquet(out)


def keyed_overwrite(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for ``foreachBatch`` that may be repeated: each batch owns one folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_update(
    result: DataFrame, label: str, keys: list[str], closing: ClosingSource | None = None, provider: str | None = None
) -> DataFrame:
    """Run an update-mode query over what is available now; return the newest row of every key."""
    spark = result.sparkSession
    out, checkpoint = work_dir(spark, f"{label}-out"), work_dir(spark, f"{label}-state")

    def once() -> None:
        with state_store(spark, provider):
            query = (
                result.writeStream.foreachBatch(keyed_overwrite(out))
                .option("checkpointLocation", checkpoint)
                .outputMode("update")
                .trigger(availableNow=True)
                .start()
            )
        query.awaitTermination()

    once()
    if closing is not None:
        closing.close()
        once()
    written = spark.read.schema(result.schema.add("batch", "long")).option("basePath", out).parquet(out)
    return newest_per_key(written, keys)


def newest_per_key(written: DataFrame, keys: list[str], version: str = "batch") -> DataFrame:
    rest = [c for c in written.columns if c not in keys and c != version]
    return (
        written.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )
