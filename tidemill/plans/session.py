"""Session settings, the shared work folder and table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Runtime (session-level) settings every job relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot join keys are split at run time, also where that costs an extra shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# A group above this many rows is never handed to one task as a whole.
GROUP_ROWS_KEY = "tidemill.groupRows"
GROUP_ROWS = 1_000_000

# A route problem is solved inside one task up to this many distance cells (8 bytes each, some copies of that).
ROUTE_CELLS_KEY = "tidemill.routeCells"
ROUTE_CELLS = 25_000_000

# A side of a join is broadcast by hint only up to this many rows.
BROADCAST_ROWS_KEY = "tidemill.broadcastRows"
BROADCAST_ROWS = 100_000


def build_session(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, for code that runs in Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemill_shipped", None) != sc.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / package.name
        sc.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))
        sc._tidemill_shipped = sc.applicationId
    return spark


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(GROUP_ROWS)))


def route_cells(spark: SparkSession) -> int:
    return int(spark.conf.get(ROUTE_CELLS_KEY, str(ROUTE_CELLS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_KEY, str(BROADCAST_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a fresh folder of its own; a cluster
    session without it is refused, since no machine-local folder would survive there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder or the folder of the current run."""
    base = _run_folders[-1] if _run_folders else shared_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex}"


_run_folders: list[str] = []


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside are deleted at the end, so results have to be written by then."""
    folder = work_dir(spark, "run")
    _run_folders.append(folder)
    try:
        yield folder
    finally:
        _run_folders.remove(folder)
        delete_folder(spark, folder)


def in_run_folder(run: Callable) -> Callable:
    """For end-to-end runs, whose first argument is the session."""

    @wraps(run)
    def wrapped(spark: SparkSession, *args, **kwargs):
        with run_folder(tune(spark)):
            return run(spark, *args, **kwargs)

    return wrapped


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder, once, and go on from there.

    Survives the loss of executors, and later jobs read the table instead of redoing the work.
    """
    spark = df.sparkSession
    path = work_dir(spark, "step")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def drop_stored(table: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` gave, once nothing will read it again."""
    delete_folder(table.sparkSession, table._stored_at)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hint_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count was measured, dropped when it is too large."""
    return F.broadcast(df) if rows <= broadcast_rows(df.sparkSession) else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means "missing" in this library, so it becomes null when data enters."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    if not floats:
        return df
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*[F.when(~F.isnan(name(c)), name(c)).alias(c) if c in floats else name(c) for c in df.columns])


def without_nan(operator: Callable) -> Callable:
    """For operators over a table that users pass in: they see null where it has NaN."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        if not getattr(df, "_nan_free", False):
            df = nan_to_null(df)
            df._nan_free = True  # an operator that hands the table on needn't look again
        return operator(df, *args, **kwargs)

    return run
