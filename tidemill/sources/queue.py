"""A queue of jobs in a folder, as a streaming source: entries are delivered until their batch is committed.

Each call of ``enqueue`` appends a folder of JSON files, and every file is an entry group that one task reads. A
streaming query takes them in order, a bounded number per batch. What a query has been given is pending until the query commits the
batch; the queue's own log says so. A query that stops between reading and committing gets the same groups again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemill.sources.files import file_system

FORMAT = "tidemill_queue"
ADMIT = 64  # entry groups per batch
SCHEMA = "entry string, id string, body string, enqueued_us long"


def _open(folder: str):
    found = file_system(folder)
    if found is None:
        raise ValueError(f"a queue can't be kept in {folder}")
    return found


def groups(folder: str) -> list[str]:
    """Entry groups in the order in which they were appended; folders that are still being written are left out."""
    from pyarrow import fs

    system, path = _open(folder)
    found = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/entries", recursive=True, allow_not_found=True)) if f.is_file]
    whole = {f.rsplit("/", 1)[0] for f in found if f.endswith("/_SUCCESS")}
    start = len(path) + len("/entries/")
    return sorted(f[start:] for f in found if f.endswith(".json") and f.rsplit("/", 1)[0] in whole)


def _log(folder: str, kind: str) -> dict:
    system, path = _open(folder)
    name = f"{path}/log/{kind}.json"
    if not system.get_file_info(name).is_file:
        return {"at": "", "us": 0}
    with system.open_input_stream(name) as f:
        return json.loads(f.read())


def _write_log(folder: str, kind: str, at: str) -> None:
    """The furthest group that was claimed or acknowledged; never goes back."""
    if at <= _log(folder, kind)["at"]:
        return
    system, path = _open(folder)
    system.create_dir(f"{path}/log", recursive=True)
    with system.open_output_stream(f"{path}/log/{kind}.tmp") as f:
        f.write(json.dumps({"at": at, "us": time.time_ns() // 1000}).encode())
    system.move(f"{path}/log/{kind}.tmp", f"{path}/log/{kind}.json")


class Group(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class QueueReader(DataSourceStreamReader):
    def __init__(self, folder: str, admit: int):
        self.folder, self.admit = folder, admit
        self.given = _log(folder, "acknowledged")["at"]

    def initialOffset(self) -> dict:
        return {"at": ""}

    def latestOffset(self) -> dict:
        """The end of the next batch: at most ``admit`` groups beyond those already given."""
        ahead = [g for g in groups(self.folder) if g > self.given]
        return {"at": ahead[: self.admit][-1] if ahead else self.given}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        self.given = max(self.given, end["at"])
        _write_log(self.folder, "claimed", end["at"])
        return [Group(g) for g in groups(self.folder) if start["at"] < g <= end["at"]]

    def read(self, partition: Group) -> Iterator[tuple]:
        system, path = _open(self.folder)
        with system.open_input_stream(f"{path}/entries/{partition.value}") as f:
            for number, line in enumerate(f.read().splitlines()):
                entry = json.loads(line)
                yield f"{partition.value}:{number}", entry.get("id"), entry.get("body"), entry.get("enqueued_us")

    def commit(self, end: dict) -> None:
        _write_log(self.folder, "acknowledged", end["at"])


class QueueSource(DataSource):
    """Options: ``path``, the queue's folder, and ``admit``, the entry groups that a batch takes at most."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options["path"], int(self.options.get("admit", ADMIT)))


def enqueue(entries: DataFrame, folder: str, files: int | None = None) -> None:
    """Append entries (id, body), both text, as one atomic folder of ``files`` groups."""
    now = time.time_ns()
    rows = entries.select(F.col("id").cast("string").alias("id"), F.col("body").cast("string").alias("body"), F.lit(now // 1000).alias("enqueued_us"))
    (rows.repartition(files) if files else rows).write.option("compression", "none").option("ignoreNullFields", "false").json(f"{folder}/entries/{now:020d}")


def read_queue(spark: SparkSession, folder: str, admit: int = ADMIT) -> DataFrame:
    """The queue as a stream of (entry, id, body, enqueued_us); ``entry`` names a delivery, the same one when it is repeated."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format(FORMAT).option("path", folder).option("admit", admit).load()


def queue_state(spark: SparkSession, folder: str) -> DataFrame:
    """Entries by state (waiting, pending, acknowledged): how many there are, and seconds since their groups were claimed.

    Pending ones have been given to a query that hasn't committed them yet.
    """
    claimed, done = _log(folder, "claimed"), _log(folder, "acknowledged")
    rows = spark.read.schema("id string, body string, enqueued_us long").json(f"{folder}/entries/*").select(F.col("_metadata.file_path").alias("file"))
    name = F.regexp_extract("file", "entries/(.*)$", 1)
    state = F.when(name <= done["at"], F.lit("acknowledged")).when(name <= claimed["at"], F.lit("pending")).otherwise(F.lit("waiting"))
    idle = (time.time_ns() // 1000 - claimed["us"]) / 1e6
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("entries")).withColumn("idle_seconds", F.when(F.col("state") == "pending", F.lit(idle)))
