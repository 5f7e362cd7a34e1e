"""Image files in, result files out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

from tidemill.functions.scalars import json_number
from tidemill.operators.columns import col
from tidemill.plans.session import cut_lineage

IMAGE_GLOB = "*.{jpg,jpeg,png,webp,gif,JPG,JPEG,PNG,WEBP,GIF}"


def read_images(spark: SparkSession, path: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """``(path, modificationTime, length, content)`` of every image below a folder.

    Spark's file scan leaves empty files out, so those never reach the inventory.
    """
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )


# Bytes of a file that tell its type and size.
HEAD_BYTES = 64 << 10
# Bytes of files in one batch, about.
HELD_BYTES = 8 << 20
# Files that one task opens, entries of a folder in one batch and folders that one task lists, about.
OPENED = 4_000
LISTED = 10_000
FOLDERS = 32


def file_system(folder: str):
    """File system and path of a folder, by its scheme; None if only Spark can open it."""
    from pyarrow import ArrowInvalid, fs

    if "://" not in folder or folder.startswith("file:"):
        place = folder.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + place.lstrip("/") if place.startswith("/") else place
    # Spark's paths aren't encoded as addresses are, so only the store's own part is read as one
    scheme, _, rest = folder.partition("://")
    store, slash, place = rest.partition("/")
    try:
        system, base = fs.FileSystem.from_uri(f"{scheme}://{store}/")
    except (ArrowInvalid, OSError):
        return None
    return system, base.rstrip("/") + slash + place


def read_heads(spark: SparkSession, path: str, glob: str = IMAGE_GLOB, most: int = HEAD_BYTES) -> DataFrame:
    """``(path, length, content)`` of every file below a folder, with the first ``most`` bytes as content.

    Tasks list the folders, open each file and read no more than its beginning. Where only Spark reaches the
    files, they are read whole and cut.
    """
    listed = list_files(spark, path, glob)
    if listed is None:
        whole = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        return whole.select("path", "length", F.substring("content", 1, most).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, heads, held, start = batch.column("path").to_pylist(), [], 0, 0
            for k, name in enumerate(names):
                system, place = file_system(name)
                with system.open_input_file(place) as f:
                    heads.append(f.read(most))
                held += len(heads[-1])
                if held > HELD_BYTES or k == len(names) - 1:
                    part = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary())], names=["path", "length", "content"])
                    heads, held, start = [], 0, k + 1

    return listed.mapInArrow(run, "path string, length long, content binary")


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame | None:
    """``(path, length)`` of the files below a folder that Spark's file scan would read; None if tasks can't list it.

    Folders are listed in tasks, level by level, so neither the driver nor a plan holds the names, and the number of tasks
    follows the number of files. A folder's own entries are listed by one task.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place) or not store.getFileStatus(place).isDirectory():
        return None
    root = store.makeQualified(place).toString()
    if file_system(path) is None or file_system(root) is None:
        return None
    wanted = _glob_pattern(glob)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("path").to_pylist():
                system, base = file_system(folder)
                found = system.get_file_info(fs.FileSelector(base))
                for start in range(0, len(found), LISTED):
                    rows = []
                    for f in found[start : start + LISTED]:
                        inner = f.type == fs.FileType.Directory
                        if not _hidden(f.base_name, inner) and (inner or f.size and wanted.fullmatch(f.base_name)):
                            rows.append((f"{folder.rstrip('/')}/{f.base_name}", f.size or 0, inner))
                    columns = list(zip(*rows)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()))], names=["path", "length", "folder"]
                    )

    level, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        found = cut_lineage(level.mapInArrow(entries, "path string, length long, folder boolean"))
        part = found.where("not folder").select("path", "length")
        files = part if files is None else files.unionByName(part)
        folders = found.where("folder").select("path")
        n = folders.count()
        if not n:
            return files.repartition(max(1, -(-files.count() // OPENED)))
        level = folders.repartition(-(-n // FOLDERS))


def _hidden(name: str, inner: bool) -> bool:
    """Names of files, or of folders (``inner``), that Spark's file scan passes over."""
    if inner and name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _glob_pattern(glob: str) -> re.Pattern:
    """A file name pattern with ``*``, ``?``, ``[...]`` and ``{...,...}`` as a regular expression."""
    out, depth = "", 0
    for part in re.findall(r"\\.|\[[^]]+\]|.", glob):
        if part in "{}":
            depth += 1 if part == "{" else -1
            out += "(?:" if part == "{" else ")"
        elif part == "," and depth:
            out += "|"
        elif part in "*?":
            out += ".*" if part == "*" else "."
        elif part[0] == "[" and len(part) > 1:
            out += "[" + part[1:].replace("!", "^", 1) if part[1] == "!" else part
        else:
            out += re.escape(part[-1])
    return re.compile(out, re.DOTALL)


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows (name, content) as files of their own; a task that is repeated writes the same files again.

    A name may have folders in it, which are made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        made = set()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                folder_of = f"{base}/{name}".rpartition("/")[0]
                if folder_of not in made:
                    system.create_dir(folder_of, recursive=True)
                    made.add(folder_of)
                with system.open_output_stream(f"{base}/{name}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    if file_system(folder) is None:
        raise ValueError(f"files can't be written to {folder}")
    files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become null, also inside arrays, maps and structs."""

    def clean(c, t):
        if isinstance(t, (DoubleType, FloatType)):
            return json_number(c)
        if isinstance(t, ArrayType) and _has_floats(t):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, MapType) and _has_floats(t):
            return F.transform_values(c, lambda k, v: clean(v, t.valueType))
        if isinstance(t, StructType) and _has_floats(t):
            inner = F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in t])
            return F.when(c.isNotNull(), inner)
        return c

    return df.select(*[clean(col(f.name), f.dataType).alias(f.name) for f in df.schema])


def _has_floats(t) -> bool:
    if isinstance(t, ArrayType):
        return _has_floats(t.elementType)
    if isinstance(t, MapType):
        return _has_floats(t.valueType)
    if isinstance(t, StructType):
        return any(_has_floats(f.dataType) for f in t)
    return isinstance(t, (DoubleType, FloatType))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row; missing values are written as explicit nulls."""
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_artifacts(df: DataFrame, path: str, job_id: str, buckets: int = 256) -> None:
    """Results of many jobs as Parquet in a fixed number of folders, each sorted by job.

    One folder per job would mean millions of tiny files; inside a bucket the sort lets readers
    skip to one job through the file statistics. A folder's name holds the number of buckets, so
    a reader needn't know it.
    """
    (
        df.withColumn("job_bucket", _bucket(col(job_id), F.lit(buckets)))
        .repartitionByRange("job_bucket", job_id)
        .sortWithinPartitions("job_bucket", job_id)
        .write.mode("overwrite")
        .partitionBy("job_bucket")
        .parquet(path)
    )


def _bucket(key: Column, buckets: Column) -> Column:
    return F.concat(buckets.cast("string"), F.lit("-"), F.pmod(F.xxhash64(key), buckets).cast("string"))


def read_artifacts(spark: SparkSession, path: str, job_id: str, wanted=None) -> DataFrame:
    """All results, or those of one job or of a list of jobs (only their buckets are read)."""
    df = spark.read.parquet(path)
    if wanted is None:
        return df.drop("job_bucket")
    keys = [F.lit(k).cast(df.schema[job_id].dataType) for k in (wanted if isinstance(wanted, (list, tuple, set)) else [wanted])]
    # depends on the folder's name only, so other folders are not opened
    there = F.split_part(F.col("job_bucket"), F.lit("-"), F.lit(1)).cast("int")
    return df.where(F.col("job_bucket").isin([_bucket(k, there) for k in keys]) & col(job_id).isin(keys)).drop("job_bucket")


def find_artifacts(spark: SparkSession, path: str, wanted: DataFrame, job_id: str) -> DataFrame:
    """Results of the jobs in a table: joined on bucket and id, so folders without any of them are left out at run time."""
    df = spark.read.parquet(path)
    key = col(job_id).cast(df.schema[job_id].dataType)
    # the folders' names hold the number of buckets, one for each way the results were written
    counts = df.select(F.split_part(F.col("job_bucket"), F.lit("-"), F.lit(1)).cast("int").alias("buckets")).distinct()
    buckets = F.array(*[F.lit(r["buckets"]) for r in counts.collect()]).cast("array<int>")
    keys = wanted.select(key.alias(job_id)).where(col(job_id).isNotNull()).distinct()
    placed = keys.withColumn("buckets", F.explode(buckets)).select(job_id, _bucket(col(job_id), F.col("buckets")).alias("job_bucket"))
    return df.join(placed, ["job_bucket", job_id], "left_semi").drop("job_bucket")
