"""CSV input: typed scan, structural check, locations."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemill.functions.scalars import finite_number, hhmm_minutes, null_token_to_null, strip, whole_number
from tidemill.operators.columns import col
from tidemill.plans.session import cut_lineage, hint_small
from tidemill.sources import csv_splits

BROKEN = "_broken_line"
# The columns of a locations file.
LOCATION_COLUMNS = ["id", "name", "demand", "priority", "window_start", "window_end"]


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line; reads no more than that."""
    return spark.read.option("header", True).csv(path).columns


def repeated_names(names: list[str]) -> list[str]:
    """Names that occur more than once, as they stand in the header."""
    return sorted({n for n in names if names.count(n) > 1})


def header_cells(spark: SparkSession, path: str) -> list[str]:
    """The header's cells as they stand in the file, repeated ones included."""
    return [c or "" for c in spark.read.option("header", False).option("multiLine", True).csv(path).first() or []]


def read_text_cells(
    spark: SparkSession, path: str, names: list[str] | None = None, quoted_breaks: bool = True, whole_bytes: int | None = None, **options
) -> DataFrame:
    """All cells as strings, plus the raw text of records that do not fit the columns.

    Column names come from the header line, unless ``names`` says that there is none. With
    ``quoted_breaks`` a quoted cell may hold line breaks; files of more than ``whole_bytes`` (one scan partition) are then
    read in parts, see ``csv_splits``, and smaller ones by a task each. Without, every line is a record and an open quote is told
    from the lines after it.
    """
    has_header = names is None
    names = header(spark, path) if has_header else names
    schema = StructType([StructField(n, StringType()) for n in names] + [StructField(BROKEN, StringType())])
    if quoted_breaks and csv_splits.size_of_largest(spark, path) > (csv_splits.part_bytes(spark) if whole_bytes is None else whole_bytes):
        return _cells_of_parts(spark, path, schema, has_header, options)
    reader = (
        spark.read.schema(schema)
        .option("header", has_header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .option("escape", '"')
        .option("multiLine", quoted_breaks)
        # a pruned parser would not notice lines that are too short or too long
        .option("columnPruning", False)
    )
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def _cells_of_parts(spark: SparkSession, path: str, schema: StructType, has_header: bool, options: dict) -> DataFrame:
    """The same cells from records that many tasks have read."""
    found = csv_splits.records(spark, path, options.get("sep", options.get("delimiter", ",")))
    wanted = F.col("record") > (1 if has_header else 0)
    parser = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "nullValue": "\u0000", "emptyValue": "", "escape": '"', "multiLine": "true"}
    types = ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema)
    # no text on the header, since checks of the cells may be moved before it is left out
    text = F.when(wanted, F.col("text"))
    cells = F.from_csv(text, types, parser | {k: str(v) for k, v in options.items()})
    names = [f.name for f in schema if f.name != BROKEN]
    read = found.where(wanted).select(text.alias("text"), "sound", cells.alias("cells"))
    broken = F.when(F.col("sound"), F.col("cells").getField(BROKEN)).otherwise(F.col("text"))
    return read.select(*[F.col("cells").getField(n).alias(n) for n in names], broken.alias(BROKEN))


def broken_lines(spark: SparkSession, path: str, names: list[str] | None = None, quoted_breaks: bool = True, **options) -> DataFrame:
    """Records with too few or too many fields or an open quote. No rows: the file is sound."""
    cells = read_text_cells(spark, path, names, quoted_breaks, **options)
    # Spark refuses to read the broken-line column alone, so the line also refers to a cell
    nothing = F.substring(F.coalesce(col(cells.columns[0]), F.lit("")), 1, 0)
    return cells.select(F.concat(F.col(BROKEN), nothing).alias("line")).where("line is not null")


def _readings(c: Column) -> dict[str, Column]:
    return {
        "boolean": F.when(c.isin("True", "TRUE", "true"), F.lit(True)).when(c.isin("False", "FALSE", "false"), F.lit(False)),
        "bigint": whole_number(c),
        "double": F.coalesce(finite_number(c), F.when(F.lower(strip(c)).rlike("^[+-]?inf(inity)?$"), c.try_cast("double"))),
    }


def infer_types(cells: DataFrame) -> dict[str, str]:
    """The narrowest of boolean, bigint, double, string that fits every cell; one aggregate.

    True and False with gaps between them stay text, so they are profiled as categories.
    """
    names = [c for c in cells.columns if c != BROKEN]
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(names):
        present = null_token_to_null(col(c))
        aggs.append(F.count(present).alias(f"n{i}"))
        for kind, parsed in _readings(present).items():
            aggs.append(F.count(parsed).alias(f"{kind}{i}"))
    row = cells.agg(*aggs).first()

    def pick(i: int) -> str:
        if row[f"n{i}"] == 0:
            return "double"
        fits = [k for k in ("boolean", "bigint", "double") if row[f"{k}{i}"] == row[f"n{i}"]]
        if fits[:1] == ["boolean"] and row[f"n{i}"] < row["total"]:
            return "string"
        return fits[0] if fits else "string"

    return {c: pick(i) for i, c in enumerate(names)}


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, **options) -> DataFrame:
    """Typed scan with the usual missing-value texts as nulls.

    Pass ``types`` to skip the extra pass that infers them. Broken lines fail the job.
    """
    cells = read_text_cells(spark, path, **options)
    types = types or infer_types(cells)
    broken = F.col(BROKEN).isNotNull()
    out = []
    for c in [c for c in cells.columns if c != BROKEN]:
        text = null_token_to_null(col(c))
        kind = types.get(c, "string")
        value = text if kind == "string" else _readings(text)[kind]
        out.append(value.alias(c))
    failed = F.raise_error(F.concat(F.lit("broken line: "), F.col(BROKEN)))
    return cells.where(F.when(broken, failed.cast("boolean")).otherwise(True)).select(*out)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Locations as text cells; rules are checked by ``operators.route.location_violations``."""
    cells = read_text_cells(spark, path)
    lacking = [c for c in LOCATION_COLUMNS if c not in cells.columns]
    if lacking:
        raise ValueError(f"the locations file lacks columns {lacking}")
    return cells.drop(BROKEN).fillna("", LOCATION_COLUMNS)


def typed_locations(cells: DataFrame) -> DataFrame:
    extra = [c for c in cells.columns if c not in LOCATION_COLUMNS]
    return cells.select(
        *extra,
        strip(F.col("id")).alias("id"),
        strip(F.col("name")).alias("name"),
        whole_number(F.col("demand")).cast("int").alias("demand"),
        whole_number(F.col("priority")).cast("int").alias("priority"),
        hhmm_minutes(F.col("window_start")).alias("window_start"),
        hhmm_minutes(F.col("window_end")).alias("window_end"),
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide distance matrix as text cells; the first column names the origin. A header that repeats a name is refused."""
    twice = repeated_names([c.strip() for c in header_cells(spark, path)])
    if twice:
        raise ValueError(f"the header repeats {twice}")
    return read_text_cells(spark, path).drop(BROKEN)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of records with quotes, as lists."""
    for batch in batches:
        rows = [next(csv.reader([t], strict=False), []) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("record"), pa.array(rows, pa.list_(pa.string()))], names=["file", "record", "cells"])


def matrix_edges(spark: SparkSession, path: str, origin: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """A wide distance matrix as rows (keys..., src, dst, dist_text), however many columns it has.

    The header is a table of (position, name); records are taken apart by position and joined with it, so no
    plan has a column per stop. ``origin`` names the column of origins (default: the first one after ``keys``). A header that
    repeats a name is refused; a record with another number of cells than its file's header fails the job.
    """
    keys = keys or []
    found = csv_splits.records(spark, path)
    quoted = F.instr("text", '"') > 0
    plain = found.where(~quoted).select("file", "record", F.split("text", ",", -1).alias("cells"))
    rows = plain.unionByName(found.where(quoted).select("file", "record", "text").mapInArrow(_cells, "file string, record long, cells array<string>"))
    rows = cut_lineage(rows)
    names = rows.where("record = 1").select("file", F.posexplode("cells").alias("position", "name")).withColumn("name", strip(F.col("name")))
    names = cut_lineage(names)
    twice = [r["name"] for r in names.groupBy("file", "name").count().where("count > 1").select("name").distinct().orderBy("name").limit(10).collect()]
    if twice:
        raise ValueError(f"the header repeats {twice}")
    # one row per file: where its keys and origins stand, and how many columns there are
    wanted = [*keys, *([origin] if origin else [])]
    at = F.map_from_entries(F.collect_list(F.when(F.col("name").isin(wanted), F.struct("name", "position"))))
    heads = names.groupBy("file").agg(at.alias("at"), F.count(F.lit(1)).alias("columns"))
    place = lambda c: F.element_at("at", F.lit(c))
    first = place(origin) if origin else F.lit(len(keys))
    body = rows.where("record > 1").join(F.broadcast(heads), "file")
    sound = F.when(F.size("cells") == F.col("columns"), F.col("cells")).otherwise(
        F.raise_error(F.concat(F.lit("a record has another number of cells than the header: "), F.substring(F.array_join("cells", ","), 1, 100))).cast("array<string>")
    )
    cells = body.withColumn("cells", sound).select(
        "file", *[strip(F.get("cells", place(k))).alias(k) for k in keys], strip(F.get("cells", first)).alias("src"), F.posexplode("cells").alias("position", "dist_text")
    )
    targets = names.where(~F.col("name").isin(wanted)) if origin else names.where(~F.col("name").isin(wanted) & (F.col("position") != len(keys)))
    targets = targets.select("file", "position", F.col("name").alias("dst"))
    return cells.join(hint_small(targets, targets.count()), ["file", "position"]).select(*keys, "src", "dst", "dist_text")
