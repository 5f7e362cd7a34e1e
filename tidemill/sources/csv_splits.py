"""CSV records of files that many tasks read: where records begin follows from the quotes of all parts before.

A line may stand inside a quoted cell that began many lines, or many file parts, earlier. For each line
it is known what it does to either state (inside or outside quotes); these small maps are chained inside each part while it
is read, from part to part over one row per part, and a line's state and record number follow from both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.session import cut_lineage, hint_small

# A record of several lines above this many bytes isn't put together: it is reported as broken, with its first line.
RECORD_BYTES = 64 << 20


def size_of_largest(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; the files themselves aren't read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def part_bytes(spark: SparkSession) -> int:
    """Bytes of a scan partition, as set for the session."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    shift = {"k": 10, "m": 20, "g": 30, "t": 40}.get(size[-1], 0)
    return int(size[:-1] if shift else size) << shift


def quote_after(line: Column, inside: bool, delimiter: str) -> Column:
    """Whether the end of a line is inside quotes, if its beginning is or isn't.

    A cell is quoted if its first character is a quote; doubled quotes inside count twice and so not at all. Quotes elsewhere are text.
    """

    def step(state: Column, cell: Column) -> Column:
        odd = F.char_length(F.regexp_replace(cell, '[^"]+', "")) % 2 == 1
        return F.when(state | cell.startswith('"'), state != odd).otherwise(F.lit(False))

    escaped = "".join(f"\\{c}" if not c.isalnum() else c for c in delimiter)
    cells = F.split(line, escaped, -1)
    return F.when(F.instr(line, '"') > 0, F.aggregate(cells, F.lit(inside), step)).otherwise(F.lit(inside))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each part in reading order, and give each one's state for either state at the part's beginning.

    The rows of a part come one after the other. A line's map is constant (0, 1), the identity or the exchange.
    """
    last, state, record, lines = None, np.array([0, 1]), np.zeros(2, np.int64), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, part = batch.column("file").dictionary_encode(), batch.column("part").to_numpy()
        number = file.indices.to_numpy()
        cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(number) != 0)) + 1
        maps = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int8) for c in ("from_out", "from_in")])
        blank = batch.column("blank").to_numpy(zero_copy_only=False)
        out = {k: [] for k in ("line", "s0", "s1", "r0", "r1")}
        for a, b in zip([0, *cut], [*cut, len(part)]):
            key = (file.dictionary[int(number[a])].as_py(), int(part[a]))
            if key != last:
                last, state, record, lines = key, np.array([0, 1]), np.zeros(2, np.int64), 0
            m = maps[:, a:b]
            # the state after a line: the value of the last constant map, else the first state; exchanged for each exchange since
            constant = m[0] == m[1]
            place = np.where(constant, np.arange(1, b - a + 1), 0)
            since = np.maximum.accumulate(place)
            swaps = np.concatenate([[0], np.cumsum((m[0] == 1) & (m[1] == 0))])
            fixed = np.concatenate([[0], m[0]])[since]
            turned = (swaps[1:] - swaps[since]) % 2
            for k in (0, 1):
                after = np.where(since > 0, fixed, state[k]) ^ turned
                before = np.concatenate([[state[k]], after[:-1]])
                starts = (before == 0) & ~blank[a:b]
                numbers = record[k] + np.cumsum(starts)
                out[f"s{k}"].append(before)
                out[f"r{k}"].append(numbers)
                state[k], record[k] = after[-1], numbers[-1]
            out["line"].append(lines + np.arange(b - a))
            lines += b - a
        cols = [batch.column(c) for c in ("file", "part", "value", "from_out", "from_in", "blank")]
        new = [pa.array(np.concatenate(out["line"]))]
        new += [pa.array(np.concatenate(out[k]).astype(bool)) for k in ("s0", "s1")] + [pa.array(np.concatenate(out[k]).astype(np.int64)) for k in ("r0", "r1")]
        yield pa.RecordBatch.from_arrays([*cols, *new], names=["file", "part", "value", "from_out", "from_in", "blank", "line", "s0", "s1", "r0", "r1"])


def chained_lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """All lines, written once: (file, part, line, value, ...), with state and record number for either state at the part's beginning."""
    text = spark.read.option("lineSep", "\n").text(path)
    at = text.metadataColumn("_metadata")
    value = F.regexp_replace("value", "^﻿", "")
    rows = text.select(at["file_path"].alias("file"), at["file_block_start"].alias("part"), F.when(at["file_block_start"] == 0, value).otherwise(F.col("value")).alias("value"))
    maps = rows.select(
        "file", "part", "value",
        quote_after(F.col("value"), False, delimiter).alias("from_out"),
        quote_after(F.col("value"), True, delimiter).alias("from_in"),
        (F.btrim(F.col("value"), F.lit(" \t\r")) == "").alias("blank"),
    )
    schema = "file string, part long, value string, from_out boolean, from_in boolean, blank boolean, line long, s0 boolean, s1 boolean, r0 long, r1 long"
    return cut_lineage(maps.mapInArrow(_chain, schema))


def part_starts(lines: DataFrame) -> DataFrame:
    """For each part (file, part): whether it begins inside quotes, and the number of records begun before it."""
    last = F.max_by(F.struct("from_out", "from_in", "s0", "s1", "r0", "r1"), "line").alias("last")
    ends = lines.groupBy("file", "part").agg(last)
    after = lambda s: F.when(F.col(f"last.{s}"), F.col("last.from_in")).otherwise(F.col("last.from_out"))
    rows = ends.select("file", F.struct("part", after("s0").alias("e0"), after("s1").alias("e1"), "last.r0", "last.r1").alias("p"))
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("records"), F.array().cast("array<struct<part:long,inside:boolean,records:long>>").alias("done"))

    def step(state: Column, p: Column) -> Column:
        here = F.struct(p["part"].alias("part"), state["inside"].alias("inside"), state["records"].alias("records"))
        inside, more = (F.when(state["inside"], p[b]).otherwise(p[a]) for a, b in (("e0", "e1"), ("r0", "r1")))
        return F.struct(inside.alias("inside"), (state["records"] + more).alias("records"), F.concat(state["done"], F.array(here)).alias("done"))

    # one row per part of a file
    chained = rows.groupBy("file").agg(F.sort_array(F.collect_list("p")).alias("parts")).select("file", F.aggregate("parts", zero, step).alias("all"))
    return chained.select("file", F.explode("all.done").alias("p")).select("file", "p.*")


def records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Every record of the files below ``path`` as text: (file, record, text, sound), numbered from 1 in each file.

    Lines end in a line feed; a carriage return before it is left out. Blank lines between records are skipped. ``sound`` is false for a
    record whose last quote stays open at the end of its file, and for one of more than ``RECORD_BYTES``, which
    is cut after its first line. Records of one line never move; the others are put together by a shuffle.
    """
    lines = chained_lines(spark, path, delimiter)
    starts = cut_lineage(part_starts(lines))
    here = starts.select(F.col("file").alias("_file"), F.col("part").alias("_part"), "inside", "records")
    joined = lines.join(hint_small(here, here.count()), (F.col("file") == F.col("_file")) & (F.col("part") == F.col("_part")))
    began = F.when(F.col("inside"), F.col("s1")).otherwise(F.col("s0"))
    number = F.col("records") + F.when(F.col("inside"), F.col("r1")).otherwise(F.col("r0"))
    placed = joined.select("file", "part", "line", "value", "blank", began.alias("began"), number.alias("record"), F.when(began, F.col("from_in")).otherwise(F.col("from_out")).alias("open"))
    placed = placed.where(F.col("began") | ~F.col("blank"))
    bare = lambda c: F.regexp_replace(c, "\r$", "")
    # the text is null on lines that aren't records, since checks of it may be moved before they are left out
    one = ~F.col("began") & ~F.col("open") & ~F.col("blank")
    alone = placed.where(one).select("file", "record", F.when(one, bare("value")).alias("text"), F.lit(True).alias("sound"))
    some = placed.where(F.col("began") | F.col("open")).withColumn("bytes", F.octet_length("value").cast("long"))
    # an open quote would make the rest of a file one record: the size is known before lines are put together
    sizes = some.groupBy("file", "record").agg(F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("lines"))
    large = F.col("total") + F.col("lines") > RECORD_BYTES
    kept = some.join(sizes.where(large).select("file", "record"), ["file", "record"], "left_anti")
    whole = kept.groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "line", "value"))), lambda x: x["value"]), "\n").alias("text"),
        F.max_by("open", F.struct("part", "line")).alias("unended"),
    )
    first = some.where("NOT began").join(sizes.where(large), ["file", "record"])
    return (
        alone.unionByName(whole.select("file", "record", bare("text").alias("text"), (~F.col("unended")).alias("sound")))
        .unionByName(first.select("file", "record", F.when(large, bare("value")).alias("text"), F.lit(False).alias("sound")))
    )
