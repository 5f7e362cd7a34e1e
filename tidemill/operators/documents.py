"""Result documents of jobs: local paths become storage keys, at any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import readable_text

# Fields that hold a path (null: the file keeps its name), and objects all of whose texts are paths.
PATH_FIELDS = {"processed_path": None, "original_path": None, "metadata_reference": "metadata.json"}
PATH_OBJECTS = {"visualizations"}

REFERENCE = pa.struct([("field", pa.string()), ("source", pa.string()), ("key", pa.string())])


def rewritten(value, job, found: list, field: str = "$", name: str | None = None, inside: bool = False):
    """The value with its paths as keys ``jobs/<job>/<file>``; each one is added to ``found``."""
    if isinstance(value, dict):
        inside = inside or name in PATH_OBJECTS
        return {k: rewritten(v, job, found, f"{field}.{k}", k, inside) for k, v in value.items()}
    if isinstance(value, list):
        return [rewritten(v, job, found, f"{field}[{k}]", name, inside) for k, v in enumerate(value)]
    if isinstance(value, float) and value - value != 0:
        return None  # NaN and infinities have no JSON form
    if isinstance(value, str) and value and (inside or name in PATH_FIELDS):
        file = (None if inside else PATH_FIELDS[name]) or re.split(r"[/\\]", value)[-1]
        key = f"jobs/{job}/{file}"
        found.append((field, value, key))
        return key
    return value


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        documents, references = [], []
        for job, text in zip(batch.column("job").to_pylist(), batch.column("text").to_pylist()):
            found: list = []
            try:
                value = json.loads(text) if text is not None else None
                documents.append(None if text is None else json.dumps(rewritten(value, job, found), ensure_ascii=False))
            except (ValueError, RecursionError):
                documents.append(None)
                found = []
            references.append([dict(zip(("field", "source", "key"), r)) for r in found])
        cols = [batch.column("job"), pa.array(documents, pa.string()), pa.array(references, pa.list_(REFERENCE))]
        yield pa.RecordBatch.from_arrays(cols, names=["job", "document", "references"])


def rewrite_references(results: DataFrame, job_id: str, document: str) -> DataFrame:
    """Documents whose paths are storage keys: (job_id, document as VARIANT, references).

    A document is JSON text or bytes; broken UTF-8 is replaced, NaN and infinities become null. ``references`` lists (field, source,
    key) in the order of the document: which file goes where. Null and empty paths, and fields that aren't texts, stay. A
    document that can't be read, or is null, is null and has no references. Repeated rows are kept.
    """
    rows = results.select(F.col(job_id).cast("string").alias("job"), readable_text(F.col(document).cast("binary")).alias("text"))
    schema = "job string, document string, references array<struct<field:string,source:string,key:string>>"
    out = rows.mapInArrow(_rewrite, schema)
    kind = results.schema[job_id].dataType
    return out.select(F.col("job").cast(kind).alias(job_id), F.parse_json("document").alias("document"), "references")


def document_leaves(documents: DataFrame, job_id: str, document: str, deepest: int = 32) -> DataFrame:
    """Every value of the documents that isn't an array or object: (job_id, path, type, value as text).

    One step per level of nesting, down to ``deepest``; documents nested deeper than that fail.
    """
    level = documents.select(F.col(job_id).alias("job"), F.lit("$").alias("path"), F.col(document).alias("v")).where("v IS NOT NULL")
    leaves = None
    for depth in range(deepest + 1):
        typed = level.withColumn("type", F.schema_of_variant("v"))
        nested = F.col("type").startswith("OBJECT") | F.col("type").startswith("ARRAY")
        here = typed.where(~nested).select(F.col("job").alias(job_id), "path", "type", F.expr("CAST(v AS string)").alias("value"))
        leaves = here if leaves is None else leaves.unionByName(here)
        inner = typed.where(nested).select("job", "path", "v")
        if inner.isEmpty():
            return leaves
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer())).select("job", F.concat("path", step).alias("path"), F.col("value").alias("v"))
    raise ValueError(f"documents are nested deeper than {deepest} levels")
