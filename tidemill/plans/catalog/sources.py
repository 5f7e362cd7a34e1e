"""Source and sink queries: the tables are written in another format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import documents
from tidemill.operators.profile import schema_report
from tidemill.plans.catalog.jobs import JOBS, jobs
from tidemill.plans.catalog.profile import SPARK_TYPES, rounded
from tidemill.plans.catalog.route import LOCATIONS, locations
from tidemill.plans.session import load, work_dir
from tidemill.sources import csv, files


def as_csv(df, label, files=None, **options):
    path = work_dir(df.sparkSession, label)
    (df.coalesce(files) if files else df).write.options(header=True, **options).csv(path)
    return path


def customer_csv(s, d, files=None):
    """Customers with the usual texts for missing values put in."""
    bal = F.col("c_acctbal")
    return as_csv(
        load(s, d, "customer").select(
            "c_custkey",
            F.when(bal < 0, F.lit("NA")).otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
            F.when(bal > 9000, F.lit("n/a")).otherwise(bal.cast("string")).alias("c_acctbal"),
            F.when(bal < 1000, F.lit(""))
            .when(bal < 2000, F.lit('a "quoted", text'))
            .when(bal < 2500, F.lit('two\nlines, "quoted"'))
            .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
            F.when(bal > 5000, F.lit("True")).otherwise(F.lit("False")).alias("c_good"),
        ),
        "customer-csv",
        files,
        emptyValue="",
        escape='"',
    )


def broken_csv(s, d):
    """Orders as raw lines of which some are short, long or have an open quote."""
    path = work_dir(s, "broken-csv")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice")
    line = (
        F.when(price < 5000, key)
        .when(price > 490000, F.concat_ws(",", key, "o_orderstatus", "o_orderpriority", F.lit("extra")))
        .when(price.between(100000, 101000), F.concat(key, F.lit(',"'), F.col("o_orderstatus"), F.lit(",x")))
        .otherwise(F.concat_ws(",", key, "o_orderstatus", "o_orderpriority"))
    )
    load(s, d, "orders").select(line.alias("value")).write.text(path)
    return path


def q_validation(s, d):
    return csv.broken_lines(s, broken_csv(s, d), names=["id", "status", "priority"], quoted_breaks=False).select("line")


def broken_records(s, d):
    """Orders in one file, some of them short or long, some with a quoted line break and too few cells, some with one and sound."""
    path = work_dir(s, "broken-records")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice")
    line = (
        F.when(price < 5000, key)
        .when(price > 490000, F.concat_ws(",", key, "o_orderstatus", "o_orderpriority", F.lit("extra")))
        .when(price.between(100000, 101000), F.concat(key, F.lit(',"a ""b"", c\n\n'), "o_orderstatus", F.lit('"')))
        .when(price.between(101000, 103000), F.concat(key, F.lit(',"two\nlines",""'),))
        .otherwise(F.concat_ws(",", key, "o_orderstatus", "o_orderpriority"))
    )
    load(s, d, "orders").select(line.alias("value")).coalesce(1).write.text(path)
    return path


def q_split_validation(s, d):
    return csv.broken_lines(s, broken_records(s, d), names=["id", "status", "priority"], whole_bytes=0)


def q_json(s, d):
    """Job documents through the JSON sink and back; missing durations are explicit nulls."""
    path = work_dir(s, "jobs-json")
    docs = jobs(s, d).select(
        "id",
        F.struct("user_id", "session_id").alias("owner"),
        F.struct(F.when(F.col("attempts") > 0, F.col("attempts") / 2).otherwise(F.lit(float("nan"))).alias("score")).alias("evaluation"),
        "status",
    )
    files.write_json(docs, path)
    back = s.read.schema(docs.schema).json(path)
    return back.select("id", "owner.user_id", "owner.session_id", "evaluation.score", "status")


def q_artifacts(s, d):
    path = work_dir(s, "artifacts")
    files.write_artifacts(jobs(s, d).select("id", "type", "status"), path, "id", buckets=8)
    return files.read_artifacts(s, path, "id")


def q_artifact_lookup(s, d):
    """The results of every twentieth job, found in their buckets."""
    path = work_dir(s, "artifacts")
    files.write_artifacts(jobs(s, d).select("id", "type", "status"), path, "id", buckets=32)
    return files.find_artifacts(s, path, jobs(s, d).where("id % 20 = 0").select("id"), "id")


def q_locations(s, d):
    path = as_csv(locations(s, d), "locations-csv", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return csv.typed_locations(csv.read_locations(s, path)).withColumns(
        {"route_id": F.col("route_id").cast("long"), "row_no": F.col("row_no").cast("long")}
    )


def result_documents(s, d):
    """Nested result documents with null, empty and foreign paths, arrays and bytes that aren't UTF-8."""
    job, n = F.col("id").cast("string"), F.col("id") % 5
    text = F.concat(
        F.lit('{"id": '), job, F.lit(', "processed_path": '), F.when(n == 0, F.lit("null")).otherwise(F.concat(F.lit('"/work/'), job, F.lit("/out_"), job, F.lit('.png"'))),
        F.lit(', "metadata_reference": "'), F.when(n == 1, F.lit("")).otherwise(F.lit("/work/m.json")),
        F.lit('", "parts": [null, {"visualizations": {"hist": "C:\\\\w\\\\h'), job, F.lit('.svg", "bins": 30}}], "status": "'), F.col("status"),
    )
    return jobs(s, d).select("id", F.concat(text.cast("binary"), F.unhex(F.lit("FF")), F.lit('"}').cast("binary")).alias("document"))


def q_references(s, d):
    """Storage keys of the documents' files, read back from the documents."""
    out = documents.rewrite_references(result_documents(s, d), "id", "document")
    at = lambda path: F.variant_get("document", path, "string")
    return out.select(
        "id",
        at("$.processed_path").alias("processed"),
        at("$.metadata_reference").alias("metadata"),
        at("$.parts[1].visualizations.hist").alias("hist"),
        F.variant_get("document", "$.parts[1].visualizations.bins", "long").alias("bins"),
        at("$.status").alias("status"),
        F.size("references").cast("long").alias("files"),
    )


QUERIES = {
    "document_references": q_references,
    "csv_scan": lambda s, d: rounded(csv.read_csv(s, customer_csv(s, d))),
    "csv_split_scan": lambda s, d: rounded(csv.read_csv(s, customer_csv(s, d, files=1), whole_bytes=0)),
    "csv_split_validation": q_split_validation,
    "csv_schema": lambda s, d: schema_report(csv.read_csv(s, customer_csv(s, d))),
    "csv_validation": q_validation,
    "csv_locations": q_locations,
    "json_roundtrip": q_json,
    "artifact_roundtrip": q_artifacts,
    "artifact_lookup": q_artifact_lookup,
}

CUSTOMERS = """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey::BIGINT END AS c_nationkey,
  CASE WHEN c_acctbal > 9000 THEN NULL ELSE round(c_acctbal, 4) END AS c_acctbal,
  CASE WHEN c_acctbal < 1000 THEN NULL WHEN c_acctbal < 2000 THEN 'a "quoted", text' WHEN c_acctbal < 2500 THEN 'two' || chr(10) || 'lines, "quoted"' ELSE c_mktsegment END AS c_mktsegment,
  c_acctbal > 5000 AS c_good FROM customer"""

SQL = {
    "document_references": f"""WITH {JOBS} SELECT id, CASE WHEN id % 5 > 0 THEN concat('jobs/', id, '/out_', id, '.png') END AS processed,
  CASE WHEN id % 5 = 1 THEN '' ELSE concat('jobs/', id, '/metadata.json') END AS metadata, concat('jobs/', id, '/h', id, '.svg') AS hist, 30::BIGINT AS bins,
  status || chr(65533) AS status, (1 + (id % 5 > 0)::INTEGER + (id % 5 <> 1)::INTEGER)::BIGINT AS files FROM jobs""",
    "csv_scan": CUSTOMERS,
    "csv_split_scan": CUSTOMERS,
    "csv_split_validation": """SELECT CASE WHEN o_totalprice < 5000 THEN o_orderkey::VARCHAR
  WHEN o_totalprice > 490000 THEN concat_ws(',', o_orderkey, o_orderstatus, o_orderpriority, 'extra')
  ELSE concat(o_orderkey, ',"a ""b"", c', chr(10), chr(10), o_orderstatus, '"') END AS line
FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 490000 OR o_totalprice BETWEEN 100000 AND 101000""",
    "csv_schema": f"""WITH t AS (SELECT (row_number() OVER () - 1)::INTEGER AS ordinal, column_name, column_type AS data_type
  FROM (DESCRIBE SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 5000 AS c_good FROM customer))
SELECT ordinal, column_name, CASE data_type WHEN 'BOOLEAN' THEN 'boolean' ELSE {SPARK_TYPES} END AS data_type,
  CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'other' ELSE 'numeric' END AS kind FROM t""",
    "csv_validation": """SELECT CASE WHEN o_totalprice < 5000 THEN o_orderkey::VARCHAR
  WHEN o_totalprice > 490000 THEN concat_ws(',', o_orderkey, o_orderstatus, o_orderpriority, 'extra')
  ELSE concat(o_orderkey, ',"', o_orderstatus, ',x') END AS line
FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 490000 OR o_totalprice BETWEEN 100000 AND 101000""",
    "csv_locations": f"""WITH {LOCATIONS} SELECT route_id, row_no, trim(id) AS id, trim(name) AS name,
  CASE WHEN regexp_full_match(demand, '-?[0-9]+') THEN demand::INTEGER END AS demand,
  CASE WHEN trim(priority) = 'x' THEN NULL ELSE trim(priority)::INTEGER END AS priority,
  CASE WHEN c < 24 THEN c * 60 + 30 END AS window_start, CASE WHEN window_end = '12:00' THEN 720 END AS window_end
FROM (SELECT *, substr(window_start, 1, 2)::INTEGER AS c FROM loc)""",
    "json_roundtrip": f"""WITH {JOBS} SELECT id, user_id, session_id, CASE WHEN attempts > 0 THEN attempts / 2.0::DOUBLE END AS score, status FROM jobs""",
    "artifact_roundtrip": f"WITH {JOBS} SELECT id, type, status FROM jobs",
    "artifact_lookup": f"WITH {JOBS} SELECT id, type, status FROM jobs WHERE id % 20 = 0",
}
