import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import scalars as X
from tidemill.operators.route import edge_violations, matrix_to_edges
from tidemill.sources import csv, csv_splits, files


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_types_and_missing_texts(spark, tmp_path):
    path = write(
        tmp_path, "t.csv",
        'id,score,flag,name,void,mixed\n1,2.5,True,"a ""b"", c",NA,1\n2,NA,False,  ,,x\n3,1e3,True,None,null,2\n',
    )
    df = csv.read_csv(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "score": "double", "flag": "boolean", "name": "string", "void": "double", "mixed": "string",
    }
    rows = [tuple(r) for r in df.collect()]
    assert rows == [
        (1, 2.5, True, 'a "b", c', None, "1"), (2, None, False, "  ", None, "x"), (3, 1000.0, True, None, None, "2"),
    ]


def test_given_types_skip_inference(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id,score\n1,2\n")
    assert dict(csv.read_csv(spark, path, types={"id": "string", "score": "double"}).dtypes) == {"id": "string", "score": "double"}


def test_header_only_and_sound_files(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id,name,value\n1,a,2\n2,b,3\n")
    assert csv.header(spark, path) == ["id", "name", "value"]
    assert csv.broken_lines(spark, path).count() == 0


@pytest.mark.parametrize("line", ["1,a", "1,a,2,3", '1,"a,2'])
def test_broken_lines(spark, tmp_path, line):
    path = write(tmp_path, "t.csv", f"id,name,value\n0,x,1\n{line}\n")
    assert [r.line for r in csv.broken_lines(spark, path).collect()] == [line]
    with pytest.raises(Exception, match="broken line"):
        csv.read_csv(spark, path).collect()


def test_locations(spark, tmp_path):
    path = write(
        tmp_path, "l.csv",
        "id,name,demand,priority,window_start,window_end,note\n L1 , Depot ,0,1,08:00,17:00,x\nL2,,2.5,1,24:00,12:00,y\n",
    )
    a, b = csv.typed_locations(csv.read_locations(spark, path)).collect()
    assert (a.id, a.name, a.demand, a.priority, a.window_start, a.window_end, a.note) == ("L1", "Depot", 0, 1, 480, 1020, "x")
    assert (b.name, b.demand, b.window_start, b.window_end) == ("", None, None, 720)
    with pytest.raises(ValueError, match="lacks"):
        csv.read_locations(spark, write(tmp_path, "m.csv", "id,name\n1,a\n"))


def test_matrix_file(spark, tmp_path):
    path = write(tmp_path, "m.csv", "location,A,B\nA,0,\nB,-1,0\n")
    edges = matrix_to_edges(csv.read_matrix(spark, path), "location").withColumn("route_id", F.lit(1))
    got = {(r.src, r.dst, r.rule) for r in edge_violations(edges).collect()}
    assert got == {("A", "B", "missing_distance"), ("B", "A", "negative_distance")}


@pytest.mark.parametrize(
    "text,minutes",
    [("00:00", 0), ("08:30", 510), (" 23:59 ", 1439), ("", None), ("8", None), ("8:3", None), ("24:00", None), ("08:60", None), ("08-30", None), (None, None)],
)
def test_clock(spark, text, minutes):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.hhmm_minutes(F.col("t")).alias("m")).first().m == minutes


@pytest.mark.parametrize("text,blank", [("", True), (" \t\n", True), ("  ", True), ("a ", False), (None, False)])
def test_blank(spark, text, blank):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.coalesce(X.is_blank(F.col("t")), F.lit(False)).alias("b")).first().b is blank


def test_json_has_no_nan(spark, tmp_path):
    rows = [(1, float("nan"), [1.0, float("inf")], {"k": float("nan")}, (2.0, "x"))]
    df = spark.createDataFrame(rows, "id int, v double, a array<double>, m map<string,double>, s struct<d:double,t:string>")
    files.write_json(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert json.loads(text) == {"id": 1, "v": None, "a": [1.0, None], "m": {"k": None}, "s": {"d": 2.0, "t": "x"}}


def test_artifacts_by_job(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 10).alias("job"), F.col("id").alias("v"))
    files.write_artifacts(df, str(tmp_path / "a"), "job", buckets=4)
    assert files.read_artifacts(spark, str(tmp_path / "a"), "job").count() == 100
    one = files.read_artifacts(spark, str(tmp_path / "a"), "job", wanted=3)
    assert sorted(r.v for r in one.collect()) == list(range(3, 100, 10))


def test_quoted_line_breaks_are_part_of_a_cell(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text\n1,"two\nlines"\n2,plain\n')
    assert [(r.id, r.text) for r in csv.read_csv(spark, str(path)).orderBy("id").collect()] == [(1, "two\nlines"), (2, "plain")]
    assert csv.broken_lines(spark, str(path)).count() == 0
    assert csv.broken_lines(spark, str(path), quoted_breaks=False).count() > 0


def test_a_matrix_that_repeats_a_name_is_refused(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("location,A,A\nA,0,1\nB,1,0\n")
    with pytest.raises(ValueError, match="repeats"):
        csv.read_matrix(spark, str(path))


@pytest.mark.parametrize("buckets", [1, 8, 300])
def test_artifacts_are_found_whatever_the_number_of_buckets(spark, tmp_path, buckets):
    df = spark.range(50).selectExpr("id as job_id", "id * 2 as v")
    files.write_artifacts(df, str(tmp_path / "a"), "job_id", buckets=buckets)
    for wanted in (7, 49):
        found = files.read_artifacts(spark, str(tmp_path / "a"), "job_id", wanted)
        assert [(r.job_id, r.v) for r in found.collect()] == [(wanted, wanted * 2)]
    several = files.read_artifacts(spark, str(tmp_path / "a"), "job_id", [1, 2, 99])
    assert sorted(r.job_id for r in several.collect()) == [1, 2]
    plan = several._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [job_bucket" in plan or "PartitionFilters: []" not in plan


def test_true_and_false_with_gaps_stay_text(spark, tmp_path):
    path = write(tmp_path, "b.csv", "a,b\nTrue,True\nFalse,\nTrue,False\n")
    assert dict(csv.read_csv(spark, path).dtypes) == {"a": "boolean", "b": "string"}


def test_a_run_cleans_up_after_itself(spark, tmp_path):
    import os

    from tidemill.plans.session import cut_lineage, run_folder

    with run_folder(spark) as folder:
        assert cut_lineage(spark.range(5)).count() == 5
        assert os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


PIECES = ["a", "two\nlines", 'q"uote', "x,y", "", '"', "\n\n", "long " * 40, "r\r\nn", " lead", "é\n;"]


@pytest.fixture
def small_parts(spark):
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "2k")
    yield 2048
    spark.conf.set(size, before)


def csv_text(rows, rng):
    """Rows with cells quoted where needed and now and then where not, blank lines and both line ends."""
    out = ["id,a,b\n"]
    for k, row in enumerate(rows):
        cells = ['"' + c.replace('"', '""') + '"' if set(c) & set('",\n\r') or rng.random() < 0.2 else c for c in row]
        out.append(",".join(cells) + ("\r\n" if k % 3 else "\n") + ("\n" if k % 50 == 0 else ""))
    return "".join(out)


def test_records_of_files_that_many_tasks_read(spark, tmp_path, small_parts):
    import random

    rng = random.Random(3)
    rows = [(str(i), rng.choice(PIECES), rng.choice(PIECES)) for i in range(700)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_bytes(("﻿" + csv_text(rows[:500], rng)).encode())
    (tmp_path / "t" / "b.csv").write_bytes(csv_text(rows[500:], rng).encode())
    path = str(tmp_path / "t")
    assert spark.read.text(path).rdd.getNumPartitions() > 8
    cells = csv.read_text_cells(spark, path)
    assert cells.columns == ["id", "a", "b", csv.BROKEN]
    assert sorted((r.id, r.a or "", r.b or "") for r in cells.collect()) == sorted(rows)
    assert csv.broken_lines(spark, path).count() == 0
    assert csv.read_csv(spark, path).agg(F.sum("id")).first()[0] == sum(range(700))


def test_broken_records_in_parts(spark, tmp_path, small_parts):
    lines = ["id,name,value"] + [f"{k},x,1" for k in range(900)]
    lines[300], lines[500], lines[700] = "1,a", '2,"b\nc"', "3,a,2,3"
    lines.append('4,"open,1')
    path = write(tmp_path, "t.csv", "\n".join(lines) + "\nand on\n")
    want = sorted(["1,a", '2,"b\nc"', "3,a,2,3", '4,"open,1\nand on'])
    assert sorted(r.line for r in csv.broken_lines(spark, path).collect()) == want
    whole = csv.broken_lines(spark, path, whole_bytes=1 << 20)
    assert sorted(r.line.strip("\n") for r in whole.collect()) == want
    assert csv.read_text_cells(spark, path).where(f"{csv.BROKEN} IS NULL").count() == 900 - 3


def test_a_record_without_end_is_not_put_together(spark, tmp_path, small_parts, monkeypatch):
    monkeypatch.setattr(csv_splits, "RECORD_BYTES", 3000)
    path = write(tmp_path, "t.csv", "id,v\n" + "".join(f"{k},x\n" for k in range(400)) + '400,"open\n' + "".join(f"{k},x\n" for k in range(2000)))
    assert [r.line for r in csv.broken_lines(spark, path).collect()] == ['400,"open']
    assert csv.read_text_cells(spark, path).count() == 401


@pytest.mark.parametrize("line", ["", "a,b", '"a,b', '"a""b",c', 'a"b,"c', 'x,"y', '"",""', '"a" b,"', '""",', '5" pipe,3'])
def test_quote_states_of_lines(spark, line):
    def after(inside):
        for k, cell in enumerate(line.split(",")):
            if inside or cell.startswith('"'):
                inside = inside != (cell.count('"') % 2 == 1)
        return inside

    df = spark.createDataFrame([(line,)], "t string")
    got = df.select(*[csv_splits.quote_after(F.col("t"), s, ",") for s in (False, True)]).first()
    assert tuple(got) == (after(False), after(True))


def test_artifacts_of_a_table_of_jobs(spark, tmp_path):
    df = spark.range(300).selectExpr("id % 100 as job_id", "id as v")
    files.write_artifacts(df, str(tmp_path / "a"), "job_id", buckets=16)
    wanted = spark.range(0, 200, 20).selectExpr("id as job_id").union(spark.createDataFrame([(None,), (20,)], "job_id long"))
    found = files.find_artifacts(spark, str(tmp_path / "a"), wanted, "job_id")
    assert sorted((r.job_id, r.v) for r in found.collect()) == sorted((v % 100, v) for v in range(300) if v % 20 == 0)


def test_a_matrix_by_position(spark, tmp_path):
    path = write(tmp_path, "m.csv", 'location, A ,"B, C",D\nA,0,1.5,\n"B, C",-1,0,x\n D ,"two\nlines",2,0\n')
    got = {(r.src, r.dst): r.dist_text for r in csv.matrix_edges(spark, path).collect()}
    want = {(r.src, r.dst): r.dist_text for r in matrix_to_edges(csv.read_matrix(spark, path), "location").collect()}
    assert {k: v or None for k, v in got.items()} == want and len(got) == 9
    with pytest.raises(ValueError, match="repeats"):
        csv.matrix_edges(spark, write(tmp_path, "n.csv", "location,A, A\nA,0,1\n"))
    with pytest.raises(Exception, match="another number"):
        csv.matrix_edges(spark, write(tmp_path, "o.csv", "location,A,B\nA,0\n")).collect()


def test_a_header_of_twenty_thousand_stops_plans_quickly(spark, tmp_path):
    import time

    n = 20_000
    lines = ["location," + ",".join(f"s{k}" for k in range(n))] + [f"s{i}," + ",".join(str((i * k) % 97) for k in range(n)) for i in (1, 5, 19_999)]
    path = write(tmp_path, "wide.csv", "\n".join(lines) + "\n")
    start = time.monotonic()
    edges = csv.matrix_edges(spark, path)
    assert time.monotonic() - start < 60
    assert edges.columns == ["src", "dst", "dist_text"] and edges.count() == 3 * n
    assert edges.where("src = 's5' AND dst = 's19999'").first().dist_text == str(5 * 19_999 % 97)
