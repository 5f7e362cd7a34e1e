import json

from pyspark.sql import functions as F

from tidemill.operators import documents as D


def test_paths_become_keys_at_any_depth(spark):
    value = {
        "processed_path": "/tmp/w/out.png",
        "metadata_reference": "w/anything.json",
        "original_path": "",
        "note": "/tmp/w/stays.png",
        "pages": [{"visualizations": {"hist": "C:\\w\\h.png", "n": 3, "more": ["/a/b.svg", None]}}, None, 5, {"processed_path": None}, {"processed_path": 7}],
        "score": float("nan"),
    }
    rows = [(1, json.dumps(value).encode()), (1, b'{"note": "a\xff", "processed_path": "x\xfe/y"}'), (2, b"{broken"), (3, None), (None, b'"text"'), (4, b"")]
    df = spark.createDataFrame(rows, "id long, doc binary")
    got = D.rewrite_references(df, "id", "doc").select("id", F.to_json("document").alias("doc"), "references").collect()
    assert len(got) == 6
    first = next(r for r in got if r.id == 1 and len(r.references) > 1)
    assert json.loads(first.doc) == {
        "processed_path": "jobs/1/out.png",
        "metadata_reference": "jobs/1/metadata.json",
        "original_path": "",
        "note": "/tmp/w/stays.png",
        "pages": [{"visualizations": {"hist": "jobs/1/h.png", "n": 3, "more": ["jobs/1/b.svg", None]}}, None, 5, {"processed_path": None}, {"processed_path": 7}],
        "score": None,
    }
    assert [(r.field, r.source) for r in first.references][2:] == [("$.pages[0].visualizations.hist", "C:\\w\\h.png"), ("$.pages[0].visualizations.more[0]", "/a/b.svg")]
    second = next(r for r in got if r.id == 1 and len(r.references) == 1)
    assert json.loads(second.doc) == {"note": "a\ufffd", "processed_path": "jobs/1/y"}
    assert [(r.doc, r.references) for r in got if r.id in (2, 3, 4)] == [(None, [])] * 3
    assert D.rewrite_references(df.where("false"), "id", "doc").collect() == []


def test_leaves_of_nested_documents(spark):
    docs = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}], "c": null}'), (2, "7"), (3, None)], "id long, doc string").withColumn("doc", F.parse_json("doc"))
    got = {(r.id, r.path, r.value) for r in D.document_leaves(docs, "id", "doc").collect()}
    assert got == {(1, "$.a[0]", "1"), (1, "$.a[1].b", "x"), (1, "$.c", None), (2, "$", "7")}
