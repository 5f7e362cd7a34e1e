import random

import pytest

from tests.test_images import gif, png
from tidemill.plans import runs


def rows(spark, path):
    return spark.read.json(path).collect()


def test_dataset_run(spark, tmp_path):
    rnd = random.Random(1)
    lines = ["city,temp,energy,co2"]
    for i in range(80):
        temp = 20 + i % 17
        lines.append(f"{rnd.choice(['Oslo', 'Rome', 'NA'])},{temp},{'' if i == 5 else temp * 2},{500 if i == 7 else temp * 3 + i % 3}")
    src = tmp_path / "d.csv"
    src.write_text("\n".join(lines) + "\n")
    got = runs.run_dataset(
        spark, str(src), str(tmp_path / "out"), target="co2", n_estimators=3, max_depth=3,
        histograms=True, box_plots=True, correlation_heatmap=True,
    )
    assert set(got) == {
        "profile", "frequencies", "outlier_rows", "histograms", "box_plots", "correlation_heatmap",
        "evaluation", "feature_importances", "actual_vs_predicted", "model",
    }
    outliers = rows(spark, got["outlier_rows"])
    assert [(r.column_name, r.row_number, r.value) for r in outliers] == [("co2", 7, 500.0)]
    assert sum(r.importance for r in rows(spark, got["feature_importances"])) == pytest.approx(1.0)
    metrics = {(r.section, r.column_name, r.metric): r.value_num for r in rows(spark, got["profile"])}
    assert metrics["shape", "*", "num_rows"] == 80 and metrics["missing", "energy", "missing"] == 1


def test_dataset_run_refuses_unknown_target(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="target"):
        runs.run_dataset(spark, str(tmp_path / "d.csv"), str(tmp_path / "out"), target="z")


LOCATIONS = "id,name,demand,priority,window_start,window_end\n" + "".join(
    f"L{i},{n},1,1,08:00,17:00\n" for i, n in enumerate(["Depot", "North", "East", "South"])
)
MATRIX = "location,Depot,North,East,South\nDepot,0,2,9,4\nNorth,2,0,3,8\nEast,9,3,0,5\nSouth,4,8,5,0\n"


def route_files(spark, tmp_path, matrix=MATRIX):
    (tmp_path / "l.csv").write_text(LOCATIONS)
    (tmp_path / "m.csv").write_text(matrix)
    problems = spark.createDataFrame([(1, "Depot", "Depot")], "route_id long, start string, end string")
    return (*runs.single_route(spark, str(tmp_path / "l.csv"), str(tmp_path / "m.csv")), problems)


def test_route_run(spark, tmp_path):
    places, cells, problems = route_files(spark, tmp_path)
    got = runs.run_routes(spark, places, cells, problems, str(tmp_path / "out"), max_distance=20.0)
    result = rows(spark, got["results"])[0]
    assert (result.initial_distance, result.optimized_distance, result.feasible) == (14.0, 14.0, True)
    tour = sorted((r.pos, r.stop) for r in rows(spark, got["tours"]) if r.kind == "optimized")
    assert [s for _, s in tour] == ["Depot", "North", "East", "South", "Depot"]


def test_route_run_reports_broken_input(spark, tmp_path):
    places, cells, problems = route_files(spark, tmp_path, MATRIX.replace("North", "Nord").replace(",9,4", ",-9,4"))
    with pytest.raises(ValueError, match="breaks its rules"):
        runs.run_routes(spark, places, cells, problems, str(tmp_path / "out"))
    rules = {(r.place, r.rule) for r in rows(spark, str(tmp_path / "out" / "violations"))}
    assert rules == {("Depot -> East", "negative_distance"), ("North", "left_only"), ("Nord", "right_only")}


def test_image_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(4, 5))
    (tmp_path / "in" / "b.gif").write_bytes(gif(6, 7))
    (tmp_path / "in" / "c.png").write_bytes(b"text")
    got = runs.run_images(spark, str(tmp_path / "in"), str(tmp_path / "out"), output_format="png", resize=(8, 9), compression_quality=70)
    assert len(rows(spark, got["inventory"])) == 3
    plans = {r.path.rsplit("/", 1)[1]: r for r in rows(spark, got["plan"])}
    assert set(plans) == {"a.png", "b.gif"}
    assert plans["b.gif"].operations == ["resize", "format_conversion", "compression"] and plans["a.png"].optimize
    with pytest.raises(ValueError):
        runs.run_images(spark, str(tmp_path / "in"), str(tmp_path / "out"), compression_quality=0)
