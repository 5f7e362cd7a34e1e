"""The three jobs end to end: files in, result tables out.

Every result is written as a table below the output folder; what is returned are their paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.scalars import finite_number, strip
from tidemill.operators import checks, images, model, profile, route
from tidemill.operators.columns import numeric_columns, string_columns
from tidemill.plans.session import cut_lineage, in_run_folder, nan_to_null, tune, work_dir
from tidemill.sources import csv, files

ROW = "row_number"


def numbered(table: DataFrame) -> DataFrame:
    """Add the 0-based row number of a Parquet table: rows before the file plus place in the file."""
    placed = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    lengths = cut_lineage(placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", F.substring(F.md5("_file"), 1, 3)))
    # rows of whole parts before the file's part (4,096 parts at most), and of files before it in its own
    parts = lengths.groupBy("_part").agg(F.sum("_n").alias("_n"))
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_start"))
    offsets = (
        lengths.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_part")
        .select("_file", (F.col("_start") + F.col("_inside")).alias("_before"))
    )
    return placed.join(offsets, "_file").withColumn(ROW, F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def stage_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Typed CSV rows as a Parquet table, so that the many passes of a profile read columns only."""
    staged = work_dir(spark, "dataset")
    nan_to_null(csv.read_csv(spark, path, types)).write.parquet(staged)
    return spark.read.parquet(staged)


@in_run_folder
def run_dataset(
    spark: SparkSession,
    path: str,
    out: str,
    *,
    target: str | None = None,
    features: list[str] | None = None,
    n_estimators: int = model.TREES,
    max_depth: int | None = None,
    histograms: bool = False,
    box_plots: bool = False,
    correlation_heatmap: bool = False,
    types: dict[str, str] | None = None,
) -> dict[str, str]:
    """Profile a CSV file and, with a target, train and evaluate a forest on it."""
    table = stage_csv(tune(spark), path, types)
    numbers, text = numeric_columns(table.schema), string_columns(table.schema)
    if target is not None:
        checks.project_features(table, target, features)  # refuse a bad request before any work
    if (histograms or box_plots or correlation_heatmap) and not numbers:
        raise ValueError("no numeric columns are available for charts")
    parts = {"profile": profile.full_profile(table)}
    if numbers or text:
        parts["frequencies"] = profile.value_frequencies(table)
    if numbers:
        parts["outlier_rows"] = profile.outlier_rows(numbered(table), [ROW], numbers)
    if histograms:
        parts["histograms"] = profile.histogram(table)
    if box_plots:
        parts["box_plots"] = profile.box_stats(table)
    if correlation_heatmap:
        parts["correlation_heatmap"] = profile.heatmap_cells(table)
    if target is not None:
        wanted = [c for c in table.columns if c != target] if features is None else features
        fitted = model.train_forest(numbered(table), target, [ROW], wanted, n_estimators, max_depth)
        parts["evaluation"] = fitted.evaluation
        parts["model"] = fitted.document(spark)
        parts["feature_importances"] = fitted.importances
        parts["actual_vs_predicted"] = fitted.predictions
    return _write_all(parts, out)


def _write_all(parts: dict[str, DataFrame], out: str) -> dict[str, str]:
    paths = {}
    for name, df in parts.items():
        paths[name] = f"{out.rstrip('/')}/{name}"
        files.write_json(df, paths[name])
    return paths


@in_run_folder
def run_routes(
    spark: SparkSession,
    locations: DataFrame,
    cells: DataFrame,
    problems: DataFrame,
    out: str,
    *,
    max_distance: float | None = None,
    max_stops: int | None = None,
    two_opt: bool = True,
) -> dict[str, str]:
    """Check and solve many route problems.

    ``locations``: text rows with route_id, row_number and the location columns, in input order;
    ``cells``: distance cells (route_id, src, dst, dist_text); ``problems``: (route_id, start, end).
    Broken input is written to ``violations`` and stops the run.
    """
    tune(spark)
    names = locations.select("route_id", strip(F.col("name")).alias("stop"))
    edges = cells.select("route_id", strip(F.col("src")).alias("src"), strip(F.col("dst")).alias("dst"), finite_number(F.col("dist_text")).alias("dist"))
    origins = edges.select("route_id", F.col("src").alias("stop"))
    ends = problems.select("route_id", F.explode(F.array("start", "end")).alias("stop"))

    def report(df: DataFrame, where, rule, detail) -> DataFrame:
        return df.select("route_id", where.cast("string").alias("place"), rule.alias("rule"), detail.cast("string").alias("detail"))

    found = [
        report(route.location_violations(locations, ROW), F.col(ROW), F.col("rule"), F.col("detail")),
        report(route.edge_violations(cells), F.concat_ws(" -> ", "src", "dst"), F.col("rule"), F.col("detail")),
        report(route.matrix_gaps(edges), F.col("name"), F.col("problem"), F.col("missing")),
        report(checks.reconcile_keys(names, origins, ["route_id", "stop"]), F.col("stop"), F.col("side"), F.lit(None)),
        report(
            checks.orphans(ends, names, {"route_id": "route_id", "stop": "stop"}), F.col("stop"), F.lit("unknown_end"), F.lit(None)
        ),
    ]
    violations = found[0]
    for f in found[1:]:
        violations = violations.unionByName(f)
    paths = _write_all({"violations": violations}, out)
    written = spark.read.schema(violations.schema).json(paths["violations"])
    if not written.isEmpty():
        raise ValueError(f"the route input breaks its rules, see {paths['violations']}")
    stops = locations.select("route_id", strip(F.col("name")).alias("stop"), F.col(ROW).alias("input_pos"))
    tours = work_dir(spark, "tours")
    route.solve_routes(problems, stops, edges, two_opt).write.parquet(tours)
    solved = spark.read.parquet(tours)
    final = solved.where(F.col("kind") == ("optimized" if two_opt else "initial")).drop("kind")
    checked = route.route_feasibility(problems, stops, final, edges, max_distance, max_stops)
    results = route.route_results(solved, edges).join(checked.drop("distance"), "route_id").join(problems, "route_id")
    return paths | _write_all({"tours": solved, "results": results.withColumn("two_opt_applied", F.lit(two_opt))}, out)


def single_route(spark: SparkSession, locations_csv: str, distances_csv: str) -> tuple[DataFrame, DataFrame]:
    """The file pair of one problem as the tables ``run_routes`` takes, with route_id 1."""
    cells = csv.read_locations(spark, locations_csv)
    staged = work_dir(spark, "locations")
    cells.write.parquet(staged)
    places = numbered(spark.read.parquet(staged)).withColumn("route_id", F.lit(1).cast("long"))
    matrix = csv.read_matrix(spark, distances_csv)
    edges = route.matrix_to_edges(matrix, matrix.columns[0]).withColumn("route_id", F.lit(1).cast("long"))
    return places, edges


@in_run_folder
def run_images(
    spark: SparkSession,
    folder: str,
    out: str,
    *,
    output_format: str = "original",
    resize: tuple[int, int] | None = None,
    compression_quality: int | None = None,
) -> dict[str, str]:
    """Inventory of an image folder and the plan to convert each acceptable file."""
    if compression_quality is not None and not 1 <= compression_quality <= 100:
        raise ValueError("compression_quality is between 1 and 100")
    if resize is not None and min(resize) <= 0:
        raise ValueError("resize needs a positive width and height")
    listed = images.inventory(files.read_heads(tune(spark), folder))
    paths = _write_all({"inventory": listed}, out)
    sound = spark.read.schema(listed.schema).json(paths["inventory"]).where("problem is null")
    width, height = resize or (None, None)
    wishes = sound.select(
        "path",
        F.upper("format").alias("original_format"),
        F.lit(output_format).alias("requested_format"),
        F.lit(resize is not None).alias("resize"),
        F.lit(width).cast("int").alias("resize_width"),
        F.lit(height).cast("int").alias("resize_height"),
        F.lit(compression_quality is not None).alias("compression"),
        F.lit(compression_quality).cast("int").alias("compression_quality"),
    )
    return paths | _write_all({"plan": images.format_plan(wishes)}, out)
