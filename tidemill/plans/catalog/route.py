"""Routing queries. 64 consecutive vectors are the stops of one route, and a stop's vector is
its row of distances to the others; only the upper triangle is kept, so half of all lookups
use the reverse direction. Even routes return to their start, odd ones end at their last stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.scalars import hhmm_minutes
from tidemill.operators import route as R
from tidemill.plans.catalog.profile import rounded
from tidemill.plans.session import cut_lineage, load, work_dir
from tidemill.sources import csv

SIZE = 64


def stop_name(i):
    return F.concat(F.lit("S"), F.lpad(i.cast("string"), 2, "0"))


def vectors(s, d):
    i = F.pmod("vec_id", F.lit(SIZE)).cast("int")
    return load(s, d, "embeddings").select(
        F.floor(F.col("vec_id") / SIZE).alias("route_id"), i.alias("input_pos"), stop_name(i).alias("stop"), "embedding", "label"
    )


def stops(s, d):
    return vectors(s, d).select("route_id", "stop", "input_pos")


def problems(s, d):
    ends = stops(s, d).groupBy("route_id").agg(F.max("stop").alias("top"))
    return ends.select(
        "route_id", F.lit("S00").alias("start"), F.when(F.col("route_id") % 2 == 0, F.lit("S00")).otherwise(F.col("top")).alias("end")
    )


def cells(s, d):
    """Every vector component as a cell (route_id, src, src_pos, dst, dst_pos, raw)."""
    wide = vectors(s, d).select("route_id", "stop", "input_pos", "label", F.posexplode("embedding").alias("dst_pos", "raw"))
    return wide.select(
        "route_id", F.col("stop").alias("src"), F.col("input_pos").alias("src_pos"), stop_name(F.col("dst_pos")).alias("dst"),
        "dst_pos", F.col("raw").cast("double").alias("raw"), "label",
    )


def edges(s, d):
    """Distances between stops that exist, each pair stored once."""
    width = stops(s, d).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        cells(s, d)
        .join(width, "route_id")
        .where("src_pos < dst_pos and dst_pos < n")
        .select("route_id", "src", "dst", F.round(F.abs("raw"), 6).alias("dist"))
    )


def driven(s, d):
    """A given order of stops per route; some of them break the rules."""
    st = stops(s, d)
    main = st.select("route_id", F.col("input_pos").alias("pos"), stop_name(F.pmod(F.col("input_pos") * 5, F.lit(SIZE))).alias("stop"))
    back = problems(s, d).where("start = end").select("route_id", F.lit(SIZE).alias("pos"), F.col("start").alias("stop"))
    return main.unionByName(back)


BASE = """stops AS (SELECT vec_id // 64 AS route_id, (vec_id % 64)::INTEGER AS input_pos, 'S' || lpad((vec_id % 64)::VARCHAR, 2, '0') AS stop, embedding, label FROM embeddings),
problems AS (SELECT route_id, 'S00' AS start, CASE WHEN route_id % 2 = 0 THEN 'S00' ELSE max(stop) END AS fin FROM stops GROUP BY route_id),
pos64 AS (SELECT unnest(range(0, 64))::INTEGER AS k),
cells AS (SELECT route_id, stop AS src, input_pos AS src_pos, 'S' || lpad(k::VARCHAR, 2, '0') AS dst, k AS dst_pos, embedding[k + 1]::DOUBLE AS raw, label FROM stops, pos64),
edges AS (SELECT c.route_id, src, dst, round(abs(raw), 6) AS dist FROM cells c JOIN (SELECT route_id, count(*) AS n FROM stops GROUP BY 1) w ON c.route_id = w.route_id
  WHERE src_pos < dst_pos AND dst_pos < n),
two AS (SELECT route_id, src, dst, dist FROM edges UNION ALL SELECT route_id, dst, src, dist FROM edges),
driven AS (SELECT route_id, input_pos AS pos, 'S' || lpad(((input_pos * 5) % 64)::VARCHAR, 2, '0') AS stop FROM stops
  UNION ALL SELECT route_id, 64, start FROM problems WHERE start = fin),
legs AS (SELECT * FROM (SELECT route_id, pos AS leg, stop AS src, lead(stop) OVER (PARTITION BY route_id ORDER BY pos) AS dst FROM driven) WHERE dst IS NOT NULL),
priced AS (SELECT l.*, t.dist FROM legs l LEFT JOIN two t ON l.route_id = t.route_id AND l.src = t.src AND l.dst = t.dst)"""


def starts(s, d):
    return problems(s, d).select("route_id", F.col("start").alias("stop"))


def used(s, d):
    return problems(s, d).select("route_id", F.explode(F.array("start", "end")).alias("stop"))


def matrix(s, d):
    """The wide form: one column per destination."""
    v = vectors(s, d)
    return v.select("route_id", F.col("stop").alias("location"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"S{i:02d}") for i in range(SIZE)])


def q_unpivot(s, d):
    long = R.matrix_to_edges(matrix(s, d), "location", ["route_id"])
    return long.select("route_id", "src", "dst", F.round(F.col("dist_text").try_cast("double"), 4).alias("dist"))


def text_edges(s, d):
    """Cells as they might come from a file: negative, empty and unreadable ones among them."""
    raw = F.col("raw")
    text = (
        F.when(raw > 0.3, F.lit("n/a"))
        .when(raw > 0.29, F.lit("inf"))
        .when(F.abs(raw) < 0.002, F.lit("  "))
        .when(raw < -0.25, F.lit(" -1.5e-1 "))
        .otherwise(F.lit("2.5"))
    )
    all_cells = cells(s, d).select("route_id", "src", F.when(F.abs(raw) > 0.31, F.lit(" ")).otherwise(F.col("dst")).alias("dst"), text.alias("dist_text"), "raw")
    # some cells come twice
    again = all_cells.where(raw.between(0.05, 0.06)).withColumn("dst", F.concat(F.lit(" "), "dst"))
    return all_cells.unionByName(again).drop("raw")


def gap_edges(s, d):
    kept = cells(s, d).where("label <> 3")
    return kept.select("route_id", "src", "dst", F.when(F.abs("raw") > 0.002, F.abs("raw")).alias("dist"))


def locations(s, d):
    bal, key = F.col("c_acctbal"), F.col("c_custkey")
    return load(s, d, "customer").select(
        F.col("c_nationkey").cast("long").alias("route_id"),
        key.alias("row_no"),
        F.when(bal < -900, F.lit(" ")).otherwise(F.col("c_name")).alias("id"),
        F.when(bal > 9900, F.lit("")).otherwise(F.concat(F.lit("P"), F.substring("c_name", 17, 2))).alias("name"),
        F.when(bal > 9000, F.lit("2.5")).otherwise(F.floor(bal / 100).cast("string")).alias("demand"),
        F.when(bal.between(8000, 8100), F.lit("x")).when(bal < -990, F.lit("-1")).otherwise(F.lit(" 3 ")).alias("priority"),
        F.concat(F.lpad((key % 26).cast("string"), 2, "0"), F.lit(":30")).alias("window_start"),
        F.when(bal.between(7000, 7050), F.lit("8:3")).otherwise(F.lit("12:00")).alias("window_end"),
    )


LOCATIONS = """loc AS (SELECT c_nationkey::BIGINT AS route_id, c_custkey AS row_no,
  CASE WHEN c_acctbal < -900 THEN ' ' ELSE c_name END AS id,
  CASE WHEN c_acctbal > 9900 THEN '' ELSE 'P' || substr(c_name, 17, 2) END AS name,
  CASE WHEN c_acctbal > 9000 THEN '2.5' ELSE floor(c_acctbal / 100)::BIGINT::VARCHAR END AS demand,
  CASE WHEN c_acctbal BETWEEN 8000 AND 8100 THEN 'x' WHEN c_acctbal < -990 THEN '-1' ELSE ' 3 ' END AS priority,
  lpad((c_custkey % 26)::VARCHAR, 2, '0') || ':30' AS window_start,
  CASE WHEN c_acctbal BETWEEN 7000 AND 7050 THEN '8:3' ELSE '12:00' END AS window_end FROM customer)"""


def clock_texts(s, d):
    full = F.date_format("ts", "HH:mm")
    text = (
        F.when(F.col("value") < 1, F.date_format("ts", "HH:mm:ss"))
        .when(F.col("value") > 200, F.lit("9:05"))
        .when(F.col("value").between(100, 150), F.lit("24:00"))
        .when(F.col("value").between(50, 60), F.concat(F.lit(" "), full, F.lit("  ")))
        .otherwise(full)
    )
    return load(s, d, "events").select("event_id", text.alias("clock"))


def solved(s, d):
    return R.solve_routes(problems(s, d), stops(s, d), edges(s, d))


def q_tour_rules(s, d):
    """What holds for any improved tour: the same stops and ends, a length that is not larger, and no reversal left that shortens it."""
    found = cut_lineage(solved(s, d))
    tours = found.groupBy("route_id").pivot("kind", ["initial", "optimized"]).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("stop").alias("stops"), F.min_by("stop", "pos").alias("first"), F.max_by("stop", "pos").alias("last")
    )
    lengths = R.route_results(found, edges(s, d)).select("route_id", "initial_distance", "optimized_distance", "improvement_percentage")
    gain = (F.col("initial_distance") - F.col("optimized_distance")) / F.col("initial_distance") * 100
    left = R.improving_changes(found.where("kind = 'optimized'").drop("kind"), edges(s, d))
    return tours.join(lengths, "route_id").join(problems(s, d), "route_id").join(left, "route_id").select(
        "route_id",
        F.col("optimized_n").alias("n"),
        F.col("optimized_stops").alias("stops"),
        ((F.col("initial_n") == F.col("optimized_n")) & (F.col("initial_stops") == F.col("optimized_stops"))).alias("same_stops"),
        ((F.col("optimized_first") == F.col("start")) & (F.col("optimized_last") == F.col("end"))).alias("same_ends"),
        (F.col("optimized_distance") <= F.col("initial_distance") + 1e-9).alias("not_longer"),
        (F.abs(F.col("improvement_percentage") - gain) < 1e-6).alias("percentage_fits"),
        (F.col("changes") == 0).alias("no_gain_left"),
    )


def q_wide_matrix(s, d):
    """The same cells from a file, taken apart by position."""
    path = work_dir(s, "matrix-csv")
    matrix(s, d).write.option("header", True).csv(path)
    long = csv.matrix_edges(s, path, "location", ["route_id"])
    return rounded(long.select(F.col("route_id").cast("long").alias("route_id"), "src", "dst", F.col("dist_text").cast("double").alias("dist")))


QUERIES = {
    "matrix_by_position": q_wide_matrix,
    "route_2opt_rules": q_tour_rules,
    "matrix_unpivot": q_unpivot,
    "hhmm_minutes": lambda s, d: clock_texts(s, d).withColumn("minutes", hhmm_minutes(F.col("clock"))),
    "location_violations": lambda s, d: R.location_violations(locations(s, d), "row_no"),
    "edge_violations": lambda s, d: R.edge_violations(text_edges(s, d)).drop("detail"),
    "matrix_gaps": lambda s, d: R.matrix_gaps(gap_edges(s, d)),
    "candidate_edges": lambda s, d: R.candidate_edges(starts(s, d), used(s, d), edges(s, d)),
    "nearest_stop": lambda s, d: R.nearest_candidates(R.candidate_edges(starts(s, d), used(s, d), edges(s, d)), stops(s, d)),
    "route_legs": lambda s, d: R.route_legs(driven(s, d)),
    "edge_lookup": lambda s, d: R.lookup_distances(R.route_legs(driven(s, d)), edges(s, d)),
    "route_length": lambda s, d: rounded(R.route_lengths(driven(s, d), edges(s, d))),
    "route_nn": lambda s, d: R.solve_routes(problems(s, d), stops(s, d), edges(s, d), two_opt=False).drop("kind"),
    "route_2opt": lambda s, d: solved(s, d).where("kind = 'optimized'").drop("kind"),
    "route_result": lambda s, d: rounded(R.route_results(solved(s, d), edges(s, d))),
    "route_feasibility": lambda s, d: rounded(
        R.route_feasibility(problems(s, d), stops(s, d), driven(s, d), edges(s, d), max_distance=6.4, max_stops=63)
    ),
}

SQL = {
    "route_2opt_rules": f"""WITH {BASE} SELECT p.route_id, count(*) + CASE WHEN start = fin THEN 1 ELSE 0 END AS n, count(DISTINCT s.stop) AS stops,
  true AS same_stops, true AS same_ends, true AS not_longer, true AS percentage_fits, true AS no_gain_left
FROM problems p JOIN stops s ON s.route_id = p.route_id GROUP BY p.route_id, start, fin""",
    "matrix_by_position": f"WITH {BASE} SELECT route_id, src, dst, round(raw, 4) AS dist FROM cells",
    "matrix_unpivot": f"WITH {BASE} SELECT route_id, src, dst, round(raw, 4) AS dist FROM cells",
    "hhmm_minutes": r"""WITH c AS (SELECT event_id, CASE WHEN value < 1 THEN strftime(ts, '%H:%M:%S') WHEN value > 200 THEN '9:05'
  WHEN value BETWEEN 100 AND 150 THEN '24:00' WHEN value BETWEEN 50 AND 60 THEN ' ' || strftime(ts, '%H:%M') || '  ' ELSE strftime(ts, '%H:%M') END AS clock FROM events)
SELECT event_id, clock, CASE WHEN regexp_full_match(trim(clock), '([01][0-9]|2[0-3]):[0-5][0-9]')
  THEN substr(trim(clock), 1, 2)::INTEGER * 60 + substr(trim(clock), 4, 2)::INTEGER END AS minutes FROM c""",
    "location_violations": f"""WITH {LOCATIONS}, p AS (SELECT *, try_cast(CASE WHEN regexp_full_match(trim(demand), '[+-]?[0-9]+') THEN trim(demand) END AS BIGINT) AS dm,
    try_cast(CASE WHEN regexp_full_match(trim(priority), '[+-]?[0-9]+') THEN trim(priority) END AS BIGINT) AS pr,
    CASE WHEN regexp_full_match(window_start, '([01][0-9]|2[0-3]):[0-5][0-9]') THEN window_start END AS ws,
    CASE WHEN regexp_full_match(window_end, '([01][0-9]|2[0-3]):[0-5][0-9]') THEN window_end END AS we FROM loc)
SELECT route_id, row_no, 'missing_id' AS rule, id AS detail FROM p WHERE trim(id) = ''
UNION ALL SELECT route_id, row_no, 'missing_name', name FROM p WHERE trim(name) = ''
UNION ALL SELECT route_id, row_no, 'invalid_demand', demand FROM p WHERE dm IS NULL
UNION ALL SELECT route_id, row_no, 'negative_demand', demand FROM p WHERE dm < 0
UNION ALL SELECT route_id, row_no, 'invalid_priority', priority FROM p WHERE pr IS NULL
UNION ALL SELECT route_id, row_no, 'negative_priority', priority FROM p WHERE pr < 0
UNION ALL SELECT route_id, row_no, 'invalid_window_start', window_start FROM p WHERE ws IS NULL
UNION ALL SELECT route_id, row_no, 'invalid_window_end', window_end FROM p WHERE we IS NULL
UNION ALL SELECT route_id, row_no, 'window_reversed', window_start || '-' || window_end FROM p WHERE ws > we
UNION ALL SELECT route_id, row_no, 'duplicate_id', id FROM (SELECT *, row_number() OVER (PARTITION BY route_id, trim(id) ORDER BY row_no) AS rn FROM p WHERE trim(id) <> '') WHERE rn > 1
UNION ALL SELECT route_id, row_no, 'duplicate_name', name FROM (SELECT *, row_number() OVER (PARTITION BY route_id, trim(name) ORDER BY row_no) AS rn FROM p WHERE trim(name) <> '') WHERE rn > 1""",
    "edge_violations": f"""WITH {BASE}, t AS (SELECT route_id, src, CASE WHEN abs(raw) > 0.31 THEN ' ' ELSE dst END AS dst,
  CASE WHEN raw > 0.3 THEN 'n/a' WHEN raw > 0.29 THEN 'inf' WHEN abs(raw) < 0.002 THEN '' WHEN raw < -0.25 THEN '-1.5e-1' ELSE '2.5' END AS cell, raw FROM cells)
SELECT route_id, src, dst, 'duplicate_pair' AS rule FROM t WHERE raw BETWEEN 0.05 AND 0.06
UNION ALL SELECT route_id, src, dst, 'blank_dst' AS rule FROM t WHERE trim(dst) = ''
UNION ALL SELECT route_id, src, dst, 'missing_distance' FROM t WHERE cell = ''
UNION ALL SELECT route_id, src, dst, 'invalid_distance' FROM t WHERE cell IN ('n/a', 'inf')
UNION ALL SELECT route_id, src, dst, 'negative_distance' FROM t WHERE cell = '-1.5e-1'""",
    "matrix_gaps": f"""WITH {BASE}, e AS (SELECT route_id, src, dst, CASE WHEN abs(raw) > 0.002 THEN abs(raw) END AS dist FROM cells WHERE label <> 3),
  h AS (SELECT DISTINCT route_id, dst AS name FROM e), r AS (SELECT route_id, src AS name, count(DISTINCT dst) AS cells FROM e WHERE dist IS NOT NULL GROUP BY 1, 2),
  w AS (SELECT route_id, count(*) AS width FROM h GROUP BY 1)
SELECT h.route_id, h.name, CASE WHEN r.cells IS NULL THEN 'missing_row' ELSE 'incomplete_row' END AS problem, width - coalesce(r.cells, 0) AS missing
FROM h JOIN w ON h.route_id = w.route_id LEFT JOIN r ON r.route_id = h.route_id AND r.name = h.name WHERE coalesce(r.cells, 0) < width""",
    "candidate_edges": f"""WITH {BASE} SELECT t.route_id, src, dst, dist FROM two t JOIN problems p ON t.route_id = p.route_id
WHERE src = start AND dst <> start AND dst <> fin""",
    "nearest_stop": f"""WITH {BASE}, r AS (SELECT t.route_id, src, dst, dist, row_number() OVER (PARTITION BY t.route_id ORDER BY dist, s.input_pos) AS rn
  FROM two t JOIN problems p ON t.route_id = p.route_id JOIN stops s ON s.route_id = t.route_id AND s.stop = t.dst
  WHERE src = start AND dst <> start AND dst <> fin)
SELECT route_id, src, dst AS nearest, dist FROM r WHERE rn = 1""",
    "route_legs": f"WITH {BASE} SELECT route_id, leg, src, dst FROM legs",
    "edge_lookup": f"WITH {BASE} SELECT route_id, leg, src, dst, dist FROM priced",
    "route_length": f"""WITH {BASE}, n AS (SELECT route_id, count(*) AS stops FROM driven GROUP BY 1)
SELECT n.route_id, n.stops, round(coalesce(sum(dist), 0), 4) AS distance, count(*) FILTER (WHERE p.route_id IS NOT NULL AND dist IS NULL) AS unknown_legs
FROM n LEFT JOIN priced p ON n.route_id = p.route_id GROUP BY 1, 2""",
    "route_nn": f"""WITH RECURSIVE {BASE}, nn AS (
  SELECT route_id, 0 AS pos, start AS stop, [start, fin] AS seen FROM problems
  UNION ALL
  SELECT route_id, pos + 1, dst, list_append(seen, dst) FROM (
    SELECT nn.route_id, nn.pos, nn.seen, t.dst, row_number() OVER (PARTITION BY nn.route_id ORDER BY t.dist, s.input_pos) AS rn
    FROM nn JOIN two t ON t.route_id = nn.route_id AND t.src = nn.stop JOIN stops s ON s.route_id = t.route_id AND s.stop = t.dst
    WHERE NOT list_contains(nn.seen, t.dst)) WHERE rn = 1)
SELECT route_id, pos, stop FROM nn
UNION ALL SELECT p.route_id, max(pos) + 1, any_value(fin) FROM nn JOIN problems p ON p.route_id = nn.route_id GROUP BY p.route_id""",
    "route_feasibility": f"""WITH {BASE}, e AS (SELECT route_id, count(*) AS stops, arg_min(stop, pos) AS f, arg_max(stop, pos) AS l, min(pos) AS p0, max(pos) AS p1 FROM driven GROUP BY 1),
  v AS (SELECT d.route_id, d.stop, count(*) AS visits FROM driven d JOIN e ON e.route_id = d.route_id WHERE pos > p0 AND pos < p1 GROUP BY 1, 2),
  q AS (SELECT s.route_id, s.stop FROM stops s JOIN problems p ON p.route_id = s.route_id WHERE s.stop <> start AND s.stop <> fin),
  t AS (SELECT coalesce(v.route_id, q.route_id) AS route_id, count(*) FILTER (WHERE q.stop IS NULL) AS unk, count(*) FILTER (WHERE v.stop IS NULL) AS mis,
    count(*) FILTER (WHERE visits > 1) AS dup, count(*) FILTER (WHERE v.stop IS NOT NULL) AS interior
    FROM v FULL JOIN q ON v.route_id = q.route_id AND v.stop = q.stop GROUP BY 1),
  g AS (SELECT route_id, coalesce(sum(dist), 0) AS distance, count(*) FILTER (WHERE dist IS NULL) AS ul FROM priced GROUP BY 1),
  z AS (SELECT e.route_id, stops, round(distance, 4) AS distance, concat_ws(',', CASE WHEN f <> start THEN 'wrong_start' END, CASE WHEN l <> fin THEN 'wrong_end' END,
    CASE WHEN unk > 0 THEN 'unknown_stop' END, CASE WHEN mis > 0 THEN 'missing_stop' END, CASE WHEN dup > 0 THEN 'duplicate_stop' END,
    CASE WHEN ul > 0 THEN 'unknown_distance' END, CASE WHEN distance > 6.4 THEN 'max_distance' END, CASE WHEN interior > 63 THEN 'max_stops' END) AS violations
    FROM e JOIN problems p ON p.route_id = e.route_id JOIN t ON t.route_id = e.route_id JOIN g ON g.route_id = e.route_id)
SELECT *, violations = '' AS feasible FROM z""",
}
