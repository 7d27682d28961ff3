"""Queries on what runs take in and give out."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodestone.operators import contract as C
from lodestone.plans.registry import query
from lodestone.sources import adapters as A


@query("request_modes", "WITH m AS (SELECT event_id, lower(trim(CASE event_id % 6 WHEN 0 THEN ' Economic ' WHEN 1 THEN 'anomaly' WHEN 2 THEN 'full' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE event_type END)) AS a FROM events), c AS (SELECT event_id, coalesce(nullif(a, ''), 'exploration') AS a FROM m) SELECT event_id, CASE WHEN a IN ('exploration', 'full', 'anomaly', 'economic') THEN a ELSE 'exploration' END AS mode, a NOT IN ('exploration', 'full', 'anomaly', 'economic') AS warned FROM c")
def request_modes(spark, sf_dir):
    k = F.col("event_id") % 6
    asked = F.when(k == 0, " Economic ").when(k == 1, "anomaly").when(k == 2, "full").when(k == 3, "").when(k == 4, F.lit(None)).otherwise(F.col("event_type"))
    mode, warned = C.mode(asked)
    return A.table(spark, sf_dir, "events").select("event_id", mode.alias("mode"), warned.alias("warned"))


@query("input_problems", """
WITH p AS (SELECT x_m, y_m, z_m, count(*) AS k FROM v_sensors GROUP BY ALL), s AS (SELECT coalesce(sum(k - 1), 0) AS twice FROM p)
SELECT 'coordinates repeated' AS problem, CAST(twice AS BIGINT) AS n FROM s WHERE twice > 0 UNION ALL SELECT 'too many voxels', 240000 UNION ALL SELECT 'depth below the grid', 1""")
def input_problems(spark, sf_dir):
    return C.input_problems(A.sensors(spark, sf_dir), 80, 50, 60, 25.0, 1300.0, 120.0, -23.5, -68.2)


@query("voxel_output", """
WITH v AS (SELECT voxel_id, CASE WHEN voxel_id % 13 <> 0 THEN density END AS density, probability FROM v_voxels)
SELECT voxel_id, density IS NOT NULL AS is_active, density, CASE WHEN density IS NOT NULL THEN probability END AS probability, round(CASE WHEN density IS NOT NULL THEN least(1, greatest(0, density - CAST(2.75 AS DOUBLE)) / CAST(2.75 AS DOUBLE)) END, 9) AS density_anomaly_score FROM v""")
def voxel_output(spark, sf_dir):
    air = F.when(F.col("voxel_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("density"))
    return C.voxel_output(A.voxels(spark, sf_dir).withColumn("density", air)).withColumn("density_anomaly_score", F.round("density_anomaly_score", 9))


@query("targeting_frame", "SELECT voxel_id, round(density - CAST(2.6 AS DOUBLE), 9) AS density_contrast, round(density * 1000000, 4) AS bulk_rock_mass_kg, round(density * probability, 9) AS exploration_index FROM v_voxels")
def targeting_frame(spark, sf_dir):
    t = C.targeting_frame(A.voxels(spark, sf_dir), 125.0)
    return t.select("voxel_id", F.round("density_contrast", 9).alias("density_contrast"), F.round("bulk_rock_mass_kg", 4).alias("bulk_rock_mass_kg"), F.round("exploration_index", 9).alias("exploration_index"))


@query("targeting_target", "SELECT arg_max(voxel_id, (density * probability, -voxel_id)) AS voxel_id, max(density * probability) AS exploration_index FROM v_voxels")
def targeting_target(spark, sf_dir):
    t = C.targeting_frame(A.voxels(spark, sf_dir), 25.0)
    return t.agg(F.max_by("voxel_id", F.struct("exploration_index", -F.col("voxel_id"))).alias("voxel_id"), F.max("exploration_index").alias("exploration_index"))


@query("grade_by_depth", "SELECT voxel_id, CASE WHEN y < 80 THEN 1 ELSE 2 END AS domain, round(greatest(0, CASE WHEN y < 80 THEN (density - CAST(2.6 AS DOUBLE)) * CAST(1.2 AS DOUBLE) ELSE (density - CAST(2.8 AS DOUBLE)) * CAST(2.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) END), 9) AS grade FROM v_voxels")
def grade_by_depth(spark, sf_dir):
    domain, grade = C.grade_by_depth(F.col("y"), F.col("density"))
    return A.voxels(spark, sf_dir).select("voxel_id", domain.alias("domain"), F.round(grade, 9).alias("grade"))


@query("json_cells", """
SELECT voxel_id, x - 250 AS cx, 125 - y AS cy, z - 125 AS cz, CASE WHEN voxel_id % 13 <> 0 THEN density END AS density FROM v_voxels""")
def json_cells(spark, sf_dir):
    """The cells' JSON, read back."""
    air = F.when(F.col("voxel_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("density"))
    cells = C.centred_json(A.voxels(spark, sf_dir).withColumn("density", air), ["density"], (250.0, 125.0, 125.0))
    back = F.from_json("cell", "cx double, cy double, cz double, density double")
    return cells.select("voxel_id", back.alias("b")).select("voxel_id", "b.*")


@query("report_gate", """
WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS score, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 100 < 30 THEN 'Muy Bajo' ELSE 'ALTO' END END AS level, CASE o_orderstatus WHEN 'P' THEN 'low' ELSE 'GOOD' END AS overall, CASE WHEN o_orderpriority LIKE '1%' THEN 'BAJA' ELSE 'ALTA' END AS quality FROM orders),
r AS (SELECT *, concat_ws(',', CASE WHEN coalesce(score, 0) < 25 OR upper(coalesce(level, '')) = 'MUY BAJO' THEN 'favorability' END, CASE WHEN upper(overall) = 'LOW' THEN 'technical quality' END, CASE WHEN quality IN ('BAJA', 'INSUFICIENTE') THEN 'input quality' END) AS why FROM g)
SELECT o_orderkey, CASE WHEN score IS NULL AND level IS NULL THEN 'NOT_EVALUATED' WHEN why <> '' THEN 'GATE_FAIL' ELSE 'GATE_PASS' END AS state, CASE WHEN score IS NULL AND level IS NULL THEN 'not evaluated' ELSE why END AS reasons FROM r""")
def report_gate(spark, sf_dir):
    k = F.col("o_orderkey")
    known = k % 7 != 0
    state, reasons = C.economic_gate(F.when(known, (k % 100).cast("double")), F.when(known, F.when(k % 100 < 30, "Muy Bajo").otherwise("ALTO")), F.when(F.col("o_orderstatus") == "P", "low").otherwise("GOOD"), F.when(F.col("o_orderpriority").startswith("1"), "BAJA").otherwise("ALTA"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), F.array_join(reasons, ",").alias("reasons"))


@query("fav_satellite", """
WITH s AS (SELECT c_custkey, c_custkey % 5 <> 0 AS cached, CASE WHEN c_custkey % 3 <> 0 THEN 'evaluated' ELSE 'failed' END AS spectral, CASE WHEN c_custkey % 4 <> 0 THEN 'evaluated' END AS support, c_acctbal / 10000 AS v FROM customer), o AS (SELECT *, coalesce(cached AND spectral = 'evaluated' AND support = 'evaluated' AND v >= 0, false) AS ok FROM s)
SELECT c_custkey, round(CASE WHEN ok THEN v END, 9) AS value, CASE WHEN ok THEN 'evaluated' ELSE 'not_evaluated' END AS status FROM o""")
def fav_satellite(spark, sf_dir):
    k = F.col("c_custkey")
    value, status = C.satellite_factor(k % 5 != 0, F.when(k % 3 != 0, "evaluated").otherwise("failed"), F.when(k % 4 != 0, "evaluated"), F.col("c_acctbal") / 10000)
    return A.table(spark, sf_dir, "customer").select("c_custkey", F.round(value, 9).alias("value"), status.alias("status"))


@query("bbox_expand", """
WITH b AS (SELECT s_suppkey, CAST(s_suppkey % 80 AS DOUBLE) AS a, CAST(s_suppkey % 80 + s_suppkey % 3 AS DOUBLE) AS b, CAST(s_suppkey % 170 AS DOUBLE) AS c, CAST(s_suppkey % 170 + s_suppkey % 4 AS DOUBLE) AS d FROM supplier), f AS (SELECT *, b > a AND d > c AS ok FROM b)
SELECT s_suppkey, round(CASE WHEN ok THEN a - (b - a) * CAST(0.25 AS DOUBLE) END, 9) AS min_lat, round(CASE WHEN ok THEN b + (b - a) * CAST(0.25 AS DOUBLE) END, 9) AS max_lat, round(CASE WHEN ok THEN c - (d - c) * CAST(0.25 AS DOUBLE) END, 9) AS min_lon, round(CASE WHEN ok THEN d + (d - c) * CAST(0.25 AS DOUBLE) END, 9) AS max_lon FROM f""")
def bbox_expand(spark, sf_dir):
    k = F.col("s_suppkey")
    d = lambda c: c.cast("double")
    box = C.bbox(d(k % 80), d(k % 80 + k % 3), d(k % 170), d(k % 170 + k % 4), 1.5)
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", box.alias("b")).select("s_suppkey", *[F.round(f"b.{c}", 9).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query("elevation_range", """
WITH e AS (SELECT voxel_id, CASE WHEN voxel_id % 11 <> 0 THEN 1000 - y END AS voxel_elevation, 1000 + CAST(voxel_id % 7 AS DOUBLE) AS surface_elevation, CASE WHEN voxel_id > 5 THEN 'dem-' || (voxel_id % 3) END AS source FROM v_voxels)
SELECT min(voxel_elevation) AS min_voxel_elevation, max(voxel_elevation) AS max_voxel_elevation, min(surface_elevation) AS min_surface_elevation, max(surface_elevation) AS max_surface_elevation, arg_min(source, voxel_id) AS source FROM e""")
def elevation_range(spark, sf_dir):
    k = F.col("voxel_id")
    e = A.voxels(spark, sf_dir).select("voxel_id", F.when(k % 11 == 0, float("inf")).otherwise(1000 - F.col("y")).alias("voxel_elevation"), (1000 + (k % 7).cast("double")).alias("surface_elevation"), F.when(k > 5, F.concat(F.lit("dem-"), (k % 3).cast("string"))).alias("source"))
    return C.finite_range(e, ["voxel_elevation", "surface_elevation"]).join(e.agg(C.first_text("source", "voxel_id").alias("source")))  # one row each


@query("ordered_warnings", """
WITH f AS (SELECT o_custkey, o_orderpriority AS w, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(w, ';' ORDER BY k) AS warnings FROM f GROUP BY o_custkey""")
def ordered_warnings(spark, sf_dir):
    first = A.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))  # so that a hot key's list has its distinct values only
    return first.groupBy("o_custkey").agg(F.array_join(C.in_first_order(F.col("o_orderpriority"), F.col("k")), ";").alias("warnings"))


@query("alias_intersection", """
WITH w AS (SELECT DISTINCT p_partkey, lower(trim(unnest(string_split(p_name, ' ')))) AS w FROM part) SELECT p_partkey, coalesce(string_agg(w, ',' ORDER BY w) FILTER (w IN ('steel', 'small', 'red', 'large', 'brass', 'blue')), '') AS found FROM w GROUP BY p_partkey""")
def alias_intersection(spark, sf_dir):
    known = F.array(*map(F.lit, ("steel", "small", "red", "large", "brass", "blue")))
    words = F.transform(F.split("p_name", " "), lambda w: F.lower(F.trim(w)))
    return A.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(words, known)), ",").alias("found"))


@query("merged_properties", """
SELECT s_suppkey, 'nation' AS k1, CAST(s_nationkey AS VARCHAR) AS v1, CASE WHEN s_suppkey % 2 = 0 THEN 'late' ELSE 'early' END AS stage FROM supplier""")
def merged_properties(spark, sf_dir):
    """Two maps merged; the later one's values win."""
    early = F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("stage"), F.lit("early"))
    late = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("stage"), F.lit("late"))).otherwise(F.map_filter(early, lambda k, v: F.lit(False)))
    merged = F.map_concat(F.map_filter(early, lambda k, v: ~F.map_contains_key(late, k)), late)
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("nation").alias("k1"), F.element_at(merged, "nation").alias("v1"), F.element_at(merged, "stage").alias("stage"))


@query("parallel_arrays", """
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) - 1 AS INTEGER) AS pos, l_quantity AS q, l_tax AS t FROM lineitem""")
def parallel_arrays(spark, sf_dir):
    item = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")))
    a = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(item.alias("i")).select("l_orderkey", F.col("i.l_quantity").alias("q"), F.col("i.l_tax").alias("t"))
    return C.zipped(a, "l_orderkey", ["q", "t"])


@query("survey_preview", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5")
def survey_preview(spark, sf_dir):
    return C.first_rows(A.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_custkey", 5)


@query("sphere_reference", f"SELECT obs_id, round(CAST(6.6743e-11 AS DOUBLE) * CAST({4 / 3 * math.pi * 50**3 * 500!r} AS DOUBLE) * 120 / pow(pow(x_m - 250, 2) + pow(z_m - 125, 2) + 14400, CAST(1.5 AS DOUBLE)) * 1e9, 6) AS d_nano FROM v_sensors")
def sphere_reference(spark, sf_dir):
    return A.sensors(spark, sf_dir).select("obs_id", F.round(C.sphere_gravity(F.col("x_m") - 250, F.col("z_m") - 125, 120.0, 50.0, 500.0) * 1e9, 6).alias("d_nano"))
