"""Queries on station tables: profile, units, duplicates, outliers, georeference, grid sizing, status windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.operators import profile as P
from lodestone.plans.registry import query
from lodestone.sources import adapters as A



@query("station_profile", """
SELECT count(*) AS n, min(x_m) AS x_min, max(x_m) AS x_max, max(x_m) - min(x_m) AS x_span, min(z_m) AS z_min, max(z_m) AS z_max, max(z_m) - min(z_m) AS z_span,
  round((max(x_m) - min(x_m)) * (max(z_m) - min(z_m)) / CAST(1000000 AS DOUBLE), 6) AS area_km2,
  round(sqrt((max(x_m) - min(x_m)) * (max(z_m) - min(z_m)) / count(*)), 6) AS mean_spacing_m,
  min(g) AS g_min, max(g) AS g_max, round(avg(g), 6) AS g_mean, round(stddev_pop(g), 6) AS g_std,
  round(quantile_cont(g, CAST(0.05 AS DOUBLE)), 6) AS g_p5, round(quantile_cont(g, CAST(0.95 AS DOUBLE)), 6) AS g_p95 FROM v_obs""")
def station_profile(spark, sf_dir):
    span = lambda c: F.max(c) - F.min(c)
    n = F.count("*")
    size = P.sampling(n, span("x_m"), span("z_m"))
    ends = [f(c).alias(f"{c[0]}_{n}") for c in ("x_m", "z_m", "g") for f, n in ((F.min, "min"), (F.max, "max"))]
    return A.observations(spark, sf_dir).agg(n.alias("n"), *ends, span("x_m").alias("x_span"), span("z_m").alias("z_span"), F.round(size["area_km2"], 6).alias("area_km2"), F.round(size["mean_spacing_m"], 6).alias("mean_spacing_m"), F.round(F.avg("g"), 6).alias("g_mean"), F.round(F.stddev_pop("g"), 6).alias("g_std"), F.round(F.percentile("g", 0.05), 6).alias("g_p5"), F.round(F.percentile("g", 0.95), 6).alias("g_p95"))


@query("station_outliers", """
WITH o AS (SELECT obs_id, x_m, z_m, CASE WHEN obs_id % 97 = 0 THEN g * 8 ELSE g END AS g FROM v_obs), s AS (SELECT avg(g) AS m, stddev_pop(g) AS d FROM o)
SELECT obs_id, x_m, z_m, g, round((g - m) / d, 6) AS zscore FROM o, s WHERE d > 0 AND abs((g - m) / d) > 3""")
def station_outliers(spark, sf_dir):
    """Beyond three deviations; one value in 97 is eight times too great."""
    o = A.observations(spark, sf_dir).withColumn("g", F.when(F.col("obs_id") % 97 == 0, F.col("g") * 8).otherwise(F.col("g")))
    return P.zscores(o, "g").where(F.abs("zscore") > 3).select("obs_id", "x_m", "z_m", "g", F.round("zscore", 6).alias("zscore"))


@query("station_exact_dedup", """
SELECT x, y, z, g, CAST(n AS BIGINT) AS n_copies FROM (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY src_row) AS r, count(*) OVER (PARTITION BY x, y, z) AS n FROM v_obs_dups) WHERE r = 1""")
def station_exact_dedup(spark, sf_dir):
    return P.first_of_duplicates(A.station_rows(spark, sf_dir), ["x", "y", "z"], "src").select("x", "y", "z", "g", "n_copies")


@query("station_duplicate_examples", """
WITH d AS (SELECT x, y, z, count(*) - 1 AS dropped FROM v_obs_dups GROUP BY ALL HAVING count(*) > 1)
SELECT x, y, z, dropped FROM d ORDER BY dropped DESC, x, y, z LIMIT 3""")
def station_duplicate_examples(spark, sf_dir):
    d = A.station_rows(spark, sf_dir).groupBy("x", "y", "z").agg((F.count("*") - 1).alias("dropped")).where("dropped > 0")
    return d.orderBy(F.desc("dropped"), "x", "y", "z").limit(3)


@query("station_near_duplicates", """
WITH p AS (SELECT DISTINCT x, y, z FROM v_obs_dups), o AS (SELECT CAST(x AS BIGINT) * 1000000 + CAST(y AS BIGINT) * 1000 + CAST(z AS BIGINT) AS id, * FROM p)
SELECT a.id AS i, b.id AS j, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS distance
FROM o a JOIN o b ON b.id < a.id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1
WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) BETWEEN CAST(1e-12 AS DOUBLE) AND 1""")
def station_near_duplicates(spark, sf_dir):
    p = A.station_rows(spark, sf_dir).select("x", "y", "z").distinct()
    p = p.withColumn("id", F.col("x").cast("long") * 1_000_000 + F.col("y").cast("long") * 1000 + F.col("z").cast("long"))
    return P.near_pairs(p, "id", ["x", "y", "z"], 1.0).select("i", "j", F.round("distance", 6).alias("distance"))


@query("unit_conversion", """
SELECT obs_id, unit, round(CASE unit WHEN 'mGal' THEN g * CAST(1e-5 AS DOUBLE) WHEN 'uGal' THEN g * CAST(1e-8 AS DOUBLE) ELSE g END, 7) AS g_ms2 FROM v_obs""")
def unit_conversion(spark, sf_dir):
    return A.observations(spark, sf_dir).select("obs_id", "unit", F.round(P.to_ms2(F.col("g"), F.col("unit")), 7).alias("g_ms2"))


@query("unit_consistency", """
SELECT unit, max(abs(g)) AS max_abs, max(abs(g)) <= CASE unit WHEN 'mGal' THEN 100000 WHEN 'm/s2' THEN 20 ELSE 1000000000 END AS consistent FROM v_obs GROUP BY unit""")
def unit_consistency(spark, sf_dir):
    limit = F.when(F.col("unit") == "mGal", 1e5).when(F.col("unit") == "m/s2", 20.0).otherwise(1e9)
    return A.observations(spark, sf_dir).groupBy("unit").agg(F.max(F.abs("g")).alias("max_abs")).withColumn("consistent", F.col("max_abs") <= limit)


@query("row_validation", """
WITH r AS (SELECT obs_id, CASE WHEN obs_id % 11 = 0 THEN '' WHEN obs_id % 13 = 0 THEN 'mgals' ELSE unit END AS unit, CASE obs_id % 7 WHEN 0 THEN 'x' WHEN 1 THEN 'NaN' ELSE CAST(obs_id AS VARCHAR) END AS t FROM v_obs),
f AS (SELECT trim(arg_min(unit, obs_id)) AS u FROM r WHERE trim(unit) <> '')
SELECT obs_id, CASE WHEN trim(unit) = '' THEN 'missing' WHEN trim(unit) NOT IN ('mGal', 'uGal', 'm/s2') THEN 'unsupported' WHEN trim(unit) <> u THEN 'mixed' END AS unit_error,
  CASE WHEN isfinite(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END AS value FROM r, f""")
def row_validation(spark, sf_dir):
    k = F.col("obs_id")
    rows = A.observations(spark, sf_dir).select("obs_id", F.when(k % 11 == 0, "").when(k % 13 == 0, "mgals").otherwise(F.col("unit")).alias("unit"), F.when(k % 7 == 0, "x").when(k % 7 == 1, "NaN").otherwise(k.cast("string")).alias("t"))
    first = rows.where(F.trim("unit") != "").agg(F.trim(F.min_by("unit", "obs_id")).alias("u"))
    return rows.join(F.broadcast(first)).select("obs_id", P.unit_error(F.col("unit"), F.col("u")).alias("unit_error"), P.strict_number(F.col("t")).alias("value"))


@query("station_ids", "SELECT obs_id, coalesce(nullif(trim(CASE WHEN obs_id % 3 = 0 THEN ' ' ELSE 'S' || obs_id END), ''), printf('ST_%06d', obs_id)) AS station_id FROM v_obs")
def station_ids(spark, sf_dir):
    given = F.when(F.col("obs_id") % 3 == 0, " ").otherwise(F.concat(F.lit("S"), F.col("obs_id").cast("string")))
    return A.observations(spark, sf_dir).select("obs_id", F.coalesce(F.nullif(F.trim(given), F.lit("")), F.format_string("ST_%06d", "obs_id")).alias("station_id"))


@query("value_presence", """
SELECT 'unit' AS col, max(CASE WHEN lower(trim(unit)) IN ('', 'nan', 'null', 'none', 'na', 'n/a') THEN 0 ELSE 1 END) = 1 AS present FROM v_obs
UNION ALL SELECT 'blank', max(CASE WHEN lower(trim(CASE obs_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN ' ' WHEN 2 THEN 'N/A' ELSE 'none' END)) IN ('', 'nan', 'null', 'none', 'na', 'n/a') THEN 0 ELSE 1 END) = 1 FROM v_obs""")
def value_presence(spark, sf_dir):
    k = F.col("obs_id") % 4
    blank = F.when(k == 0, "NaN").when(k == 1, " ").when(k == 2, "N/A").otherwise("none")
    said = lambda c: F.max(~F.lower(F.trim(c)).isin("", "nan", "null", "none", "na", "n/a"))
    one = A.observations(spark, sf_dir).agg(said(F.col("unit")).alias("a"), said(blank).alias("b"))
    return one.select(F.expr("stack(2, 'unit', a, 'blank', b) AS (col, present)"))


@query("crs_inference", """
WITH e AS (SELECT unit, min(x_m) AS a, max(x_m) AS b, min(z_m) AS c, max(z_m) AS d FROM (SELECT 'local' AS unit, x_m, z_m FROM v_obs UNION ALL SELECT 'degrees', x_m / CAST(100 AS DOUBLE) - 30, z_m / CAST(100 AS DOUBLE) - 30 FROM v_obs UNION ALL SELECT 'utm', x_m + 300000, z_m + 6000000 FROM v_obs UNION ALL SELECT 'far', x_m * 1000, z_m * 1000 FROM v_obs) GROUP BY unit)
SELECT unit AS survey, CASE unit WHEN 'local' THEN 'local_meters' WHEN 'degrees' THEN 'latlon' WHEN 'utm' THEN 'utm' ELSE CASE WHEN greatest(b - a, d - c) <= 1000000 AND greatest(abs(a), abs(b), abs(c), abs(d)) <= 2000000 THEN 'local_meters' ELSE 'unknown' END END AS detected,
  CASE unit WHEN 'local' THEN 'high' WHEN 'degrees' THEN 'high' WHEN 'utm' THEN 'high' ELSE 'low' END AS confidence FROM e""")
def crs_inference(spark, sf_dir):
    o = A.observations(spark, sf_dir)
    made = F.inline(F.array(*[F.struct(F.lit(n).alias("survey"), x.alias("x"), z.alias("z")) for n, x, z in (("local", F.col("x_m"), F.col("z_m")), ("degrees", F.col("x_m") / 100.0 - 30, F.col("z_m") / 100.0 - 30), ("utm", F.col("x_m") + 300000, F.col("z_m") + 6000000), ("far", F.col("x_m") * 1000, F.col("z_m") * 1000))]))
    e = o.select(made).groupBy("survey").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("z").alias("c"), F.max("z").alias("d"))
    kind, sure = P.coordinate_system(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return e.select("survey", kind.alias("detected"), sure.alias("confidence"))


@query("origin_shift", "SELECT obs_id, x_m - min(x_m) OVER () AS x, z_m - min(z_m) OVER () AS z, max(abs(x_m)) OVER () > 10000 OR max(abs(z_m)) OVER () > 10000 AS projected FROM v_obs")
def origin_shift(spark, sf_dir):
    """The corner is one aggregate, broadcast; a window over all rows would take one task."""
    o = A.observations(spark, sf_dir)
    corner = o.agg(F.min("x_m").alias("x0"), F.min("z_m").alias("z0"), ((F.max(F.abs("x_m")) > 10000) | (F.max(F.abs("z_m")) > 10000)).alias("projected"))
    return o.join(F.broadcast(corner)).select("obs_id", (F.col("x_m") - F.col("x0")).alias("x"), (F.col("z_m") - F.col("z0")).alias("z"), "projected")


@query("quality_label", """
WITH s AS (SELECT unit, count(*) AS n, (max(x_m) - min(x_m)) * (max(z_m) - min(z_m)) / CAST(1000000 AS DOUBLE) AS area FROM v_obs GROUP BY unit)
SELECT unit, n, CASE WHEN n < 10 THEN 'INSUFICIENTE' WHEN n < 30 OR area = 0 OR n / area < 1 THEN 'BAJA' WHEN unit = 'uGal' THEN 'MEDIA' ELSE 'ALTA' END AS label FROM s""")
def quality_label(spark, sf_dir):
    s = A.observations(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n"), (F.max("x_m") - F.min("x_m")).alias("dx"), (F.max("z_m") - F.min("z_m")).alias("dz"))
    size = P.sampling(F.col("n"), F.col("dx"), F.col("dz"))
    return s.select("unit", "n", P.quality_label(F.col("n"), size["point_density_per_km2"], size["area_km2"] == 0, F.col("unit") == "uGal").alias("label"))


@query("scale_preflight", """
WITH s AS (SELECT obs_id, x_m * (obs_id % 9) AS ex, z_m * (obs_id % 9) AS ez, obs_id % 90 AS nx FROM v_obs)
SELECT obs_id, CASE WHEN nx > 80 THEN 'TOO_LARGE_SINGLE_INVERSION' WHEN greatest(ex, ez) <= 10000 THEN 'LOCAL_SURVEY' WHEN greatest(ex, ez) <= 30000 THEN 'DISTRICT_SCALE' ELSE 'REGIONAL_SCALE' END AS scale_class FROM s""")
def scale_preflight(spark, sf_dir):
    k = F.col("obs_id")
    return A.observations(spark, sf_dir).select("obs_id", P.scale_class(F.col("x_m") * (k % 9), F.col("z_m") * (k % 9), k % 90, F.lit(4), F.lit(4)).alias("scale_class"))


@query("auto_grid", """
WITH e AS (SELECT max(x_m) - min(x_m) AS ex, max(z_m) - min(z_m) AS ez, count(*) AS n FROM v_obs),
g AS (SELECT ex, ez, sqrt(ex * ez / n) AS spacing, least(greatest(sqrt(ex * ez / n) / 2, CAST(25 AS DOUBLE)), CAST(10000 AS DOUBLE)) AS s, least(greatest(greatest(ex, ez) / 3, CAST(1000 AS DOUBLE)), greatest(CAST(100000 AS DOUBLE), greatest(ex, ez))) AS depth FROM e),
r AS (SELECT *, 0 AS i FROM g UNION ALL SELECT ex, ez, spacing, s * CAST(1.1 AS DOUBLE), depth, i + 1 FROM r WHERE i < 100 AND greatest(4, ceil(ex / s)) * greatest(4, ceil(depth / s)) * greatest(4, ceil(ez / s)) > 200000)
SELECT round(s, 6) AS block_size_m, CAST(greatest(4, ceil(ex / s)) AS BIGINT) AS nx, CAST(greatest(4, ceil(depth / s)) AS BIGINT) AS ny, CAST(greatest(4, ceil(ez / s)) AS BIGINT) AS nz, round(depth, 6) AS depth_m, round(greatest(3 * s, 2 * spacing), 6) AS cutoff_radius_m, i AS rounds FROM r WHERE i = (SELECT max(i) FROM r)""")
def auto_grid(spark, sf_dir):
    e = A.observations(spark, sf_dir).agg((F.max("x_m") - F.min("x_m")).alias("x"), (F.max("z_m") - F.min("z_m")).alias("z"), F.count("*").alias("n")).first()
    g = P.auto_grid(e["x"], e["z"], e["n"])
    return spark.createDataFrame([(round(g["block_size_m"], 6), g["nx"], g["ny"], g["nz"], round(g["depth_m"], 6), round(g["cutoff_radius_m"], 6), g["rounds"])], "block_size_m double, nx long, ny long, nz long, depth_m double, cutoff_radius_m double, rounds int")


def _utm_sql() -> str:
    """The forward series in SQL; what the inverse misses is 0 at nine decimals."""
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    term = lambda f, g: " + ".join(f"{d(a)} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    scale = d(geo._K0 * geo._RADIUS)
    return f"""WITH o AS (SELECT obs_id, x_m / CAST(5003 AS DOUBLE) * 6 - 75 AS lon, z_m / CAST(4999 AS DOUBLE) * 120 - 60 AS lat FROM v_obs), z AS (SELECT *, CAST(floor((lon + 180) / 6) AS BIGINT) + 1 AS zone FROM o),
a AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {d(geo._ECC)} * atanh({d(geo._ECC)} * sin(radians(lat)))) AS t FROM z), b AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
SELECT obs_id, zone, round(500000 + {scale} * (eta + {term("cos", "sinh")}), 3) AS easting, round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {scale} * (xi + {term("sin", "cosh")}), 3) AS northing, CAST(0 AS DOUBLE) AS error_deg FROM b"""


@query("utm_roundtrip", _utm_sql())
def utm_roundtrip(spark, sf_dir):
    """Forward and inverse transverse Mercator; the error in degrees at nine decimals."""
    lon, lat = F.col("x_m") / 5003.0 * 6 - 75, F.col("z_m") / 4999.0 * 120 - 60
    o = A.observations(spark, sf_dir).select("obs_id", lon.alias("lon"), lat.alias("lat"))
    o = o.withColumn("zone", geo.utm_zone(F.col("lon")))
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    o = o.withColumns({"easting": e, "northing": n})
    lon2, lat2 = geo.from_utm(F.col("easting"), F.col("northing"), F.col("zone"), F.col("lat") < 0)
    return o.select("obs_id", "zone", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"), F.round(F.greatest(F.abs(lon2 - F.col("lon")), F.abs(lat2 - F.col("lat"))), 9).alias("error_deg"))


@query("utm_zone_epsg", """
SELECT obs_id, CAST(floor((x_m / CAST(13.9 AS DOUBLE) - 180 + 180) / 6) AS BIGINT) + 1 AS zone, CASE WHEN obs_id % 2 = 0 THEN 32700 ELSE 32600 END + CAST(floor((x_m / CAST(13.9 AS DOUBLE) - 180 + 180) / 6) AS BIGINT) + 1 AS epsg FROM v_obs""")
def utm_zone_epsg(spark, sf_dir):
    lon = F.col("x_m") / 13.9 - 180
    zone = geo.utm_zone(lon)
    return A.observations(spark, sf_dir).select("obs_id", zone.alias("zone"), geo.utm_epsg(zone, F.col("obs_id") % 2 == 0).alias("epsg"))


@query("haversine_km", """
SELECT obs_id, round(2 * 6371 * asin(sqrt(pow(sin(radians(z_m / CAST(100 AS DOUBLE)) / 2), 2) + cos(radians(z_m / CAST(100 AS DOUBLE))) * pow(sin(radians(x_m / CAST(100 AS DOUBLE)) / 2), 2))), 6) AS km FROM v_obs""")
def haversine_km(spark, sf_dir):
    return A.observations(spark, sf_dir).select("obs_id", F.round(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.col("x_m") / 100.0, F.col("z_m") / 100.0), 6).alias("km"))


@query("footprint_bbox", """
WITH e AS (SELECT min(x_m) AS a, max(x_m) AS b, min(z_m) AS c, max(z_m) AS d FROM v_obs)
SELECT round(-70 + a / (111320 * cos(radians(CAST(-33 AS DOUBLE)))), 9) AS lon_min, round(-70 + b / (111320 * cos(radians(CAST(-33 AS DOUBLE)))), 9) AS lon_max, round(-33 + c / CAST(111320 AS DOUBLE), 9) AS lat_min, round(-33 + d / CAST(111320 AS DOUBLE), 9) AS lat_max FROM e""")
def footprint_bbox(spark, sf_dir):
    o = A.observations(spark, sf_dir).agg(*[f(c).alias(f"{c[0]}{n}") for c in ("x_m", "z_m") for f, n in ((F.min, "0"), (F.max, "1"))])
    lon, lat = geo.local_to_degrees(-70.0, -33.0)
    return o.select(F.round(lon(F.col("x0")), 9).alias("lon_min"), F.round(lon(F.col("x1")), 9).alias("lon_max"), F.round(lat(F.col("z0")), 9).alias("lat_min"), F.round(lat(F.col("z1")), 9).alias("lat_max"))


@query("radial_crop", """
WITH c AS (SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS r FROM v_obs WHERE sqrt(pow(x_m - 2500, 2) + pow(z_m - 2500, 2)) <= 1500) SELECT obs_id, x_m, z_m FROM c WHERE r % 5 = 0""")
def radial_crop(spark, sf_dir):
    inside = A.observations(spark, sf_dir).where(F.hypot(F.col("x_m") - 2500, F.col("z_m") - 2500) <= 1500)
    return P.every_nth(inside, "obs_id", 5).select("obs_id", "x_m", "z_m")


@query("regional_trend", """
WITH t AS (SELECT regr_slope(g, x_m) AS bx, regr_intercept(g, x_m) AS a FROM v_obs) SELECT obs_id, round(g - (a + bx * x_m), 4) AS residual FROM v_obs, t""")
def regional_trend(spark, sf_dir):
    o = A.observations(spark, sf_dir)
    fit = o.agg(F.regr_slope("g", "x_m").alias("b"), F.regr_intercept("g", "x_m").alias("a"))
    return o.join(F.broadcast(fit)).select("obs_id", F.round(F.col("g") - (F.col("a") + F.col("b") * F.col("x_m")), 4).alias("residual"))


@query("regional_trend_cubic")
def regional_trend_cubic(spark, sf_dir):
    """obs_id, residual beside a cubic surface. Solved from sums, so there is no SQL; tests hold it against least squares on all rows."""
    return P.polynomial_trend(A.observations(spark, sf_dir), "x_m", "z_m", "g", 3).select("obs_id", F.round("residual", 4).alias("residual"))


_TERMS = [(i, j) for i in range(4) for j in range(4 - i)]


@query("trend_normal_equations", f"SELECT t.i, t.j, count(*) AS n, true AS orthogonal FROM v_obs, (VALUES {', '.join(map(str, _TERMS))}) t(i, j) GROUP BY t.i, t.j")
def trend_normal_equations(spark, sf_dir):
    """i, j, n, orthogonal: whether the cubic's residual has no share of x^i z^j left (to 1e-8 of the values' own)."""
    o = A.observations(spark, sf_dir)
    r = P.polynomial_trend(o, "x_m", "z_m", "g", 3)
    power = lambda i, j: F.pow(F.col("x_m") / 5003.0, F.lit(float(i))) * F.pow(F.col("z_m") / 4999.0, F.lit(float(j)))
    sums = r.agg(F.count("*").alias("n"), *[F.array(F.sum(power(i, j) * F.col("residual")), F.sum(power(i, j) * F.abs("g"))).alias(f"t{i}_{j}") for i, j in _TERMS])
    terms = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"t{i}_{j}").alias("s")) for i, j in _TERMS])
    return sums.select("n", F.explode(terms).alias("t")).select("t.i", "t.j", "n", (F.abs(F.col("t.s")[0]) <= 1e-8 * F.col("t.s")[1]).alias("orthogonal"))


@query("status_latest", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_updates, max(ts) AS at FROM events GROUP BY user_id""")
def status_latest(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_updates"), F.max("ts").alias("at"))


@query("request_rate", "SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, event_type, count(*) AS n, count(*) > 10 AS limited FROM events GROUP BY ALL")
def request_rate(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("minute", "ts").alias("minute"), "event_type").agg(F.count("*").alias("n")).withColumn("limited", F.col("n") > 10)


@query("trace_ids", r"SELECT event_id, regexp_matches('t-' || event_id || CASE WHEN event_id % 5 = 0 THEN ' x' ELSE '' END, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$') AS valid FROM events")
def trace_ids(spark, sf_dir):
    trace = F.concat(F.lit("t-"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, " x").otherwise(""))
    return A.table(spark, sf_dir, "events").select("event_id", trace.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$").alias("valid"))


@query("config_hash", "SELECT o_orderkey, upper(substr(sha256('{\"p\":\"' || o_orderpriority || '\",\"s\":\"' || o_orderstatus || '\"}'), 1, 16)) AS config_hash FROM orders")
def config_hash(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", F.upper(F.substring(F.sha2(F.to_json(F.struct(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))), 256), 1, 16)).alias("config_hash"))


@query("season_window", """
SELECT event_id, CASE WHEN month(ts) IN (12, 1, 2) THEN 'summer' WHEN month(ts) IN (3, 4, 5) THEN 'autumn' WHEN month(ts) IN (6, 7, 8) THEN 'winter' ELSE 'spring' END AS south, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS north FROM events""")
def season_window(spark, sf_dir):
    quarter = F.floor(F.month("ts") % 12 / 3).cast("int") + 1
    name = lambda *seasons: F.element_at(F.array(*map(F.lit, seasons)), quarter)
    return A.table(spark, sf_dir, "events").select("event_id", name("summer", "autumn", "winter", "spring").alias("south"), name("winter", "spring", "summer", "autumn").alias("north"))


@query("first_seen_unit", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS reference, count(DISTINCT o_orderpriority) > 1 AS mixed FROM orders GROUP BY o_custkey")
def first_seen_unit(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("reference"), (F.count_distinct("o_orderpriority") > 1).alias("mixed"))


@query("residual_samples", """
WITH n AS (SELECT count(*) AS n FROM v_obs), i AS (SELECT DISTINCT CAST(floor(CAST(range AS DOUBLE) * (n - 1) / 49) AS BIGINT) AS pos FROM range(0, 50), n),
r AS (SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS pos FROM v_obs) SELECT pos, obs_id, g FROM r JOIN i USING (pos)""")
def residual_samples(spark, sf_dir):
    o = P.numbered(A.observations(spark, sf_dir), "obs_id", "pos")
    n = A.observations(spark, sf_dir).count()
    at = spark.range(50).select(F.floor(F.col("id").cast("double") * (n - 1) / 49).alias("pos")).distinct()
    return o.join(F.broadcast(at), "pos").select("pos", "obs_id", "g")


