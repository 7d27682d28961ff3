"""Station tables from delimited text: header aliases, coordinate layout, row checks, units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.profile import first_of_duplicates, numbered, strict_number, to_ms2

# Column names of the station file contract. Of gravity names the first of the list wins, of coordinates the first of the file.
GRAVITY = ("gravity_anomaly", "g_corrected", "complete_bouguer_anomaly", "bouguer_anomaly", "free_air_anomaly", "cba", "faa", "gravity_mgal", "g_mgal", "observed_gravity", "observed_g", "residual_gravity", "gravity", "g", "g_raw")
LON = ("lon", "longitude", "long", "lon_deg", "x_lon")
LAT = ("lat", "latitude", "lat_deg", "y_lat")
EASTING = ("easting", "east", "utm_e", "utm_x", "x_utm")
NORTHING = ("northing", "north", "utm_n", "utm_y", "y_utm")
LOCAL_X = ("x", "local_x", "coord_x")
LOCAL_Z = ("z", "local_z", "coord_z")
LOCAL_Y = ("y", "local_y", "coord_y")
DEPTH = ("depth", "depth_m", "depth_below_surface", "depth_below_surface_m", "profundidad", "profundidad_m")
GRAVITY_TYPES = (
    "absolute_gravity", "corrected_gravity", "free_air_anomaly", "free_air_mgal", "bouguer_anomaly", "bouguer_mgal", "complete_bouguer_anomaly", "residual_anomaly", "residual_gravity",
    "terrain_corrected_bouguer", "magnetic_only", "synthetic_demo",
)
UNITS = {"m/s²": "m/s2", "µGal": "uGal"}
LEAST_ROWS = 10


@dataclass(frozen=True)
class Layout:
    """Which columns of a file fill the slots; kind is legacy, latlon, utm, local or None."""

    kind: str | None
    x: str | None = None
    y: str | None = None
    z: str | None = None
    gravity: str | None = None


def resolve(headers: list[str]) -> Layout:
    """Slots from header names, without regard to case; x is east, z is north, y is depth."""
    by = {h.lower(): h for h in reversed(headers)}
    first = lambda names: next((h for h in headers if h.lower() in names), None)
    gravity = next((by[n] for n in GRAVITY if n in by), None)
    if "x_m" in by and "z_m" in by:
        return Layout("legacy", by["x_m"], by.get("y_m"), by["z_m"], gravity)
    for kind, x, z, y in (("latlon", LON, LAT, DEPTH), ("utm", EASTING, NORTHING, DEPTH), ("local", LOCAL_X, LOCAL_Z, LOCAL_Y + DEPTH)):
        if first(x) and first(z):
            return Layout(kind, first(x), first(y), first(z), gravity)
    return Layout(None, gravity=gravity)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Columns as strings, null as empty, with src_row in the order of the file.

    Fields end at a comma or semicolon; lines with more fields than the header are left out, short ones filled up.
    """
    lines = spark.read.text(path).withColumn("src_row", F.monotonically_increasing_id())
    top = lines.where(F.trim("value") != "").orderBy("src_row").limit(1).collect()
    if not top:
        return spark.createDataFrame([], "src_row long")
    clean = lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))
    names = [n.replace("﻿", "").strip().strip('"').strip() for n in top[0]["value"].replace(";", ",").split(",")]
    cells = F.split("value", "[,;]")
    rows = lines.where((F.col("src_row") > top[0]["src_row"]) & (F.trim("value") != "") & (F.size(cells) <= len(names)))
    wanted = [(i, n) for i, n in enumerate(names) if n and not n.startswith("Unnamed") and n not in names[:i]]
    return rows.select("src_row", *[F.coalesce(clean(F.get(cells, F.lit(i))), F.lit("")).alias(n) for i, n in wanted])


def _text(rows: DataFrame, name: str) -> Column:
    found = next((c for c in rows.columns if c.lower() == name), None)
    return F.trim(F.col(f"`{found}`")) if found else F.lit("")


def checked(rows: DataFrame, strict: bool = True, allow_raw: bool = False) -> DataFrame:
    """src_row, station_id, x_m, y_m, z_m, g, unit, g_ms2, gravity_type, coord_type and errors (array) of each row.

    rows: strings and src_row. A missing station_id is ST_ and the row's number, from 1 in the order of src_row; a missing depth is 0.
    """
    rows = numbered(rows, "src_row", "_at")
    layout = resolve([c for c in rows.columns if c not in ("src_row", "_at")])
    number = lambda c: strict_number(F.col(f"`{c}`")) if c else F.lit(None).cast("double")
    unit = F.replace(F.replace(_text(rows, "unit"), F.lit("²"), F.lit("2")), F.lit("µ"), F.lit("u"))
    kind, x, z, g = _text(rows, "gravity_type"), number(layout.x), number(layout.z), number(layout.gravity)
    raw_only = bool(layout.gravity and layout.gravity.lower() == "g_raw" and not allow_raw)
    problems = {
        "coordinates missing": x.isNull() | z.isNull(),
        "impossible latitude or longitude": (F.abs(z) > 90) | (F.abs(x) > 180) if layout.kind == "latlon" else F.lit(False),
        "gravity missing": g.isNull() | F.lit(raw_only),
        "unit missing": unit == "",
        "unit unsupported": (unit != "") & ~unit.isin("m/s2", "mGal", "uGal"),
        "gravity_type missing": (kind == "") & F.lit(strict),
        "gravity_type unsupported": (kind != "") & ~kind.isin(*GRAVITY_TYPES),
    }
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in problems.items()]))
    name = F.coalesce(F.nullif(_text(rows, "station_id"), F.lit("")), F.format_string("ST_%06d", F.col("_at") + 1))
    y = F.coalesce(number(layout.y), F.lit(0.0))
    return rows.select("src_row", name.alias("station_id"), x.alias("x_m"), y.alias("y_m"), z.alias("z_m"), g.alias("g"), unit.alias("unit"), to_ms2(g, unit).alias("g_ms2"), kind.alias("gravity_type"), F.lit(layout.kind).alias("coord_type"), errors.alias("errors"))


def extent(spark: SparkSession, path: str) -> DataFrame:
    """One row: n and the extent in x and z of a station file; only those two columns are read as numbers."""
    rows = read_delimited(spark, path)
    layout = resolve([c for c in rows.columns if c != "src_row"])
    at = lambda c: strict_number(F.col(f"`{c}`")) if c else F.lit(None).cast("double")
    both = rows.select(at(layout.x).alias("x"), at(layout.z).alias("z")).where("x IS NOT NULL AND z IS NOT NULL")
    return both.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("x", "z") for n, f in (("min", F.min), ("max", F.max))])


def import_stations(spark: SparkSession, path: str, strict: bool = True, allow_raw: bool = False) -> tuple[DataFrame, list[str]]:
    """(stations, reasons to reject the file). Of stations at one place, the first stays.

    Any row with an error rejects the file, as do mixed units, a signal that is zero throughout, and fewer than LEAST_ROWS stations.
    """
    rows = checked(read_delimited(spark, path), strict, allow_raw)
    stations = first_of_duplicates(rows.where(F.size("errors") == 0), ["x_m", "y_m", "z_m"], "src_row")
    reasons = [r["e"] for r in rows.select(F.explode("errors").alias("e")).distinct().orderBy("e").collect()]  # as many as there are kinds of error
    seen = stations.agg(F.count("*").alias("n"), F.count_distinct("unit").alias("units"), F.count_distinct("gravity_type").alias("types"), F.max(F.abs("g")).alias("most"), F.max((F.col("gravity_type") == "magnetic_only").cast("int")).alias("magnetic")).first()
    reasons += ["units mixed"] * (seen["units"] > 1) + ["gravity types mixed"] * (seen["types"] > 1) + ["too few stations"] * (seen["n"] < LEAST_ROWS) + ["no signal"] * (seen["most"] == 0 and not seen["magnetic"])
    return stations, reasons
