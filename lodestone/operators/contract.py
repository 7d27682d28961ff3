"""What a run takes in and gives out: checks before it starts, rows for viewers, gates, boxes, merges of properties."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.profile import finite

# The modes of a block-model request, the first one taken for any other; limits of a run.
MODES = ("exploration", "full", "anomaly", "economic")
MOST_VOXELS, MOST_BLOCK_VOLUME, BASE_DENSITY = 200_000, 1_000_000.0, 2.6


def mode(asked: Column) -> tuple[Column, Column]:
    """(mode, whether the one that was asked for isn't known)."""
    clean = F.lower(F.trim(F.coalesce(F.nullif(asked, F.lit("")), F.lit(MODES[0]))))
    return F.when(clean.isin(*MODES), clean).otherwise(MODES[0]), ~clean.isin(*MODES)


def input_problems(observations: DataFrame, nx: int, ny: int, nz: int, size: float, depth: float, cutoff: float, lat: float | None = None, lon: float | None = None) -> DataFrame:
    """problem, n: what keeps a run from starting; no row if nothing does. Observations: x_m, y_m, z_m, g.

    Counts are aggregates; a place that many observations share is one group with a partial count.
    """
    good = F.lit(True)
    for c in ("x_m", "y_m", "z_m", "g"):
        good = good & finite(F.col(c))
    places = observations.groupBy("x_m", "y_m", "z_m").agg(F.count("*").alias("k"), F.count(F.when(~good, 1)).alias("bad"))
    seen = places.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("twice"))
    said = [
        ("values not finite", F.col("bad")), ("coordinates repeated", F.col("twice")), ("too many voxels", F.lit(nx * ny * nz if nx * ny * nz > MOST_VOXELS else 0)), ("depth below the grid", F.lit(int(depth > ny * size))),
        ("cut-off less than a block", F.lit(int(cutoff < size))), ("impossible latitude or longitude", F.lit(int(lat is not None and lon is not None and not (-90 <= lat <= 90 and -180 <= lon <= 180)))),
    ]
    return seen.select(F.inline(F.array(*[F.struct(F.lit(name).alias("problem"), n.cast("long").alias("n")) for name, n in said]))).where("n > 0")


def voxel_output(cells: DataFrame, cutoff: float = 2.75) -> DataFrame:
    """voxel_id, is_active, density, probability and density_anomaly_score (0 to 1, relative to the cut-off); cells of air have nulls."""
    active = finite(F.col("density"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("density") - cutoff) / max(cutoff, 1e-9))
    return cells.select("voxel_id", active.alias("is_active"), F.when(active, F.col("density")).alias("density"), F.when(active & finite(F.col("probability")), F.col("probability")).alias("probability"), F.when(active, score).alias("density_anomaly_score"))


def targeting_frame(cells: DataFrame, size: float) -> DataFrame:
    """cells with density_contrast, bulk_rock_mass_kg (a block of MOST_BLOCK_VOLUME at most) and exploration_index."""
    volume = min(size**3, MOST_BLOCK_VOLUME)
    return cells.withColumns({"density_contrast": F.col("density") - BASE_DENSITY, "bulk_rock_mass_kg": F.col("density") * volume, "exploration_index": F.col("density") * F.col("probability")})


def grade_by_depth(depth: Column, density: Column) -> tuple[Column, Column]:
    """(domain, grade): oxides above 80 m, sulphides below."""
    oxide = depth < 80
    return F.when(oxide, 1).otherwise(2), F.greatest(F.lit(0.0), F.when(oxide, (density - 2.6) * 1.2).otherwise((density - 2.8) * 2.5 + 0.4))


def centred_json(cells: DataFrame, names: list[str], centre: tuple[float, float, float]) -> DataFrame:
    """voxel_id, cell: a JSON object for a viewer, coordinates from the centre, the vertical upward, NaN and infinity as absent."""
    clean = lambda c: F.when(finite(c), c)
    x, y, z = (F.col(c) for c in "xyz")
    at = [clean(x - centre[0]).alias("cx"), clean(centre[1] - y).alias("cy"), clean(z - centre[2]).alias("cz")]
    return cells.select("voxel_id", F.to_json(F.struct(*at, *[clean(F.col(c)).alias(c) for c in names])).alias("cell"))


def economic_gate(score: Column, level: Column, overall: Column, quality: Column) -> tuple[Column, Column]:
    """(state, reasons): whether a report may show economic figures. A null score and level mean that nothing was evaluated."""
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    rules = (("favorability", (F.coalesce(score, F.lit(0.0)) < 25) | (up(level) == "MUY BAJO")), ("technical quality", up(overall) == "LOW"), ("input quality", up(quality).isin("BAJA", "INSUFICIENTE")))
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    none = score.isNull() & level.isNull()
    return F.when(none, "NOT_EVALUATED").when(F.size(reasons) > 0, "GATE_FAIL").otherwise("GATE_PASS"), F.when(none, F.array(F.lit("not evaluated"))).otherwise(reasons)


def satellite_factor(cached: Column, spectral: Column, support: Column, value: Column) -> tuple[Column, Column]:
    """(value, status): the cached score passes through where every step was evaluated and it is not negative."""
    ok = F.coalesce(cached & (spectral == "evaluated") & (support == "evaluated") & finite(value) & (value >= 0), F.lit(False))
    return F.when(ok, value), F.when(ok, "evaluated").otherwise("not_evaluated")


def bbox(lat_a: Column, lat_b: Column, lon_a: Column, lon_b: Column, margin: float = 1.0) -> Column:
    """A box (min_lat, max_lat, min_lon, max_lon) grown by a factor; null where a side is empty, turned or not finite."""
    grow = (margin - 1) / 2
    fine = finite(lat_a) & finite(lat_b) & finite(lon_a) & finite(lon_b) & (lat_b > lat_a) & (lon_b > lon_a)
    dlat, dlon = (lat_b - lat_a) * grow, (lon_b - lon_a) * grow
    return F.when(fine, F.struct((lat_a - dlat).alias("min_lat"), (lat_b + dlat).alias("max_lat"), (lon_a - dlon).alias("min_lon"), (lon_b + dlon).alias("max_lon")))


def finite_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the least and greatest finite value of each column."""
    return df.agg(*[f(F.when(finite(F.col(c)), F.col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def first_text(value: str, order: str) -> Column:
    """The first value that isn't null, in that order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def in_first_order(value: Column, order: Column) -> Column:
    """Aggregate: the distinct values of a group in the order in which they first come."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s.v))


def zipped(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """key, pos and an element of each array; a key whose arrays differ in length gives one row with pos null."""
    same = F.lit(True)
    for c in arrays[1:]:
        same = same & (F.size(c) == F.size(arrays[0]))
    rows = df.withColumn("_zip", F.when(same, F.arrays_zip(*arrays)))
    return rows.select(key, F.posexplode_outer("_zip").alias("pos", "_z")).select(key, "pos", *[F.col("_z").getField(c).alias(c) for c in arrays])


def first_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def sphere_gravity(dx: Column, dz: Column, depth: float, radius: float, contrast: float, newton: float = 6.6743e-11) -> Column:
    """Vertical attraction of a buried sphere, the closed form that kernels are held against."""
    mass = 4 / 3 * math.pi * radius**3 * contrast
    r2 = dx * dx + dz * dz + depth * depth
    return newton * mass * depth / (r2 * F.sqrt(r2))
