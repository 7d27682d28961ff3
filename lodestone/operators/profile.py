"""Profiling of station tables: extent, sampling, statistics, duplicates, outliers, unit and CRS inference."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import stored


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def to_ms2(value: Column, unit: Column) -> Column:
    """Null for a unit that isn't known."""
    return F.when(unit == "mGal", value * 1e-5).when(unit == "uGal", value * 1e-8).when(unit == "m/s2", value)


def strict_number(text: Column) -> Column:
    """The number that text holds; null if none, NaN or infinite."""
    x = text.try_cast("double")
    return F.when(finite(x), x)


def unit_error(unit: Column, first: Column) -> Column:
    u = F.trim(F.coalesce(unit, F.lit("")))
    return F.when(u == "", "missing").when(~u.isin("mGal", "uGal", "m/s2"), "unsupported").when(u != first, "mixed")


def extent(df: DataFrame, x: str, y: str, z: str) -> list[Column]:
    out = []
    for n in (x, y, z):
        out += [F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"), (F.max(n) - F.min(n)).alias(f"{n}_span")]
    return out


def sampling(n: Column, span_x: Column, span_z: Column) -> dict[str, Column]:
    area = F.greatest(span_x, F.lit(0.0)) * F.greatest(span_z, F.lit(0.0))
    return {"area_km2": area / 1e6, "mean_spacing_m": F.when((n > 0) & (area > 0), F.sqrt(area / n)), "point_density_per_km2": F.when((n > 0) & (area > 0), n / (area / 1e6))}


def first_of_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, with n_copies. Partial aggregates: a hot key doesn't gather in one task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(first, F.count("*").alias("n_copies")).select(*keys, "_first.*", "n_copies")


def near_pairs(df: DataFrame, idc: str, coords: list[str], tolerance: float) -> DataFrame:
    """(i, j, distance), j < i, of points with 0 < distance <= tolerance: an equi-join on cells of that width.

    A pair of cells meets once: a point is copied into its own cell and those neighbours that come after it, 14 of 27 in space.
    """
    n = len(coords)
    own = F.array(*[F.floor(F.col(c) / tolerance) for c in coords])
    ahead = [o for o in itertools.product((-1, 0, 1), repeat=n) if o >= (0,) * n]
    point = F.struct(F.col(idc).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(coords)])
    left = df.select(own.alias("_cell"), point.alias("a"))
    right = df.select(own.alias("_own"), point.alias("b"), F.explode(F.array(*[F.struct(F.array(*map(F.lit, o)).alias("by"), F.lit(any(o)).alias("other")) for o in ahead])).alias("o"))
    right = right.select(F.zip_with("_own", "o.by", lambda x, y: x + y).alias("_cell"), "b", "o.other")
    met = left.join(right, "_cell").where(F.col("other") | (F.col("b.id") < F.col("a.id")))
    d = F.sqrt(sum((F.pow(F.col(f"a.c{k}") - F.col(f"b.c{k}"), 2) for k in range(1, n)), F.pow(F.col("a.c0") - F.col("b.c0"), 2)))
    met = met.withColumn("distance", d).where((F.col("distance") > 0) & (F.col("distance") <= tolerance))
    return met.select(F.greatest("a.id", "b.id").alias("i"), F.least("a.id", "b.id").alias("j"), "distance")


def zscores(df: DataFrame, value: str) -> DataFrame:
    """df with zscore over all finite values (population deviation); null where that is 0."""
    stats = df.where(finite(F.col(value))).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    return df.where(finite(F.col(value))).join(F.broadcast(stats)).withColumn("zscore", F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std")


def coordinate_system(x_min: Column, x_max: Column, z_min: Column, z_max: Column) -> tuple[Column, Column]:
    """(detected, confidence) from the ranges of both horizontal axes."""
    top = F.greatest(F.abs(x_min), F.abs(x_max), F.abs(z_min), F.abs(z_max))
    inside = lambda lo, hi, a, b: (lo >= a) & (hi <= b)
    degrees = (top <= 180) & ((inside(x_min, x_max, -180, 180) & inside(z_min, z_max, -90, 90)) | (inside(x_min, x_max, -90, 90) & inside(z_min, z_max, -180, 180)))
    vague = (x_min >= 0) & (z_min >= 0) & (top <= 90)
    utm = inside(x_min, x_max, 100_000, 900_000) & inside(z_min, z_max, 0, 10_000_000)
    local = inside(x_min, x_max, 0, 50_000) & inside(z_min, z_max, 0, 50_000)
    span = F.greatest(x_max - x_min, z_max - z_min)
    wide = ((span <= 200_000) & (top <= 1_000_000)) | ((span <= 1_000_000) & (top <= 2_000_000))
    kind = F.when(x_min.isNull(), "unknown").when(degrees, "latlon").when(utm, "utm").when(local | wide, "local_meters").otherwise("unknown")
    sure = F.when(x_min.isNull(), "low").when(degrees & vague, "medium").when(degrees | utm | local, "high").when(wide, "medium").otherwise("low")
    return kind, sure


def quality_label(n: Column, density_per_km2: Column, issue: Column, warned: Column) -> Column:
    return F.when(n < 10, "INSUFICIENTE").when((n < 30) | F.coalesce(density_per_km2 < 1, F.lit(True)) | issue, "BAJA").when(warned, "MEDIA").otherwise("ALTA")


def scale_class(x_extent: Column, z_extent: Column, nx: Column, ny: Column, nz: Column, limit: int = 80) -> Column:
    most = F.greatest(x_extent, z_extent)
    return F.when(F.greatest(nx, ny, nz) > limit, "TOO_LARGE_SINGLE_INVERSION").when(most.isNull(), "UNKNOWN_SCALE").when(most <= 10_000, "LOCAL_SURVEY").when(most <= 30_000, "DISTRICT_SCALE").otherwise("REGIONAL_SCALE")


def auto_grid(x_extent: float, z_extent: float, n: int, limit: int = 200_000, least: float = 25.0, most: float = 10_000.0) -> dict[str, float]:
    """Block size, cells, depth and cut-off radius for a survey's extent; closed form but for the growth of the block by tenths."""
    spacing = (x_extent * z_extent / n) ** 0.5 if x_extent > 0 and z_extent > 0 and n > 0 else 2 * least
    size = min(max(spacing / 2, least), most)
    wide = max(x_extent, z_extent)
    depth = min(max(wide / 3, 1000.0), max(100_000.0, wide))
    cells = lambda s: [max(4, math.ceil(e / s)) for e in (x_extent, depth, z_extent)]
    rounds = 0
    while (c := cells(size))[0] * c[1] * c[2] > limit and rounds < 100:
        size, rounds = size * 1.1, rounds + 1
    return {"block_size_m": size, "nx": c[0], "ny": c[1], "nz": c[2], "depth_m": depth, "cutoff_radius_m": max(3 * size, 2 * spacing), "rounds": rounds}


def polynomial_trend(df: DataFrame, x: str, z: str, value: str, order: int) -> DataFrame:
    """df with trend and residual: the least-squares polynomial of that order (1 to 4) in both coordinates, scaled to [0, 1].

    The normal equations are sums in one aggregate, at most 60 numbers; the system of at most 15 unknowns is solved on the driver.
    """
    if not 1 <= order <= 4:
        raise ValueError("order is 1 to 4")
    ends = df.agg(*[f(c).alias(f"{n}{c}") for c in (x, z) for n, f in (("lo_", F.min), ("hi_", F.max))]).first()
    scaled = lambda c: (F.col(c) - (ends[f"lo_{c}"] or 0.0)) / (((ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0)) or 1.0)
    u, v = scaled(x), scaled(z)
    terms = [(i, j) for i in range(order + 1) for j in range(order + 1 - i)]
    power = lambda i, j: F.pow(u, F.lit(float(i))) * F.pow(v, F.lit(float(j)))
    moments = {(i, j): F.sum(power(i, j)) for i in range(2 * order + 1) for j in range(2 * order + 1 - i)}
    s = df.where(finite(F.col(value))).agg(*[c.alias(f"m{i}_{j}") for (i, j), c in moments.items()], *[F.sum(power(i, j) * F.col(value)).alias(f"b{i}_{j}") for i, j in terms]).first()
    a = np.array([[s[f"m{i + k}_{j + m}"] or 0.0 for k, m in terms] for i, j in terms])
    weights = np.linalg.lstsq(a, np.array([s[f"b{i}_{j}"] or 0.0 for i, j in terms]), rcond=None)[0]
    trend = F.lit(0.0)
    for (i, j), w in zip(terms, weights.tolist(), strict=True):
        trend = trend + w * power(i, j)
    return df.withColumn("trend", trend).withColumn("residual", F.col(value) - F.col("trend"))


def first_value(c: str, order: str) -> Column:
    return F.min_by(c, order)


def rank_over(order: list[Column], partition: list[str] | None = None) -> Column:
    return F.row_number().over((Window.partitionBy(*partition) if partition else Window).orderBy(*order))


def numbered(df: DataFrame, order: str, name: str, parts: int = 64) -> DataFrame:
    """df with name: the row's place from 0 in the order of a column. Ranges are numbered each for itself,
    then shifted by the rows of those before, so no task sorts everything. The ranges are stored, so that both
    readings of them are of the same ones, also after an executor is lost."""
    ranged = stored(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ranged.groupBy("_part").count().withColumn("_base", before).drop("count")
    return within.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_rank") - 1).drop("_part", "_rank", "_base")


def running_sums(df: DataFrame, order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """df with the sum of each column up to its row, from the greatest `order` down, under the same name with `_sum`.

    As in numbered(), ranges are summed each for itself and shifted by the totals of those before.
    """
    ranged = stored(df.repartitionByRange(parts, F.desc(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows
    base = ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns]).select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns])
    out = ranged.withColumns({f"{c}_sum": F.sum(c).over(within) for c in columns}).join(F.broadcast(base), "_part")
    return out.select(*df.columns, *[(F.col(f"{c}_sum") + F.col(f"_before_{c}")).alias(f"{c}_sum") for c in columns])


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    return numbered(df, order, "_at").where(F.col("_at") % n == 0).drop("_at")
