"""Queries on block models: visual columns, percentile profiles, thresholds, ranked and stratified views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.profile import finite

# Names and levels of the percentile profile.
PROFILE = (("p2", 0.02), ("p5", 0.05), ("p50", 0.5), ("p85", 0.85), ("p90", 0.9), ("p95", 0.95), ("p98", 0.98))
GRADE_BASE, GRADE_DENSITY, GRADE_PROBABILITY, GRADE_NIR, GRADE_FE = 0.08, 1.85, 1.15, 0.45, 0.35


def min_max(c: str, lo: Column, hi: Column, floor: float = 1e-9) -> Column:
    return (F.col(c) - lo) / F.greatest(hi - lo, F.lit(floor))


def with_visual_columns(df: DataFrame) -> DataFrame:
    """Columns that views expect, where a table lacks them: density, rho, probability, visual_score, grade, domain, tonnage, degraded."""
    degraded = False
    if "density" not in df.columns:
        found = next((c for c in ("rho", "density_t_m3") if c in df.columns), None)
        degraded = found is None
        df = df.withColumn("density", F.col(found) if found else F.lit(None).cast("double"))
    if "rho" not in df.columns:
        df = df.withColumn("rho", F.col("density"))
    if "probability" not in df.columns:
        df = df.withColumn("probability", F.lit(None).cast("double"))
    if "visual_score" not in df.columns:
        ends = df.agg(F.min("density").alias("_lo"), F.max("density").alias("_hi"))
        chance = F.least(F.greatest(F.coalesce("probability", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        df = df.join(F.broadcast(ends)).withColumn("visual_score", min_max("density", F.col("_lo"), F.col("_hi")) * chance).drop("_lo", "_hi")
    for name, value in (("degraded", F.lit(degraded)), ("grade", F.lit(0.0)), ("domain", F.lit(0)), ("tonnage", F.lit(0.0))):
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def percentile_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, min, max and the profile's percentiles of finite values, and whether they are degenerate."""
    levels = F.array(*[F.lit(q) for _, q in PROFILE])
    aggs = []
    for c in columns:
        v = F.when(finite(F.col(c)), F.col(c))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, levels).alias("p")).alias(c))
    rows = df.agg(*aggs).select(F.inline(F.array(*columns)))
    return rows.select("column", "n", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), *[F.round(F.col("p")[i], 6).alias(n) for i, (n, _) in enumerate(PROFILE)], F.coalesce(F.col("max") - F.col("min") <= 1e-9, F.lit(True)).alias("is_degenerate"))


def cell_size(df: DataFrame, axes: list[str], fallback: float = 10.0) -> DataFrame:
    """The least positive gap of distinct coordinates on the first axis that has one."""
    gaps = []
    for k, a in enumerate(axes):
        w = Window.orderBy(a)
        d = df.select(a).where(F.col(a).isNotNull()).distinct()  # an axis has as many rows as the grid has planes
        gaps.append(d.select((F.col(a) - F.lag(a).over(w)).alias("gap")).where("gap > 0").agg(F.min("gap").alias("gap")).withColumn("axis", F.lit(k)))
    out = gaps[0]
    for g in gaps[1:]:
        out = out.unionByName(g)
    return out.where("gap IS NOT NULL").agg(F.coalesce(F.min_by("gap", "axis"), F.lit(fallback)).alias("cell_size"))


def nulls_first(c: str) -> Column:
    return F.desc_nulls_first(c)


def top(df: DataFrame, by: str, k: int, key: str) -> DataFrame:
    return df.orderBy(nulls_first(by), key).limit(k)


def exploration_view(df: DataFrame, limit: int, key: str = "voxel_id") -> DataFrame:
    """At most `limit` rows: 45 % by visual score, 30 % by density, 15 % by probability, the rest evenly spaced in the
    order of density; then filled up by visual score. A row stands where it is named first; column pick is its place.

    All branches are bounded top-k reads, but the evenly spaced one, which numbers the rows by ranges.
    """
    from lodestone.operators.profile import numbered

    n = df.count()
    if limit <= 0:
        return df.limit(0).withColumn("pick", F.lit(0).cast("long"))
    quota = [max(1, int(limit * share)) for share in (0.45, 0.30, 0.15)]
    rest = max(0, limit - sum(quota))
    branches = [(0, "visual_score", quota[0]), (1, "density", quota[1]), (2, "probability", quota[2])]
    order = F.struct(F.col("density").isNotNull().alias("a"), (-F.col("density")).alias("b"), F.col(key).alias("c"))
    parts = [top(df, by, k, key).withColumn("_rank", F.row_number().over(Window.orderBy(nulls_first(by), key))).withColumn("_branch", F.lit(b)) for b, by, k in branches]
    if rest:
        stride = max(n // rest, 1)
        even = numbered(df.withColumn("_order", order), "_order", "_at").where(F.col("_at") % stride == 0)
        parts.append(even.orderBy("_at").limit(rest).withColumn("_rank", (F.col("_at") + 1).cast("int")).drop("_at", "_order").withColumn("_branch", F.lit(3)))
    parts.append(top(df, "visual_score", min(2 * limit, n), key).withColumn("_rank", F.row_number().over(Window.orderBy(nulls_first("visual_score"), key))).withColumn("_branch", F.lit(4)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_branch", "_rank"))).where("_n = 1").drop("_n")  # 3 * limit rows at most
    first = first.orderBy("_branch", "_rank").limit(limit)
    return first.withColumn("pick", F.row_number().over(Window.orderBy("_branch", "_rank")).cast("long")).drop("_branch", "_rank")


def heuristic_grade(density: Column, probability: Column, nir: Column, fe: Column, region: Column, weak: Column) -> Column:
    g = (GRADE_BASE + GRADE_DENSITY * density + GRADE_PROBABILITY * probability + GRADE_NIR * nir + GRADE_FE * fe) * region
    return F.least(F.greatest(g * F.when(weak, 0.18).otherwise(1.0), F.lit(0.0)), F.lit(5.0))


def quantile(c: str, q: float, how: str) -> Column:
    """A quantile as an aggregate, for small groups: linear, nearest, floor (of q (n - 1)), or floor_n (of q n)."""
    if how == "linear":
        return F.percentile(c, q)
    values = F.array_sort(F.collect_list(c))
    n = F.size(values)
    at = {"nearest": F.rint((n - 1) * q), "floor": F.floor((n - 1) * q), "floor_n": F.least(F.floor(n * q), n - 1)}[how]
    return F.element_at(values, at.cast("int") + 1)


def adaptive_cutoff(df: DataFrame, cell: float) -> DataFrame:
    """One row: the density cut of anomalies, 2.75 for small cells, else mean + half a deviation inside the range."""
    if cell <= 500:
        return df.sparkSession.range(1).select(F.lit(2.75).alias("cutoff"))
    free = F.avg("density") + 0.5 * F.stddev_pop("density")
    return df.agg(F.least(F.greatest(free, F.min("density") + 0.01), F.max("density") - 0.01).alias("cutoff"))


def grid(spark, nx: int, ny: int, nz: int) -> DataFrame:
    """voxel_id, ix, iy, iz of a dense grid, x fastest."""
    i = F.col("id")
    return spark.range(nx * ny * nz).select(i.alias("voxel_id"), (i % nx).alias("ix"), (F.expr(f"id DIV {nx}") % ny).alias("iy"), F.expr(f"id DIV {nx * ny}").alias("iz"))


def padded_axes(axes: DataFrame, size: float, padding: int, growth: float = 1.3) -> DataFrame:
    """axis, i, width, edge (where the cell begins) and centre of the cells of axes (axis, n), with `padding` growing cells at either end."""
    i, n = F.col("i"), F.col("n")
    out = F.when(i < padding, padding - i).when(i >= padding + n, i - padding - n + 1).otherwise(0)
    cells = axes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n + 2 * padding - 1))).select("axis", i.alias("i"), (size * F.pow(F.lit(growth), out.cast("double"))).alias("width"))
    left = sum(size * growth**k for k in range(1, padding + 1))
    ends = cells.withColumn("edge", F.sum("width").over(Window.partitionBy("axis").orderBy("i")) - F.col("width") - F.lit(left))  # as many rows as an axis has cells
    return ends.withColumn("centre", F.col("edge") + F.col("width") / 2)


def header_stats(model: DataFrame, size: float) -> DataFrame:
    """One row that goes with an Arrow payload: total_voxels, bounds_min, bounds_max, cell_size, domain_l, domain_h, domain_w (four decimals), density_min, density_max (six), all but the first as text."""
    text = lambda c, n=4: F.format_string(f"%.{n}f", c)
    ends = model.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("x", "y", "z", "density") for k, f in (("lo", F.min), ("hi", F.max))])
    bounds = lambda k: F.concat_ws(",", *[text(F.col(f"{k}_{c}")) for c in "xyz"])
    spans = [text(F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias(f"domain_{d}") for c, d in zip("xyz", "lhw", strict=True)]
    return ends.select(F.col("n").alias("total_voxels"), bounds("lo").alias("bounds_min"), bounds("hi").alias("bounds_max"), text(F.lit(float(size))).alias("cell_size"), *spans, *[text(F.col(f"{k}_density"), 6).alias(f"density_{m}") for k, m in (("lo", "min"), ("hi", "max"))])


def rounded_stat(c: Column) -> Column:
    r = F.round(F.when(finite(c), c), 6)
    return F.when(r == 0, 0.0).otherwise(r)


