"""What a finished inversion is asked: mass in the padding, what saturated cells carry, favourability of many runs, best iterations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.diagnostics import WEIGHTS

# Shares above which padding leaks and saturated padding matters, and percent of change that does.
LEAK, MATTERS, CHANGES, SATURATED = 0.05, 0.01, 5.0, 10.0
# A level's multiplier and cap; LOW is told apart by uncertainty.
GATES = {"GOOD": (1.00, 100.0), "MEDIUM": (0.85, 100.0)}
GATE_LOW, GATE_BAD, UNCERTAIN = (0.60, 60.0), (0.35, 40.0), 0.50
# Scores below which a level ends.
LEVELS = [(25, "MUY BAJO"), (50, "BAJO"), (65, "MODERADO"), (80, "ALTO")]
# The composite of an iteration.
COMPOSITE = {"prauc": 0.30, "topk": 0.25, "iou": 0.20, "y_err": -0.15, "shallow": -0.10}
_TINY = 1e-30


def padding_leak(model: DataFrame) -> DataFrame:
    """One row of model (core, contrast): absolute mass in core, in padding, in all, the padding's share and PASS or REVIEW_REQUIRED. A null contrast has no mass."""
    mass = F.abs(F.coalesce("contrast", F.lit(0.0)))
    of = lambda c: F.coalesce(F.sum(F.when(c, mass)), F.lit(0.0))
    out = model.agg(of(F.col("core")).alias("mass_core"), of(~F.col("core")).alias("mass_padding"))
    total = F.col("mass_core") + F.col("mass_padding")
    ratio = F.col("mass_padding") / F.greatest(total, F.lit(_TINY))
    return out.select("mass_core", "mass_padding", total.alias("mass_total"), ratio.alias("ratio"), F.when(ratio < LEAK, "PASS").otherwise("REVIEW_REQUIRED").alias("status"))


def _without(df: DataFrame, zone: str = "zone", bound: str = "bound") -> DataFrame:
    """Each row of a class four times: as its own, as its zone's, as its bound's and as one of all."""
    return df.withColumn(zone, F.explode(F.array(F.col(zone), F.lit("all")))).withColumn(bound, F.explode(F.array(F.col(bound), F.lit("both"))))


def saturation_counterfactuals(model: DataFrame, kernel: DataFrame, data: DataFrame, low: float, high: float, eps: float = 1e-5, places: DataFrame | None = None) -> DataFrame:
    """zone, bound and what the model would lose without that class of saturated cells, as a cube of zone and bound.

    model: voxel_id, core, density, contrast; data: obs_id, d, sigma. A cell is saturated within eps of low or high.
    Columns: n, percent (of the zone's cells), mass, mass_fraction, forward_fraction (norm of the class's own response over
    that of all), delta_rms_percent, chi2, chi2_without, delta_chi2_percent, decision. The responses of the classes are
    summed in one pass of the kernel; a class that is gone is their difference. Classes without cells have no row.
    With places (obs_id, place) the kernel's rows are those of places, whose responses all their sensors share.
    """
    zone = F.when(F.col("core"), "core").otherwise("padding")
    bound = F.when(F.col("density") <= low + eps, "low").when(F.col("density") >= high - eps, "high").otherwise("inside")
    cells = model.where("density IS NOT NULL").select("voxel_id", "contrast", zone.alias("zone"), bound.alias("bound"))
    zones = cells.select(F.explode(F.array("zone", F.lit("all"))).alias("zone")).groupBy("zone").agg(F.count("*").alias("cells"))
    mass = cells.agg(F.sum(F.abs("contrast")).alias("mass_total"))
    counted = _without(cells.where("bound <> 'inside'")).groupBy("zone", "bound").agg(F.count("*").alias("n"), F.sum(F.abs("contrast")).alias("mass"))
    parts = kernel.hint("merge").join(cells, "voxel_id").groupBy("obs_id", "zone", "bound").agg(F.sum(F.col("val") * F.col("contrast")).alias("p"))
    if places is not None:
        parts = parts.withColumnRenamed("obs_id", "place").join(places, "place").drop("place")
    whole = parts.groupBy("obs_id").agg(F.sum("p").alias("all"))
    lost = _without(parts.where("bound <> 'inside'")).groupBy("zone", "bound", "obs_id").agg(F.sum("p").alias("p"))
    # sensors that a class doesn't reach keep their residual: their sum comes from all sensors, less that of those reached
    sensors = data.join(whole, "obs_id", "left").na.fill(0.0, ["all"])
    before = ((F.col("d") - F.col("all")) / F.col("sigma")) ** 2
    after = ((F.col("d") - F.col("all") + F.col("p")) / F.col("sigma")) ** 2
    base = sensors.agg(F.count("*").alias("sensors"), F.sum(F.col("all") ** 2).alias("square"), F.sum(before).alias("misfit"))
    moved = lost.join(sensors, "obs_id").groupBy("zone", "bound").agg(F.sum(F.col("p") ** 2).alias("part"), F.sum(after - before).alias("change"))
    out = counted.join(zones, "zone").join(moved, ["zone", "bound"], "left").na.fill(0.0, ["part", "change"]).join(F.broadcast(mass)).join(F.broadcast(base))  # mass and base are one row each
    share, forward = F.col("mass") / F.greatest("mass_total", F.lit(_TINY)), F.sqrt("part") / F.greatest(F.sqrt("square"), F.lit(_TINY))
    chi2, without = F.col("misfit") / F.col("sensors"), (F.col("misfit") + F.col("change")) / F.col("sensors")
    changed = 100 * F.abs(without - chi2) / F.greatest(chi2, F.lit(_TINY))
    fine = (share < MATTERS) & (forward < MATTERS) & (changed < CHANGES) & (100 * forward < CHANGES)
    return out.select(
        "zone", "bound", "n", (100.0 * F.col("n") / F.col("cells")).alias("percent"), "mass", share.alias("mass_fraction"), forward.alias("forward_fraction"), (100 * forward).alias("delta_rms_percent"),
        chi2.alias("chi2"), without.alias("chi2_without"), changed.alias("delta_chi2_percent"), F.when(fine, "IRRELEVANT").otherwise("SIGNIFICANT").alias("decision"),
    )


def run_scores(factors: list[DataFrame], runs: DataFrame) -> DataFrame:
    """run, evidence, weight, multiplier, cap, raw, score, level for each of runs (run, level, uncertainty).

    factors: tables (run, factor, value) of factor results; a null value isn't evaluated and has no weight. They meet by
    run: sums of what each factor has, one row a run, whatever runs a factor lacks. A run without any factor scores 0.
    """
    weight = reduce(lambda c, kv: c.when(F.col("factor") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0.0))
    value = F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0))
    every = reduce(DataFrame.unionByName, [f.select("run", "factor", "value") for f in factors]).where("value IS NOT NULL")
    # each factor for itself, then added in the order of WEIGHTS: no sum depends on the order of rows
    own = lambda c: [F.coalesce(F.sum(F.when(F.col("factor") == f, c)), F.lit(0.0)) for f in WEIGHTS]
    sums = every.groupBy("run").agg(reduce(lambda a, b: a + b, own(value * weight)).alias("_top"), reduce(lambda a, b: a + b, own(weight)).alias("weight"))
    level, doubt = F.upper(F.coalesce("level", F.lit("LOW"))), F.least(F.greatest(F.coalesce("uncertainty", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    low = F.coalesce("uncertainty", F.lit(0.0)) < UNCERTAIN
    gate = lambda k: F.when(level == "GOOD", GATES["GOOD"][k]).when(level == "MEDIUM", GATES["MEDIUM"][k]).when(low, GATE_LOW[k]).otherwise(GATE_BAD[k])
    out = runs.select("run", (gate(0) * (1 - doubt * 0.5)).alias("multiplier"), gate(1).alias("cap")).join(sums, "run", "left").na.fill(0.0, ["_top", "weight"])
    out = out.withColumn("evidence", F.when(F.col("weight") > 0, F.col("_top") / F.col("weight")).otherwise(0.0)).withColumn("raw", 100 * F.col("evidence") * F.col("multiplier"))
    out = out.withColumn("score", F.least(F.greatest("raw", F.lit(0.0)), "cap"))
    named = reduce(lambda c, x: c.when(F.col("score") < x[0], x[1]), LEVELS, F.when(F.lit(False), "")).otherwise("MUY ALTO")
    return out.select("run", "evidence", "weight", "multiplier", "cap", "raw", "score", named.alias("level"))


def best_iterations(history: DataFrame, baseline: Column | float) -> DataFrame:
    """run, best_prauc, best_topk, best (by the composite), rebound, reasons of history (run, it, prauc, topk, iou, y_err, shallow, n_active).

    The composite adds, each scaled to 0..1 within its run (0.5 if it doesn't vary), 0.30 PR-AUC, 0.25 top-k and 0.20 IoU
    and takes off 0.15 of the depth error's size and 0.10 of the shallow mass; ties (to nine digits) go to the first iteration. A run has
    rebounded if its last iteration has over twice the fewest active cells (active), over 25 points more shallow mass than
    the baseline (shallow), or if PR-AUC ever falls below half of the best before (prauc).
    """
    run = Window.partitionBy("run")
    before = run.orderBy("it").rowsBetween(Window.unboundedPreceding, -1)
    h = history.withColumn("y_err", F.abs("y_err")).withColumn("_best", F.max("prauc").over(before))
    h = h.withColumn("_fell", (F.col("_best") > 1e-6) & (F.col("prauc") < 0.5 * F.col("_best")))
    unit = lambda c: F.when(F.max(c).over(run) - F.min(c).over(run) > 1e-12, (F.col(c) - F.min(c).over(run)) / (F.max(c).over(run) - F.min(c).over(run))).otherwise(0.5)
    h = h.withColumn("_score", F.round(sum((w * unit(c) for c, w in COMPOSITE.items()), F.lit(0.0)), 9))
    first = lambda c: F.max_by("it", F.struct(c, -F.col("it")))
    last = lambda c: F.max_by(c, "it")
    out = h.groupBy("run").agg(
        first("prauc").alias("best_prauc"), first("topk").alias("best_topk"), first("_score").alias("best"),
        F.array(F.when(last("n_active") > 2.0 * F.greatest(F.min("n_active"), F.lit(1)), "active"), F.when(last("shallow") > baseline + 25.0, "shallow"), F.when(F.bool_or(F.coalesce("_fell", F.lit(False))), "prauc")).alias("_why"),
    )
    why = F.array_compact("_why")
    return out.select("run", "best_prauc", "best_topk", "best", (F.size(why) > 0).alias("rebound"), F.when(F.size(why) > 0, F.array_join(why, "|")).otherwise("none").alias("reasons"))


def depth_recovery(model: DataFrame, shallow: float, active: float, by: str = "run") -> DataFrame:
    """by, y_err (centroid depth of the model less that of the truth, weighted by mass), shallow_percent (mass at or above the depth `shallow`), n_active, max_m of model (by, y, truth, m)."""
    centroid = lambda c: F.sum(F.col("y") * F.col(c)) / F.nullif(F.sum(c), F.lit(0.0))
    part = 100 * F.coalesce(F.sum(F.when(F.col("y") <= shallow, F.col("m"))), F.lit(0.0)) / F.greatest(F.sum("m"), F.lit(1e-9))
    return model.groupBy(by).agg((centroid("m") - centroid("truth")).alias("y_err"), part.alias("shallow_percent"), F.count_if(F.col("m") >= active).alias("n_active"), F.max("m").alias("max_m"))


def nearest_cells(coarse: DataFrame, fine: DataFrame, key: str, fine_key: str, size: float, value: str) -> DataFrame:
    """key, fine_key, value of the fine cell nearest to each coarse one (both with x, y, z; ties to the smaller fine key), whatever the grids' offset."""
    from lodestone.operators.spatial import nearest

    left = coarse.select(key, *[F.col(c).alias(f"_c{c}") for c in "xyz"])
    right = fine.select(fine_key, *[F.col(c).alias(f"_f{c}") for c in "xyz"])
    return nearest(left, right, key, fine_key, [(f"_c{c}", f"_f{c}") for c in "xyz"], size).join(fine.select(fine_key, value), fine_key).select(key, fine_key, value)
