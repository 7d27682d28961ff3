"""Diagnostics of runs: survey QA, fit, residual levels, sensor flags, uncertainty, favourability, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the favourability factors, and depth steps.
WEIGHTS = {"anomaly_intensity": 0.25, "depth_accessibility": 0.15, "core_coherence": 0.20, "structural_gradient": 0.15, "msx_support": 0.15, "satellite_support": 0.10}
DEPTH_STEPS = ((50, 0.65), (500, 1.00), (1200, 0.85), (2500, 0.55), (4000, 0.25))
DEEPEST = 0.05


def level(warnings: Column) -> Column:
    return F.when(warnings == 0, "GOOD").when(warnings <= 2, "MEDIUM").otherwise("LOW")


def sigma(value: Column, spread: Column) -> Column:
    return F.greatest(0.02 * F.abs(value), 0.01 * spread)


def fit(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """rmse, mae, l2, bias, std and chi-squared of residuals (observed - predicted)."""
    spread = df.agg((F.max(observed) - F.min(observed)).alias("_spread"))
    r = df.join(F.broadcast(spread)).withColumn("_r", F.col(observed) - F.col(predicted)).withColumn("_s", sigma(F.col(observed), F.col("_spread")))
    return r.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("_r") ** 2)).alias("rmse"), F.avg(F.abs("_r")).alias("mae"), F.sqrt(F.sum(F.col("_r") ** 2)).alias("l2"), F.avg("_r").alias("bias"), F.stddev_pop("_r").alias("std"), F.avg((F.col("_r") / F.col("_s")) ** 2).alias("chi2"))


def qaqc(observations: DataFrame, domain_x: float, domain_z: float) -> DataFrame:
    """One row: n, coverage of the domain, dynamic_range, mean, std and rms of g, warnings (array, in the order of the rules), survey_level, survey_score."""
    span = lambda c: F.max(c) - F.min(c)
    q = observations.agg(F.count("*").alias("n"), (span("x_m") / domain_x).alias("coverage_x"), (span("z_m") / domain_z).alias("coverage_z"), span("g").alias("dynamic_range"), F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.sqrt(F.avg(F.col("g") ** 2)).alias("rms"))
    cx, cz = F.col("coverage_x"), F.col("coverage_z")
    rules = (("low_coverage_x", cx < 0.35), ("low_coverage_z", cz < 0.35), ("low_dynamic_range", F.col("dynamic_range") <= 1e-6), ("few_observations", F.col("n") < 20), ("concentrated", (cx < 0.2) & (cz < 0.2)))
    q = q.withColumn("warnings", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])))
    q = q.withColumn("survey_level", level(F.size("warnings")))
    return q.withColumn("survey_score", F.when(F.col("survey_level") == "GOOD", 1.0).when(F.col("survey_level") == "MEDIUM", 0.6).otherwise(0.3))


def fit_level(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """One row: normalized_rmse (by the largest observation) and fit_level."""
    r = F.col(observed) - F.col(predicted)
    n = df.agg((F.sqrt(F.avg(r**2)) / F.greatest(F.max(F.abs(observed)), F.lit(1e-12))).alias("normalized_rmse"))
    return n.withColumn("fit_level", F.when(F.col("normalized_rmse") < 0.05, "GOOD").when(F.col("normalized_rmse") < 0.2, "MEDIUM").otherwise("LOW"))


def residual_map(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """df with residual, normalized (by the largest residual) and residual_level, of every sensor."""
    r = df.withColumn("residual", F.col(observed) - F.col(predicted))
    most = r.agg(F.greatest(F.max(F.abs("residual")), F.lit(1e-12)).alias("_most"))
    r = r.join(F.broadcast(most)).withColumn("normalized", F.abs("residual") / F.col("_most")).drop("_most")
    return r.withColumn("residual_level", F.when(F.col("normalized") < 0.33, "LOW").when(F.col("normalized") < 0.66, "MEDIUM").otherwise("HIGH"))


def technical_summary(survey: DataFrame, fit: DataFrame, residuals: DataFrame) -> DataFrame:
    """survey and fit (one row each) with high_ratio, n_residuals, residual_level and overall_level."""
    high = F.coalesce(F.avg(F.when(F.col("residual_level") == "HIGH", 1.0).otherwise(0.0)), F.lit(0.0))
    r = residuals.agg(high.alias("high_ratio"), F.count("*").alias("n_residuals"))
    r = r.withColumn("residual_level", F.when(F.col("high_ratio") <= 0.1, "GOOD").when(F.col("high_ratio") <= 0.25, "MEDIUM").otherwise("LOW"))
    three = ("survey_level", "fit_level", "residual_level")
    good = F.lit(True)
    for c in three:
        good = good & (F.col(c) == "GOOD")
    low = (F.col("survey_level") == "LOW") | (F.col("fit_level") == "LOW") | ((F.col("residual_level") == "LOW") & (F.col("n_residuals") >= 10))
    return survey.join(fit).join(r).withColumn("overall_level", F.when(good, "GOOD").when(low, "LOW").otherwise("MEDIUM"))  # one row each


def uncertainty(summary: DataFrame) -> DataFrame:
    """technical_summary()'s row with uncertainty_score (a sum of penalties, 1 at most) and uncertainty_level."""
    by = lambda c, medium, low: F.when(F.col(c) == "MEDIUM", medium).when(F.col(c) == "LOW", low).otherwise(0.0)
    cx, cz = F.col("coverage_x") < 0.6, F.col("coverage_z") < 0.6
    penalties = [
        by("survey_level", 0.15, 0.30), F.when(cx & cz, 0.20).when(cx | cz, 0.10).otherwise(0.0), F.when(F.col("dynamic_range") <= 1e-6, 0.15).otherwise(0.0), F.when(F.col("std") <= 1e-9, 0.15).otherwise(0.0),
        by("fit_level", 0.20, 0.40), F.when(F.col("high_ratio") > 0.25, 0.30).when(F.col("high_ratio") > 0.10, 0.15).otherwise(0.0), by("overall_level", 0.10, 0.25),
    ]
    total = penalties[0]
    for p in penalties[1:]:
        total = total + p
    score = F.least(F.round(total, 3), F.lit(1.0))
    return summary.withColumn("uncertainty_score", score).withColumn("uncertainty_level", F.when(score < 0.35, "LOW").when(score < 0.7, "MEDIUM").otherwise("HIGH"))


def sensor_flags(residuals: DataFrame) -> DataFrame:
    """residual_map()'s flagged rows with flags (array) and review_priority."""
    extreme = F.col("normalized") >= 0.85
    flags = F.array_compact(F.array(F.when(F.col("residual_level") == "HIGH", "HIGH_RESIDUAL"), F.when(extreme, "EXTREME_NORMALIZED_RESIDUAL")))
    return residuals.withColumn("flags", flags).where(F.size("flags") > 0).withColumn("review_priority", F.when(extreme, "HIGH").otherwise("MEDIUM"))


def depth_score(depth: Column) -> Column:
    out = None
    for d, s in DEPTH_STEPS:
        out = F.when(depth <= d, s) if out is None else out.when(depth <= d, s)
    return out.otherwise(DEEPEST)


def robust_intensity(df: DataFrame, value: str) -> DataFrame:
    """robust_z and its score: how far the 95th percentile stands above the median, in deviations of the median kind."""
    median = df.agg(F.percentile(value, 0.5).alias("_m"), F.percentile(value, 0.95).alias("_p95"))
    dev = df.join(F.broadcast(median)).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5).alias("_mad"), F.first("_m").alias("_m"), F.first("_p95").alias("_p95"))
    z = (F.col("_p95") - F.col("_m")) / (1.4826 * F.col("_mad") + 1e-9)
    return dev.select(z.alias("robust_z"), F.least(F.greatest(z / 3, F.lit(0.0)), F.lit(1.0)).alias("score"))


def aggregate_score(factors: DataFrame, multiplier: Column, cap: Column) -> DataFrame:
    """factors (value, weight; null values aren't evaluated): the weighted evidence, times the gates, capped."""
    e = factors.where("value IS NOT NULL").agg((F.sum(F.col("value") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("evidence"), F.sum("weight").alias("weight"))
    raw = 100 * F.coalesce("evidence", F.lit(0.0)) * multiplier
    return e.select("evidence", "weight", raw.alias("raw"), F.least(F.greatest(raw, F.lit(0.0)), F.coalesce(cap, F.lit(100.0))).alias("score"))


def report_signal(model: DataFrame, cutoff: float) -> DataFrame:
    """One row of model (density, probability, grade, mass): anomaly_score, max_probability, avg_grade (by mass), preliminary_signal, risk_level. Null probabilities and grades count as 0; cells without density are left out."""
    p, mass = F.coalesce("probability", F.lit(0.0)), F.greatest(F.coalesce("mass", F.lit(0.0)), F.lit(1e-9))
    excess = F.least(F.greatest((F.col("density") - 2.6) / 1.6, F.lit(0.0)), F.lit(1.0))
    a = model.where("density IS NOT NULL").agg(F.avg(p * excess).alias("anomaly_score"), F.max(p).alias("max_probability"), F.max("density").alias("_d"), (F.sum(F.coalesce("grade", F.lit(0.0)) * mass) / F.sum(mass)).alias("avg_grade"))
    # What makes a candidate, and the steps of risk.
    signal = F.when((F.col("_d") >= 2.75) & (F.col("max_probability") >= 0.45) & (F.col("avg_grade") >= 0.3), "DRILL_CANDIDATE").otherwise("OBSERVE")
    risk = F.when((F.col("max_probability") < 0.45) | (F.col("_d") < cutoff), "HIGH").when(F.col("max_probability") < 0.75, "MEDIUM").otherwise("LOW")
    return a.select("anomaly_score", "max_probability", "avg_grade", signal.alias("preliminary_signal"), risk.alias("risk_level"))
