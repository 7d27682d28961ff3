"""Scores against labels: ROC and precision-recall areas, threshold sweeps, Otsu, overlaps, recovery, L-curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.profile import running_sums


def tie_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """A row for each distinct score: score, dp, dn, tp, fp (sums from the best score down) and the totals p, n.

    Scores are grouped first, and the running sums go by ranges of scores, so that no task holds all of them.
    """
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum(positive.cast("long")).alias("dp"), F.sum((~positive).cast("long")).alias("dn"))
    c = running_sums(g, "score", ["dp", "dn"]).withColumnsRenamed({"dp_sum": "tp", "dn_sum": "fp"})
    return c.join(F.broadcast(c.agg(F.sum("dp").alias("p"), F.sum("dn").alias("n"))))


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """auc: the trapezoid over groups of equal scores; null without both classes."""
    area = F.sum(F.col("dn") * (2 * F.col("tp") - F.col("dp")) / 2.0)
    return tie_curve(df, score, positive).agg((area / F.nullif(F.max("p") * F.max("n"), F.lit(0))).alias("auc"))


def pr_auc(df: DataFrame, score: str, positive: Column, anchored: bool = True) -> DataFrame:
    """auc of precision over recall by trapezoids; anchored: from (0, 1), else from the first point."""
    tp0, fp0 = F.col("tp") - F.col("dp"), F.col("fp") - F.col("dn")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(tp0 + fp0 > 0, tp0 / F.nullif(tp0 + fp0, F.lit(0)))
    width = F.col("dp") / F.col("p") if anchored else F.when(tp0 + fp0 > 0, F.col("dp") / F.col("p")).otherwise(0.0)
    return tie_curve(df, score, positive).agg(F.sum(width * (precision + F.coalesce(before, F.lit(1.0))) / 2).alias("auc"))


def threshold_sweep(df: DataFrame, score: str, positive: Column, steps: int = 200) -> DataFrame:
    """A row for each of `steps` thresholds from the least to the greatest score: f1 and iou of score >= threshold.

    Rows are counted once by the highest threshold that they reach; the counts are then cumulated.
    """
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    k = F.floor((F.col(score) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * (steps - 1) + 1e-9)
    hit = df.join(F.broadcast(ends)).groupBy(F.least(k, F.lit(steps - 1)).cast("int").alias("k")).agg(F.sum(positive.cast("long")).alias("dp"), F.sum((~positive).cast("long")).alias("dn"))
    all_k = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("k")).join(hit, "k", "left").fillna(0)
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `steps` rows
    c = all_k.withColumns({"tp": F.sum("dp").over(w), "fp": F.sum("dn").over(w)})
    total = c.agg(F.sum("dp").alias("p"))
    c = c.join(F.broadcast(total))
    return c.select("k", "tp", "fp", (2.0 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("p"), F.lit(0))).alias("f1"), (F.col("tp") / F.nullif(F.col("fp") + F.col("p"), F.lit(0))).alias("iou"))


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """threshold: between-class variance is greatest; positive values only, ties to the lowest."""
    v = df.where(F.col(value) > 0)
    ends = v.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))), F.lit(bins - 1))
    h = v.join(F.broadcast(ends)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    h = h.withColumn("centre", F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `bins` rows
    h = h.withColumns({"n0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("centre")).over(w)})
    h = h.join(F.broadcast(h.agg(F.sum("n").alias("nt"), F.sum(F.col("n") * F.col("centre")).alias("st"))))
    n1 = F.col("nt") - F.col("n0")
    between = F.when(n1 > 0, F.round(F.col("n0") * n1 * F.pow(F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1, 2), 6))
    return h.withColumn("v", between).where("v IS NOT NULL").agg(F.max_by("centre", F.struct("v", -F.col("b"))).alias("threshold"))


def mask_metrics(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    both = df.agg(F.sum((truth & guess).cast("long")).alias("tp"), F.sum((~truth & guess).cast("long")).alias("fp"), F.sum((truth & ~guess).cast("long")).alias("fn"))
    part = lambda a, b: F.col(a).cast("double") / F.nullif(b, F.lit(0))
    return both.select("tp", "fp", "fn", part("tp", F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"), part("tp", F.col("tp") + F.col("fp")).alias("precision"), part("tp", F.col("tp") + F.col("fn")).alias("recall"), (2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


def lcurve_corner(curve: DataFrame, order: str, misfit: str, norm: str) -> DataFrame:
    """The row of curve with the greatest Menger curvature of its consecutive triples, log-log and scaled to the unit square.

    A curve has a few dozen points. Segments shorter than 1e-3 give no curvature. Where no triple has any (a straight
    line, fewer than three points, points that coincide), the point farthest from the line between the ends is taken, the
    first of equals, with a null curvature; if the ends coincide, the middle one.
    """
    c = curve.withColumns({"_a": F.log10(F.col(misfit) + 1e-30), "_b": F.log10(F.col(norm) + 1e-30)})
    ends = c.agg(F.min("_a").alias("u0"), F.max("_a").alias("u1"), F.min("_b").alias("v0"), F.max("_b").alias("v1"), *[f(x, order).alias(f"_{n}{x}") for n, f in (("first", F.min_by), ("last", F.max_by)) for x in ("_a", "_b")], F.count("*").alias("_n"))
    c = c.join(F.broadcast(ends)).withColumns({"u": (F.col("_a") - F.col("u0")) / F.greatest(F.col("u1") - F.col("u0"), F.lit(1e-12)), "v": (F.col("_b") - F.col("v0")) / F.greatest(F.col("v1") - F.col("v0"), F.lit(1e-12))})
    w = Window.orderBy(order)
    for n, f in (("a", F.lag), ("b", F.lead)):
        c = c.withColumns({f"u{n}": f("u").over(w), f"v{n}": f("v").over(w)})
    side = lambda p, q: F.hypot(F.col(f"u{p}") - F.col(f"u{q}"), F.col(f"v{p}") - F.col(f"v{q}"))
    d1, d2, d3 = side("a", ""), side("", "b"), side("a", "b")
    cross = (F.col("u") - F.col("ua")) * (F.col("vb") - F.col("va")) - (F.col("v") - F.col("va")) * (F.col("ub") - F.col("ua"))
    bent = F.when(F.least(d1, d2, d3) >= 1e-3, 2 * F.abs(cross) / (d1 * d2 * d3))
    dx, dy = F.col("_last_a") - F.col("_first_a"), F.col("_last_b") - F.col("_first_b")
    away = F.abs(dx * (F.col("_b") - F.col("_first_b")) - dy * (F.col("_a") - F.col("_first_a"))) / F.nullif(F.hypot(dx, dy), F.lit(0.0))
    middle = -F.abs(F.row_number().over(w) - 1 - F.floor(F.col("_n") / 2))
    c = c.withColumn("curvature", F.when(bent > 0, bent)).withColumn("_far", F.when(F.hypot(dx, dy) < 1e-12, middle.cast("double")).otherwise(away))
    return c.orderBy(F.desc_nulls_last("curvature"), F.desc("_far"), order).limit(1).select(*curve.columns, "curvature")


def weighted_centroid(df: DataFrame, weight: Column, coords: list[str]) -> DataFrame:
    w = F.greatest(weight, F.lit(0.0))
    return df.agg(*[(F.sum(w * F.col(c)) / F.nullif(F.sum(w), F.lit(0.0))).alias(c) for c in coords])
