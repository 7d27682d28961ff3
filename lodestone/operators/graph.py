"""Graphs as edge tables: components by large and small stars, precedence arcs, closures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.profile import numbered
from lodestone.operators.spatial import dealt, within_radius
from lodestone.sources.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that it reaches) for every node of edges (src, dst) but the least ones.

    Large-star and small-star steps in turn, equi-joins and aggregates, until nothing changes. Each step's edges are stored;
    joins shuffle, as files of regular numbers are far smaller than their rows.
    """
    kept = lambda df: stored(df.distinct(), "edges").hint("merge")
    cur = kept(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")))
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = None
    while seen != (now := mark(cur)):
        seen = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))).hint("merge")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = kept(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        tight = wide.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = kept(tight.unionByName(low.withColumnRenamed("m", "v")))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label"))


def labelled(nodes: DataFrame, edges: DataFrame, key: str = "voxel_id") -> DataFrame:
    """nodes with label; a node without edges is its own."""
    return nodes.join(components(edges).withColumnRenamed("node", key), key, "left").select(key, F.coalesce("label", key).alias("label"))


def radius_edges(points: DataFrame, radius: float, key: str = "voxel_id", coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """src, dst: points at most radius apart, src before dst; an equi-join on cells of that width.

    points are the centres of different grid cells, so a bucket holds a bounded number of them.
    """
    left = points.select(F.col(key).alias("src"), *[F.col(c).alias(f"_l{c}") for c in coords])
    right = points.select(F.col(key).alias("dst"), *[F.col(c).alias(f"_r{c}") for c in coords])
    return within_radius(left, right, [(f"_l{c}", f"_r{c}") for c in coords], radius).where("src < dst").select("src", "dst")


def joint_bodies(cells: DataFrame, a: str, b: str, size: float, volume: float, threshold: float = 0.6, factor: float = 1.5, least: int = 5) -> DataFrame:
    """rank, label, cells, volume_m3, x, y, z, a_mean, a_max, b_mean, b_max, correlation of the bodies of cells (voxel_id, x, y, z, a, b).

    A cell counts if the root of the sum of squares of both excesses (above the median, as a share of the range up to
    the maximum, 0 without a range) is above threshold. Cells within factor times size, the largest cell edge, belong
    together; bodies of fewer than `least` cells are left out. Largest first, ties to the smaller label (least voxel_id);
    correlation is null where a value doesn't vary.
    """
    ends = cells.agg(*[f(c).alias(f"_{n}{c}") for c in (a, b) for n, f in (("mid", lambda c: F.percentile(c, 0.5)), ("top", F.max))])
    excess = lambda c: F.when(F.col(f"_top{c}") > F.col(f"_mid{c}"), F.greatest((F.col(c) - F.col(f"_mid{c}")) / (F.col(f"_top{c}") - F.col(f"_mid{c}")), F.lit(0.0))).otherwise(0.0)
    mask = cells.join(F.broadcast(ends)).where(F.sqrt(excess(a) ** 2 + excess(b) ** 2) > threshold).select("voxel_id", "x", "y", "z", a, b)  # ends is one row
    mask = stored(mask, "mask").hint("merge")
    own = mask.join(labelled(mask.select("voxel_id"), radius_edges(mask, factor * size)), "voxel_id")
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    stats = [F.avg(c).alias(c) for c in "xyz"] + [f(c).alias(f"{n}_{m}") for n, c in (("a", a), ("b", b)) for m, f in (("mean", F.avg), ("max", F.max))]
    out = own.groupBy("label").agg(F.count("*").alias("cells"), (F.count("*") * F.lit(float(volume))).alias("volume_m3"), *stats, F.when(varies, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).alias("correlation"))
    return numbered(out.where(F.col("cells") >= least).withColumn("_order", F.struct((-F.col("cells")).alias("n"), "label")), "_order", "rank").select("rank", *out.columns)


def precedence_arcs(blocks: DataFrame, dx: float, dy: float, angle: float) -> DataFrame:
    """src, dst: every block needs those one level up (iy - 1) within dy / tan(angle) sideways. Blocks have voxel_id, ix, iy, iz.

    Blocks are counted first, so that a task's share of their copies stays the same however many there are.
    """
    reach = dy / math.tan(math.radians(angle))
    k = int(reach // dx)
    around = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if (i * dx) ** 2 + (j * dx) ** 2 <= reach * reach + 1e-9]
    kernel = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])
    asked = blocks.select(F.col("voxel_id").alias("src"), "ix", "iy", "iz", F.explode(kernel).alias("k")).select("src", (F.col("ix") + F.col("k.i")).alias("ix"), (F.col("iy") - 1).alias("iy"), (F.col("iz") + F.col("k.j")).alias("iz"))
    above = blocks.select(F.col("voxel_id").alias("dst"), "ix", "iy", "iz")
    keys, rows = ["ix", "iy", "iz"], blocks.count() * len(around)
    return dealt(asked, rows, keys).join(dealt(above, rows, keys), keys).select("src", "dst")
