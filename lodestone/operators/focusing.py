"""Minimum-support focusing of a gravity model: reweighted least squares whose threshold cools down."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import blocks as B
from lodestone.sources.tables import stored

# Fixed values of the method.
SUPPORT, EPS_FIRST, EPS_LEAST, COOLING, ROUNDS, STILL = 1e-2, 0.80, 0.12, 0.90, 10, 1e-3
MOST_CONTRAST, DEPTH_POWER, SUPPRESSED, SPIKE = 1.60, 1.00, 0.15, 1.50


class Focused(NamedTuple):
    """model: voxel_id, m (of the best round); history: a row for each round; state: one row."""

    model: DataFrame
    history: DataFrame
    state: DataFrame


def scale_state(most: float, most_base: float) -> str:
    """UNSTABLE if the contrast has grown beyond SPIKE times the base model's, SUPPRESSED below SUPPRESSED, else OK."""
    if most_base > 1e-9 and most > SPIKE * most_base:
        return "UNSTABLE"
    return "SUPPRESSED" if most < SUPPRESSED else "OK"


def _rounds(g, cases: list, held: dict) -> dict[str, np.ndarray]:
    w, base, (a, b), n = held["w"], held["base"], held["edges"], g.n
    ahead, squares, _ = g.start()
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + np.bincount(held["border"], minlength=n)
    laplacian = lambda x: (degree * x - np.bincount(a, x[b], n) - np.bincount(b, x[a], n)) / 6
    smooth = held["smooth"] ** 2
    rms = lambda m: float(held["scale"] * np.sqrt((g.misfits(m[:, None])[0] + held["unseen"]) / held["sensors"]))
    # the diagonal of L'L: its columns' sums of squares
    rough = w**2 * smooth * (degree**2 + degree) / 36
    diagonal = w**2 * squares + rough
    crossed = 0.0
    m, eps, rounds = base, EPS_FIRST, []
    best, least, converged = base, np.inf, False
    for k in range(ROUNDS):
        x = m / np.maximum(w, 1e-12)
        focus = np.clip(1 / np.sqrt(np.maximum(x**2 + eps**2, (EPS_LEAST / np.maximum(w, 1e-12)) ** 2)), 0, 1 / EPS_LEAST)
        weight = SUPPORT * focus**2

        def times(p: np.ndarray, weight: np.ndarray = weight) -> np.ndarray:
            v = w * p[:, 0]
            return (w * (g.times(v[:, None])[:, 0] + smooth * laplacian(laplacian(v))) + weight * p[:, 0])[:, None]

        solve = g.preconditioner(rough + weight, w)
        x = B.conjugate_gradients(times, (w * ahead)[:, None], (diagonal + weight)[:, None], 5000, 1e-8, None if solve is None else lambda r, _, solve=solve: solve(r))[:, 0]
        crossed = max(crossed, float(np.linalg.norm((x * w)[held["border"]])))
        new = np.clip(x * w, 0, MOST_CONTRAST)
        delta = float(np.hypot(np.linalg.norm(new - m), held["beyond"] if k == 0 else 0.0) / max(np.linalg.norm(new), 1e-9))
        error = rms(new)
        if error < least:
            best, least = new, error
        rounds.append((k, eps, delta, error, float(new.max())))
        m, eps = new, max(eps * COOLING, EPS_LEAST)
        if delta < STILL:
            converged = True
            break
    return {"m": best[:, None], "rounds": np.array(rounds, float).ravel(), "ends": np.array([rms(base), float(converged), crossed * 4 * smooth * w.max(), np.linalg.norm(w * ahead)])}


def focusing(kernel: DataFrame, data: DataFrame, cells: DataFrame, edges: DataFrame, base: DataFrame, alpha: float = 2.0, most_kernel: int = B.MOST_KERNEL, least: int | None = None) -> Focused:
    """Focused models of base (voxel_id, m: a contrast), which itself isn't changed.

    kernel: obs_id, voxel_id, val; data: obs_id, d, and n if a row is that many sensors; cells: voxel_id, y; edges: src, dst. In a round, cells with a small
    contrast over eps weigh more (minimum support); eps cools from 0.80 by 0.9 to 0.12. At most ten rounds, fewer if the
    model moves by less than 1e-3; the round with the least root mean square misfit is kept. history: round, eps, delta,
    rms, max_contrast. state: scale_state, use_mode, best_round, rounds, converged, rms_best, rms_base, max_contrast,
    max_base. Cells far from the kernel's stay at 0 (blocks.Part); the others are at most blocks.MOST_CELLS, which is checked.
    """
    spark = kernel.sparkSession
    scale = kernel.agg(F.max(F.abs("val"))).first()[0]
    if not scale:
        raise ValueError("the kernel is empty")
    root = F.greatest("y", F.lit(1e-3)) ** (DEPTH_POWER / 2)
    cells, edges = stored(cells.select("voxel_id", "y", root.alias("w")), "cells").hint("merge"), stored(edges.select("src", "dst"), "edges").hint("merge")
    n, mean = cells.agg(F.count("*"), F.avg("w")).first()
    base = stored(base.select("voxel_id", F.least(F.greatest("m", F.lit(0.0)), F.lit(MOST_CONTRAST)).alias("m")), "base").hint("merge")
    copies = F.col("n") if "n" in data.columns else F.lit(1)
    scaled = kernel.withColumn("val", F.col("val") / scale)
    seen = data.select("obs_id", (F.col("d") / scale).alias("d"), (1 / F.sqrt(copies)).alias("sigma"))
    unseen = seen.join(kernel.select("obs_id").distinct(), "obs_id", "left_anti").agg(F.sum((F.col("d") / F.col("sigma")) ** 2)).first()[0] or 0.0
    sensors = data.agg(F.sum(copies)).first()[0] or 0
    part = B.Part(cells, edges, stored(kernel.select("voxel_id").distinct().join(cells.select("voxel_id"), "voxel_id", "left_semi"), "seeds"), True, least)
    most_base = float(base.agg(F.max("m")).first()[0] or 0.0)
    while True:
        if part.size > B.MOST_CELLS:
            raise ValueError(f"more than {B.MOST_CELLS} cells")
        own = part.inside(cells, "voxel_id")
        ids = B.cell_ids(own)
        w, = B.on_cells(ids, own, ["w"], [0.0])
        start, = B.on_cells(ids, part.inside(base, "voxel_id"), ["m"], [0.0])
        beyond = part.outside(base).agg(F.sqrt(F.sum(F.col("m") ** 2))).first()[0] or 0.0
        held = {"w": w / mean, "base": start, "beyond": beyond, "border": part.border(ids)[0], "edges": B.pairs_on(ids, part.inside(edges, "src", "dst"), ["src", "dst"]), "smooth": alpha * sensors / n, "scale": scale, "unseen": unseen, "sensors": sensors}
        (_, got), = B.Blocks(scaled, seen, ids).solve(_rounds, [(0,)], held, most_kernel)
        crossed, whole = got["ends"].ravel()[2:]
        if part.whole or crossed <= 1e-11 * whole:
            break
        part = part.grown()
    rounds, (rms_base, converged) = got["rounds"].reshape(-1, 5), got["ends"].ravel()[:2]
    best, most = int(rounds[:, 3].argmin()), float(got["m"].max())
    label = scale_state(most, most_base)
    state = (label, "physical_mask_candidate" if label == "OK" else "relative_targeting_score", best, len(rounds), bool(converged), float(rounds[best, 3]), float(rms_base), most, most_base)
    return Focused(
        B.as_table(spark, ids, [([(0,)], got["m"])]).select("voxel_id", "m").unionByName(part.outside(cells).select(F.col("voxel_id").cast("long"), F.lit(0.0).alias("m"))),
        spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rounds], "round int, eps double, delta double, rms double, max_contrast double"),
        spark.createDataFrame([state], "scale_state string, use_mode string, best_round int, rounds int, converged boolean, rms_best double, rms_base double, max_contrast double, max_base double"),
    )
