"""Mine planning: block economics, ultimate pits by maximum closure, phases, schedules, fleet simulation."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import stored


def economics(blocks: DataFrame, price: Column, recovery: float, mining: float, processing: float, haulage: float, ramp: float, size: float, nx: int, nz: int) -> DataFrame:
    """blocks (ix, iy, iz, tonnage, grade, domain) with haul_m, cost, revenue and profit."""
    flat = F.hypot(F.col("ix") * size - nx * size / 2.0, F.col("iz") * size - nz * size / 2.0)
    haul = flat + F.col("iy") * size / ramp
    cost = F.col("tonnage") * (mining + haul * haulage) + F.when(F.col("domain") > 0, F.col("tonnage") * processing).otherwise(0.0)
    revenue = F.col("tonnage") * (F.col("grade") / 100.0) * recovery * price
    return blocks.withColumns({"haul_m": haul, "cost": cost, "revenue": revenue}).withColumn("profit", F.col("revenue") - F.col("cost"))


def maximum_closure(profit: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The set of blocks of greatest profit that holds with each block all it needs (src needs dst): Dinic's maximum flow."""
    n = len(profit)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, c: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((c, 0.0))

    for i, p in enumerate(profit.tolist()):
        if p > 0:
            arc(s, i, p)
        elif p < 0:
            arc(i, t, -p)
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        arc(a, b, float("inf"))
    eps = 1e-9 * max(1.0, float(np.abs(profit).max(initial=0)))
    while True:
        depth = [-1] * (n + 2)
        depth[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > eps and depth[to[e]] < 0:
                    depth[to[e]] = depth[u] + 1
                    queue.append(to[e])
        if depth[t] < 0:
            return np.array(depth[:n]) >= 0
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= eps)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[u] < len(head[u]) and not (room[head[u][at[u]]] > eps and depth[to[head[u][at[u]]]] == depth[u] + 1):
                at[u] += 1
            if at[u] < len(head[u]):
                path.append(head[u][at[u]])
                u = to[path[-1]]
            elif path:
                depth[u] = -1
                u = to[path.pop() ^ 1]
            else:
                break


#: Rows up to which one side of a join is broadcast (16 MB of keys), counted before.
FEW_ROWS = 1 << 20


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df with the way it is joined: broadcast if it has few rows, else shuffled."""
    n = df.count()
    return (F.broadcast(df) if n <= FEW_ROWS else df.hint("merge")), n


def needed(blocks: DataFrame, arcs: DataFrame) -> DataFrame:
    """scenario, voxel_id of the blocks with a profit and all that they need, directly or not: no other block is ever mined.

    Level by level: a join of the last level's blocks with the arcs (src, dst), until nothing is new.
    """
    every = stored(blocks.where("profit > 0").select("scenario", "voxel_id"), "needed")
    last, n = _counted(every)
    while n:
        level = arcs.join(last.withColumnRenamed("voxel_id", "src"), "src").select("scenario", F.col("dst").alias("voxel_id")).distinct()
        level = stored(level.join(every.hint("merge"), ["scenario", "voxel_id"], "left_anti"), "needed")
        every = every.unionByName(level)
        last, n = _counted(level)
    return every


def pits(blocks: DataFrame, arcs: DataFrame) -> DataFrame:
    """scenario, voxel_id of the blocks mined in each scenario (blocks: scenario, voxel_id, profit; arcs: src, dst for all).

    A scenario's blocks that might be mined (see needed()) are one task's; the others, however many, never meet.
    """

    def solve(key, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("voxel_id", ignore_index=True)
        ids = own.voxel_id.to_numpy()
        mined = maximum_closure(own.profit.to_numpy(), np.searchsorted(ids, edges.src.to_numpy()), np.searchsorted(ids, edges.dst.to_numpy()))
        return pd.DataFrame({"scenario": own.scenario[mined], "voxel_id": ids[mined]})

    arcs = stored(arcs, "arcs").hint("merge")
    kept, _ = _counted(stored(needed(blocks, arcs), "needed"))
    own = blocks.select("scenario", "voxel_id", "profit").join(kept, ["scenario", "voxel_id"])
    of = arcs.join(kept.select("scenario", F.col("voxel_id").alias("src")), "src").select(F.col("scenario").alias("of"), "src", "dst")
    return own.groupBy("scenario").cogroup(of.groupBy("of")).applyInPandas(solve, "scenario int, voxel_id long")


def _sums_by_range(ranged: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """ranged (_part, run, ...) with running sums over each run: each range for itself, shifted by the totals of the run's ranges before."""
    within = Window.partitionBy("_part", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("run").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("_part", "run").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    base = totals.select("_part", "run", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    out = ranged.withColumns({n: F.sum(v).over(within) for n, v in sums.items()}).join(base, ["_part", "run"])
    return out.select(*ranged.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums])


def _first_beyond(points: DataFrame, asked: DataFrame) -> DataFrame:
    """run, at, to: for each row of asked (run, at, v, tie) the pos of the first of points (run, pos, v) with (v, pos) > (v, tie); none is left out.

    An as-of join: both sides in one order over ranges, the next point within the range, else the first of the run's later ranges.
    """
    none = F.lit(None).cast("long")
    rows = points.select("run", "v", F.col("pos").alias("tie"), F.lit(0).alias("kind"), "pos", none.alias("at")).unionByName(asked.select("run", "v", "tie", F.lit(1).alias("kind"), none.alias("pos"), "at"))
    ranged = stored(rows.repartitionByRange("run", "v", "tie", "kind").withColumn("_part", F.spark_partition_id()), "year-ranges")
    ahead = Window.partitionBy("_part", "run").orderBy(*[F.desc(c) for c in ("v", "tie", "kind")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("run").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = ranged.groupBy("_part", "run").agg(F.min("pos").alias("first")).select("_part", "run", F.min("first").over(later).alias("_later"))
    found = ranged.withColumn("_own", F.min("pos").over(ahead)).where("kind = 1").join(firsts, ["_part", "run"])
    return found.select("run", "at", F.coalesce("_own", "_later").alias("to")).where("to IS NOT NULL")


def schedule(blocks: DataFrame, mine_capacity: float, plant_capacity: float) -> DataFrame:
    """run, voxel_id, year: blocks in the order of phase, bench and value a ton; a block that doesn't fit opens the next year.

    With running tonnages, the block that would end a year begun at any block is an as-of join. The years that do begin are the
    ones reached from a run's first block; marking them doubles its reach each round, so the rounds are the logarithm of the years.
    No run is held in one task. Tonnages are 0 or more; a block above a capacity uses up its year. Sums are in doubles, so a year
    that is full to the last digit may end a block sooner or later than by taking tonnages off one by one.
    """
    t, ore = F.col("tonnage"), F.col("profit") > 0
    vpt = F.when(t > 0, F.col("profit") / t).otherwise(0.0)
    order = [F.col("phase"), F.col("iy"), F.desc("vpt"), F.col("voxel_id")]
    rows = blocks.select("run", "voxel_id", "phase", "iy", t.cast("double").alias("tonnage"), F.when(ore, t).otherwise(0.0).cast("double").alias("milled"), ore.alias("ore"), vpt.alias("vpt"))
    ranged = stored(rows.repartitionByRange("run", *order).withColumn("_part", F.spark_partition_id()), "schedule-ranges")
    rows = stored(_sums_by_range(ranged, order, {"mined": F.col("tonnage"), "fed": F.col("milled"), "pos": F.lit(1).cast("long")}), "schedule-sums")

    def ends(total: str, own: str, capacity: float, what: Column) -> DataFrame:
        over = F.col(own) > capacity
        bound = F.when(over, F.col(total)).otherwise(F.col(total) - F.col(own) + capacity)
        asked = rows.select("run", F.col("pos").alias("at"), bound.alias("v"), F.when(over, F.col("pos")).otherwise(F.lit(2**63 - 1)).alias("tie"))
        return _first_beyond(rows.where(what).select("run", "pos", F.col(total).alias("v")), asked)

    jump = ends("mined", "tonnage", mine_capacity, F.lit(True)).unionByName(ends("fed", "milled", plant_capacity, F.col("ore")))
    jump = stored(jump.groupBy("run", "at").agg(F.min("to").alias("to")), "year-jumps")
    too_large = (F.col("tonnage") > mine_capacity) | (F.col("milled") > plant_capacity)
    # a run's first block above a capacity leaves year 1 empty
    begun = stored(rows.where("pos = 1").select("run", "pos", F.when(too_large, 2).otherwise(1).alias("opens")), "years")
    while True:
        reached = stored(begun.join(jump, (begun.run == jump.run) & (begun.pos == jump["at"])).select(begun.run, F.col("to").alias("pos"), F.lit(1).alias("opens")), "years")
        if not reached.head(1):
            break
        begun = begun.unionByName(reached)
        far = jump.select("run", F.col("at").alias("to"), F.col("to").alias("_far"))
        jump = stored(jump.join(far, ["run", "to"]).select("run", "at", F.col("_far").alias("to")), "year-jumps")
    flagged = rows.select("_part", "run", "voxel_id", "pos").join(begun, ["run", "pos"], "left").na.fill(0, ["opens"])
    return _sums_by_range(flagged, [F.col("pos")], {"year": F.col("opens")}).select("run", "voxel_id", F.col("year").cast("int").alias("year"))


def mine_method(blocks: DataFrame, ore: Column, overall_level: Column) -> DataFrame:
    """One row: scores of open pit and underground from depth, strip ratio, geometry and tonnage of the ore, less for a poor run; the better one is recommended.

    blocks: x, y (depth), z, density, kt. Without a row of `ore`, blocks at or above the 80th percentile of density count.
    A score below 0.3, or no block, needs more data.
    """
    all_ = blocks.agg(F.count(F.when(ore, 1)).alias("_marked"), F.percentile("density", 0.8).alias("_q80"), F.count("*").alias("_total"))
    span = lambda c: F.max(c) - F.min(c) + 1
    kept = blocks.join(F.broadcast(all_)).where(F.when(F.col("_marked") > 0, ore).otherwise(F.col("density") >= F.col("_q80")))
    o = kept.agg(F.count("*").alias("n"), F.first("_total").alias("total"), F.coalesce(F.max("y"), F.lit(0.0)).alias("depth_m"), (F.sqrt(span("x") * span("z")) / F.greatest(span("y"), F.lit(1.0))).alias("aspect"), F.coalesce(F.sum("kt"), F.lit(0.0)).alias("kt"))
    d, kt = F.col("depth_m"), F.col("kt")
    r = F.when(F.col("n") > 0, (F.col("total") - F.col("n")) / F.col("n")).otherwise(99.0)
    shape = F.when(F.col("aspect") > 1.5, "massive").when(F.col("aspect") > 0.7, "intermediate").otherwise("narrow_deep")
    of_shape = lambda massive, narrow: F.when(shape == "massive", massive).when(shape == "narrow_deep", narrow).otherwise(0.1)
    quality = F.when(overall_level == "GOOD", 1.0).when(overall_level == "MEDIUM", 0.85).otherwise(0.6)
    pit = F.when(d < 150, 0.4).when(d < 300, 0.25).when(d < 450, 0.1).otherwise(0.0) + F.when(r < 4, 0.3).when(r < 8, 0.15).otherwise(0.0) + of_shape(0.2, 0.0) + F.when(kt > 20_000, 0.1).otherwise(0.0)
    under = F.when(d < 150, 0.0).when(d < 300, 0.1).when(d < 450, 0.25).otherwise(0.4) + F.when(r < 4, 0.0).when(r < 8, 0.05).otherwise(0.3) + of_shape(0.0, 0.2) + F.when(kt < 1000, 0.1).otherwise(0.0)
    s = o.select(F.col("n").alias("ore_blocks"), "depth_m", F.round(r, 6).alias("strip_ratio"), shape.alias("geometry"), F.round("kt", 3).alias("tonnage_kt"), (quality * pit).alias("p"), (quality * under).alias("u"))
    best = F.greatest("p", "u")
    advice = F.when((F.col("ore_blocks") == 0) | (best < 0.3), "needs_more_data").when(F.col("p") >= F.col("u"), "open_pit").otherwise("underground")
    return s.select("ore_blocks", "depth_m", "strip_ratio", "geometry", "tonnage_kt", F.round("p", 6).alias("open_pit"), F.round("u", 6).alias("underground"), F.round(best, 3).alias("confidence"), advice.alias("recommendation"))


def npv(cash: DataFrame, rate: float) -> Column:
    return F.sum(F.col("cf") / F.pow(F.lit(1 + rate), F.col("year").cast("double")))


def truck_speed_kmh(power_kw: Column, efficiency: float, mass_t: Column, resistance: Column, loaded: bool) -> Column:
    return F.least(power_kw * efficiency / (mass_t * 9.81 * resistance) * 3.6, F.lit(35.0 if loaded else 50.0))


def simulate_fleet(trucks: DataFrame, minutes: float, seed: int = 0) -> DataFrame:
    """fleet, trips: trucks (fleet, truck, haul_min, load_min) of a fleet share one shovel, in the order they come back.

    Times vary by a tenth, from a generator seeded by fleet.
    """
    import heapq

    def run(own: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(own.fleet.iloc[0])])
        back = [(0.0, int(t), h, ld) for t, h, ld in zip(own.truck, own.haul_min, own.load_min, strict=True)]
        heapq.heapify(back)
        free, trips = 0.0, 0
        while back and back[0][0] < minutes:
            at, truck, haul, load = heapq.heappop(back)
            free = max(at, free) + load * rng.uniform(0.9, 1.1)
            heapq.heappush(back, (free + haul * rng.uniform(0.9, 1.1), truck, haul, load))
            trips += 1
        return pd.DataFrame({"fleet": [own.fleet.iloc[0]], "trips": [trips]})

    return trucks.groupBy("fleet").applyInPandas(run, "fleet long, trips long")
