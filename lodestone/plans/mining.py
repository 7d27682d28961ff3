"""Queries on mine plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import mine as M
from lodestone.plans.registry import query
from lodestone.sources import adapters as A

_ECON = """econ AS (SELECT voxel_id, ix, iy, iz, grade, domain, density * 15625 AS tonnage, sqrt(pow(ix * 25 - 250, 2) + pow(iz * 25 - 125, 2)) + iy * CAST(25 AS DOUBLE) / CAST(0.1 AS DOUBLE) AS haul_m FROM v_voxels),
cash AS (SELECT *, tonnage * (CAST(2 AS DOUBLE) + haul_m * CAST(0.001 AS DOUBLE)) + CASE WHEN domain > 0 THEN tonnage * CAST(8 AS DOUBLE) ELSE 0 END AS cost, tonnage * (grade / 100) * CAST(0.85 AS DOUBLE) * CAST(900 AS DOUBLE) AS revenue FROM econ)"""


def _blocks(spark, sf_dir, price=900.0):
    v = A.voxels(spark, sf_dir).withColumn("tonnage", F.col("density") * 15625)
    return M.economics(v, F.lit(price), 0.85, 2.0, 8.0, 0.001, 0.1, 25.0, 20, 10)


@query("block_economics", f"WITH {_ECON} SELECT voxel_id, round(haul_m, 4) AS haul_m, round(cost, 2) AS cost, round(revenue, 2) AS revenue, round(revenue - cost, 2) AS profit FROM cash")
def block_economics(spark, sf_dir):
    return _blocks(spark, sf_dir).select("voxel_id", F.round("haul_m", 4).alias("haul_m"), *[F.round(c, 2).alias(c) for c in ("cost", "revenue", "profit")])


@query("tonnage_normalised", "SELECT voxel_id, round(CASE WHEN (SELECT max(density * 62500000) FROM v_voxels) > 100000000 THEN density * 15625 ELSE density * 62500000 END, 4) AS tonnage FROM v_voxels")
def tonnage_normalised(spark, sf_dir):
    v = A.voxels(spark, sf_dir).withColumn("t", F.col("density") * 62_500_000)
    most = v.agg(F.max("t").alias("most"))
    return v.join(F.broadcast(most)).select("voxel_id", F.round(F.when(F.col("most") > 1e8, F.col("density") * 15625).otherwise(F.col("t")), 4).alias("tonnage"))


@query("precedence_arcs", """
WITH k AS (SELECT i.range AS i, j.range AS j FROM range(-1, 2) i, range(-1, 2) j WHERE (i.range * i.range + j.range * j.range) * 625 <= pow(25 / tan(radians(CAST(40 AS DOUBLE))), 2) + CAST(1e-9 AS DOUBLE))
SELECT a.voxel_id AS src, b.voxel_id AS dst FROM v_voxels a, k JOIN v_voxels b ON b.ix = a.ix + k.i AND b.iy = a.iy - 1 AND b.iz = a.iz + k.j""")
def precedence_arcs(spark, sf_dir):
    return G.precedence_arcs(A.voxels(spark, sf_dir), 25.0, 25.0, 40.0)


def _phases(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    cases = F.explode(F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(rf).alias("rf")) for i, rf in ((1, 0.65), (2, 0.85), (3, 1.0))])).alias("c")
    cased = b.select("voxel_id", "revenue", "cost", cases).select(F.col("c.scenario").alias("scenario"), "voxel_id", (F.col("revenue") * F.col("c.rf") - F.col("cost")).alias("profit"))
    mined = M.pits(cased, G.precedence_arcs(b, 25.0, 25.0, 40.0))
    return b, mined.groupBy("voxel_id").agg(F.min("scenario").alias("phase"))


@query("pit_phases")
def pit_phases(spark, sf_dir):
    """voxel_id, phase of three nested pits. Tests hold: closed under the arcs, best of all closures on small grids."""
    return _phases(spark, sf_dir)[1]


@query("pit_closure", """
WITH k AS (SELECT i.range AS i, j.range AS j FROM range(-1, 2) i, range(-1, 2) j WHERE (i.range * i.range + j.range * j.range) * 625 <= pow(25 / tan(radians(CAST(40 AS DOUBLE))), 2) + CAST(1e-9 AS DOUBLE))
SELECT count(*) AS arcs, CAST(0 AS BIGINT) AS broken FROM v_voxels a, k JOIN v_voxels b ON b.ix = a.ix + k.i AND b.iy = a.iy - 1 AND b.iz = a.iz + k.j""")
def pit_closure(spark, sf_dir):
    """arcs, broken: the arcs whose block is mined before one above it that it needs, of pit_phases."""
    b, phases = _phases(spark, sf_dir)
    arcs = G.precedence_arcs(b, 25.0, 25.0, 40.0)
    of = lambda k: phases.select(F.col("voxel_id").alias(k), F.col("phase").alias(f"{k}_phase"))
    met = arcs.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return met.agg(F.count("*").alias("arcs"), F.count_if(F.col("src_phase").isNotNull() & (F.coalesce("dst_phase", F.lit(99)) > F.col("src_phase"))).alias("broken"))


@query("pit_metrics", f"""
WITH {_ECON}, p AS (SELECT *, revenue > cost AS ore FROM cash WHERE iy < 4)
SELECT round(sum(tonnage), 2) AS tonnage, round(sum(tonnage) FILTER (ore), 2) AS ore, round(sum(tonnage) FILTER (NOT ore), 2) AS waste, round(sum(tonnage) FILTER (NOT ore) / sum(tonnage) FILTER (ore), 6) AS strip_ratio, round(sum(tonnage * grade) FILTER (ore) / sum(tonnage) FILTER (ore), 6) AS grade, round(100 * CAST(8 AS DOUBLE) / (CAST(0.85 AS DOUBLE) * 900), 6) AS cutoff FROM p""")
def pit_metrics(spark, sf_dir):
    p = _blocks(spark, sf_dir).where("iy < 4").withColumn("ore", F.col("revenue") > F.col("cost"))
    of = lambda c, ore: F.sum(F.when(F.col("ore") == ore, c))
    t = F.col("tonnage")
    return p.agg(F.round(F.sum(t), 2).alias("tonnage"), F.round(of(t, True), 2).alias("ore"), F.round(of(t, False), 2).alias("waste"), F.round(of(t, False) / of(t, True), 6).alias("strip_ratio"), F.round(of(t * F.col("grade"), True) / of(t, True), 6).alias("grade"), F.lit(round(100 * 8.0 / (0.85 * 900), 6)).alias("cutoff"))


_METHOD = """b AS (SELECT *, density * 15625 / 1000 AS kt FROM v_voxels), c AS (SELECT count(*) FILTER (domain = {ore}) AS marked, quantile_cont(density, CAST(0.8 AS DOUBLE)) AS q80, count(*) AS total FROM b),
o AS (SELECT count(*) AS n, any_value(total) AS total, coalesce(max(y), 0) AS depth, sqrt((max(x) - min(x) + 1) * (max(z) - min(z) + 1)) / greatest(max(y) - min(y) + 1, 1) AS aspect, coalesce(sum(kt), 0) AS kt FROM b, c WHERE CASE WHEN marked > 0 THEN domain = {ore} ELSE density >= q80 END),
s AS (SELECT *, CASE WHEN n > 0 THEN CAST(total - n AS DOUBLE) / n ELSE 99 END AS strip, CASE WHEN aspect > CAST(1.5 AS DOUBLE) THEN 'massive' WHEN aspect > CAST(0.7 AS DOUBLE) THEN 'intermediate' ELSE 'narrow_deep' END AS geometry FROM o),
g AS (SELECT *, CAST({quality} AS DOUBLE) * (CASE WHEN depth < 150 THEN CAST(0.4 AS DOUBLE) WHEN depth < 300 THEN CAST(0.25 AS DOUBLE) WHEN depth < 450 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN strip < 4 THEN CAST(0.3 AS DOUBLE) WHEN strip < 8 THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE geometry WHEN 'massive' THEN CAST(0.2 AS DOUBLE) WHEN 'narrow_deep' THEN 0 ELSE CAST(0.1 AS DOUBLE) END + CASE WHEN kt > 20000 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) AS pit,
CAST({quality} AS DOUBLE) * (CASE WHEN depth < 150 THEN 0 WHEN depth < 300 THEN CAST(0.1 AS DOUBLE) WHEN depth < 450 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END + CASE WHEN strip < 4 THEN 0 WHEN strip < 8 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END + CASE geometry WHEN 'massive' THEN 0 WHEN 'narrow_deep' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END + CASE WHEN kt < 1000 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) AS under FROM s)
SELECT n AS ore_blocks, depth AS depth_m, round(strip, 6) AS strip_ratio, geometry, round(kt, 3) AS tonnage_kt, round(pit, 6) AS open_pit, round(under, 6) AS underground, round(greatest(pit, under), 3) AS confidence,
CASE WHEN n = 0 OR greatest(pit, under) < CAST(0.3 AS DOUBLE) THEN 'needs_more_data' WHEN pit >= under THEN 'open_pit' ELSE 'underground' END AS recommendation FROM g"""


for _name, _ore, _overall in (("mine_method", 1, "MEDIUM"), ("mine_method_fallback", 7, "LOW")):

    @query(_name, "WITH " + _METHOD.format(ore=_ore, quality={"GOOD": 1.0, "MEDIUM": 0.85}.get(_overall, 0.6)))
    def mine_method(spark, sf_dir, ore=_ore, overall=_overall):
        """Of ore blocks, those of a domain, or without one the fifth of highest density."""
        v = A.voxels(spark, sf_dir).withColumn("kt", F.col("density") * 15625 / 1000)
        return M.mine_method(v, F.col("domain") == ore, F.lit(overall))


@query("mine_schedule")
def mine_schedule(spark, sf_dir):
    """voxel_id, phase, year. Tests hold: order, capacities but for a year's first block, rollover."""
    b, phase = _phases(spark, sf_dir)
    ready = b.join(phase, "voxel_id").select(F.lit(1).alias("run"), "voxel_id", "phase", "iy", "tonnage", "profit")
    return M.schedule(ready, 2e6, 1e6).join(phase, "voxel_id").select("voxel_id", "phase", "year")


@query("npv", "SELECT round(sum(cf / pow(CAST(1.1 AS DOUBLE), year)), 2) AS npv FROM (SELECT year(o_orderdate) - 1991 AS year, sum(o_totalprice) AS cf FROM orders GROUP BY 1)")
def npv(spark, sf_dir):
    cash = A.table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") - 1991).alias("year")).agg(F.sum("o_totalprice").alias("cf"))
    return cash.agg(F.round(M.npv(cash, 0.1), 2).alias("npv"))


@query("price_sweep")
def price_sweep(spark, sf_dir):
    """price, blocks mined and profit for five prices, a pit each. Tests hold: profit doesn't fall with the price."""
    b = _blocks(spark, sf_dir)
    cases = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("scenario")
    cased = b.select("voxel_id", "revenue", "cost", cases).withColumn("profit", F.col("revenue") * (0.5 + F.col("scenario") * 0.25) - F.col("cost"))
    mined = M.pits(cased.select("scenario", "voxel_id", "profit"), G.precedence_arcs(b, 25.0, 25.0, 40.0))
    got = cased.join(mined, ["scenario", "voxel_id"]).groupBy("scenario").agg(F.count("*").alias("blocks"), F.sum("profit").alias("profit"))
    return got.select((900 * (0.5 + F.col("scenario") * 0.25)).alias("price"), "blocks", F.round("profit", 2).alias("profit"))


@query("column_topography", """
WITH r AS (SELECT ix, iz, min(iy) FILTER (density >= CAST(2.7 AS DOUBLE)) AS top, max(iy) FILTER (grade > 1) AS last FROM v_voxels GROUP BY ix, iz) SELECT ix, iz, top, last + 1 - top AS depth, CAST(ceil(CAST((last + 1 - top) * 25 AS DOUBLE) / 15) AS BIGINT) AS benches FROM r""")
def column_topography(spark, sf_dir):
    r = A.voxels(spark, sf_dir).groupBy("ix", "iz").agg(F.min(F.when(F.col("density") >= 2.7, F.col("iy"))).alias("top"), F.max(F.when(F.col("grade") > 1, F.col("iy"))).alias("last"))
    depth = F.col("last") + 1 - F.col("top")
    return r.select("ix", "iz", "top", depth.alias("depth"), F.ceil(depth * 25 / 15.0).alias("benches"))


@query("truck_speed", "SELECT s_suppkey, round(least((800 + s_suppkey % 400) * CAST(0.85 AS DOUBLE) / ((200 + s_suppkey % 100) * CAST(9.81 AS DOUBLE) * (CAST(0.02 AS DOUBLE) + CAST(s_suppkey % 10 AS DOUBLE) / 100)) * CAST(3.6 AS DOUBLE), 35), 6) AS kmh FROM supplier")
def truck_speed(spark, sf_dir):
    k = F.col("s_suppkey")
    v = M.truck_speed_kmh((800 + k % 400).cast("double"), 0.85, (200 + k % 100).cast("double"), 0.02 + (k % 10).cast("double") / 100, True)
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(v, 6).alias("kmh"))


@query("fleet_simulation")
def fleet_simulation(spark, sf_dir):
    """fleet, trips in a shift, seeded. Tests hold: repeatable, bounded by the shovel."""
    s = A.table(spark, sf_dir, "supplier")
    return M.simulate_fleet(s.select((F.col("s_suppkey") % 5).alias("fleet"), F.col("s_suppkey").alias("truck"), (10 + F.col("s_suppkey") % 7).cast("double").alias("haul_min"), F.lit(3.0).alias("load_min")), 480.0)
