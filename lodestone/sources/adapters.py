"""Survey and block-model relations derived from the star-schema tables by exact integer arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The same relations in SQL. Divisions of integers are written out, so both engines agree.
VIEWS = {
    "v_voxels": """SELECT p_partkey AS voxel_id, p_partkey % 20 AS ix, (p_partkey // 20) % 10 AS iy, p_partkey // 200 AS iz,
        CAST(2.6 AS DOUBLE) + CAST(1.6 AS DOUBLE) * CAST((p_size * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS density,
        CAST((p_partkey * 53) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS probability,
        CAST((p_partkey * 17) % 97 AS DOUBLE) / CAST(50 AS DOUBLE) AS grade,
        CASE WHEN CAST((p_partkey * 17) % 97 AS DOUBLE) / CAST(50 AS DOUBLE) > CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END AS domain,
        CAST(p_partkey % 20 AS DOUBLE) * 25 + CAST(12.5 AS DOUBLE) AS x, CAST((p_partkey // 20) % 10 AS DOUBLE) * 25 + CAST(12.5 AS DOUBLE) AS y, CAST(p_partkey // 200 AS DOUBLE) * 25 + CAST(12.5 AS DOUBLE) AS z
        FROM part""",
    "v_obs": """SELECT c_custkey AS obs_id, CAST((c_custkey * 7919) % 5003 AS DOUBLE) AS x_m, CAST(0 AS DOUBLE) AS y_m, CAST((c_custkey * 104729) % 4999 AS DOUBLE) AS z_m,
        c_acctbal AS g, CASE c_nationkey % 3 WHEN 0 THEN 'mGal' WHEN 1 THEN 'uGal' ELSE 'm/s2' END AS unit FROM customer""",
    "v_obs_dups": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS src_row,
        CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y, l_quantity AS z, l_extendedprice AS g FROM lineitem""",
    "v_sensors": """SELECT s_suppkey AS obs_id, CAST((s_suppkey * 37) % 500 AS DOUBLE) AS x_m, CAST(-1 AS DOUBLE) AS y_m, CAST((s_suppkey * 91) % 250 AS DOUBLE) AS z_m,
        s_acctbal AS g FROM supplier""",
    "v_boreholes": """SELECT n_nationkey AS hole, CAST((n_nationkey * 61) % 500 AS DOUBLE) AS x_m, CAST((n_nationkey * 43) % 250 AS DOUBLE) AS z_m,
        CAST((n_nationkey * 7) % 100 AS DOUBLE) AS y_from_m, CAST((n_nationkey * 7) % 100 + 60 AS DOUBLE) AS y_to_m, CAST(2.5 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) / CAST(20 AS DOUBLE) AS density FROM nation""",
    "v_dem": """SELECT n.row, n.col, CAST(1000 + 3 * n.row + 5 * n.col AS DOUBLE) + coalesce(q.total / q.lines, 0) AS elev FROM (SELECT r.range AS row, c.range AS col FROM range(0, 32) r, range(0, 32) c) n
        LEFT JOIN (SELECT l_orderkey % 32 AS row, (l_orderkey // 32 + l_linenumber) % 32 AS col, CAST(sum(l_linenumber) AS DOUBLE) AS total, count(*) AS lines FROM lineitem GROUP BY 1, 2) q ON q.row = n.row AND q.col = n.col""",
}


def with_views(sql: str) -> str:
    """sql preceded by the views that it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    recursive = "RECURSIVE " if sql.strip().upper().startswith("WITH RECURSIVE") or "FROM r WHERE i <" in sql else ""
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = re.sub(r"^WITH RECURSIVE\b", "WITH", sql.strip())
    return f"WITH {recursive}{head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and columns of a table() with all rows of a key in one task, in the order of their file (files by path), so that a sum of a key has one result, however the files are split."""
    placed = rows.select(key, *columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return placed.repartition(key).sortWithinPartitions(key, "_path", "_row").drop("_path", "_row")


def _d(c):
    return c.cast("double")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxel_id, ix, iy, iz, density, probability, grade, domain and cell centres on a 25 m grid of 20 x 10 cells a level.

    Joins of voxels shuffle unless the other side is said to be small: a file of a million of them can be below Spark's size for a broadcast.
    """
    p = F.col("p_partkey")
    grade = _d(p * 17 % 97) / 50.0
    iy, iz = F.expr("p_partkey DIV 20") % 10, F.expr("p_partkey DIV 200")
    return table(spark, sf_dir, "part").select(
        p.alias("voxel_id"), (p % 20).alias("ix"), iy.alias("iy"), iz.alias("iz"),
        (2.6 + 1.6 * _d(F.col("p_size") * 37 % 101) / 100.0).alias("density"), (_d(p * 53 % 101) / 100.0).alias("probability"),
        grade.alias("grade"), F.when(grade > 0.6, 1).otherwise(0).alias("domain"),
        (_d(p % 20) * 25 + 12.5).alias("x"), (_d(iy) * 25 + 12.5).alias("y"), (_d(iz) * 25 + 12.5).alias("z"),
    ).hint("merge")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    unit = F.element_at(F.array(F.lit("mGal"), F.lit("uGal"), F.lit("m/s2")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("obs_id"), _d(k * 7919 % 5003).alias("x_m"), F.lit(0.0).alias("y_m"), _d(k * 104729 % 4999).alias("z_m"), F.col("c_acctbal").alias("g"), unit.alias("unit"))


ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, g and what orders the rows; no global row number, which would take one task."""
    return table(spark, sf_dir, "lineitem").select(_d(F.col("l_partkey") % 500).alias("x"), _d(F.col("l_suppkey") % 100).alias("y"), F.col("l_quantity").alias("z"), F.col("l_extendedprice").alias("g"), F.struct(*ROW_ORDER).alias("src"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("obs_id"), _d(k * 37 % 500).alias("x_m"), F.lit(-1.0).alias("y_m"), _d(k * 91 % 250).alias("z_m"), F.col("s_acctbal").alias("g"))


def boreholes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("hole"), _d(k * 61 % 500).alias("x_m"), _d(k * 43 % 250).alias("z_m"), _d(k * 7 % 100).alias("y_from_m"), _d(k * 7 % 100 + 60).alias("y_to_m"), (2.5 + _d(k) / 20.0).alias("density"))


def dem(spark: SparkSession, sf_dir: str, size: int = 32) -> DataFrame:
    """row, col, elev of a square grid: a slope, and on it the mean line number of the order lines that fall on a node."""
    r, c = F.expr(f"id DIV {size}"), F.col("id") % size
    row, col = F.col("l_orderkey") % size, (F.expr(f"l_orderkey DIV {size}") + F.col("l_linenumber")) % size
    lines = table(spark, sf_dir, "lineitem").groupBy(row.alias("row"), col.alias("col")).agg((_d(F.sum("l_linenumber")) / F.count("*")).alias("mean"))
    nodes = spark.range(size * size).select(r.alias("row"), c.alias("col"))
    return nodes.join(lines, ["row", "col"], "left").select("row", "col", (_d(1000 + 3 * F.col("row") + 5 * F.col("col")) + F.coalesce("mean", F.lit(0.0))).alias("elev"))
