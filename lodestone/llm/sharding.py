"""Sharding: a k-d tree over metadata, split at distributed weighted medians.

Each node is split along the dimension in which it is widest, at the weighted quantile that
gives both sides bytes in proportion to the leaves they still need. A quantile is found by
histograms: each pass counts bytes in 4096 bins of the open range and goes on in the bin that
holds the quantile. Only the splits, a few numbers for each leaf, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import small_table, stored

#: Bits of a dimension's grid, of the hash that breaks ties on it, and of that part of it that tells equal rows apart.
GRID, TIE, TWIN = 20, 42, 16
BINS = 4096
#: After so many levels the rows' nodes are stored, so that a level doesn't repeat all joins before it.
STORE_LEVELS = 4


def prefix_number(text: Column) -> Column:
    """The first six UTF-8 bytes as a number, so that a string dimension keeps its order. Null is 0."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(0.0))


def _splits(cur: DataFrame, dims: list[str], open_nodes: dict[int, int], per_leaf: float, tolerance: float) -> list[tuple[int, int, int]]:
    """For each open node (with its number of leaves): (node, dimension, key from which rows go right)."""
    spark = cur.sparkSession
    spread = cur.groupBy("_ls_node").agg(F.sum("_ls_w").alias("w"), *[f(f"_ls_d{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))])
    state = {}
    for r in spread.where(F.col("_ls_node").isin(list(open_nodes))).collect():  # one row for each node
        wide = max(range(len(dims)), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
        k = open_nodes[r["_ls_node"]]
        lo, hi = r[f"lo{wide}"] << TIE, (r[f"hi{wide}"] + 1) << TIE
        state[r["_ls_node"]] = {"dim": wide, "lo": lo, "step": -(-(hi - lo) // BINS), "below": 0, "goal": r["w"] * (k // 2) / k}
    cuts: dict[int, int] = {}
    while len(cuts) < len(state):
        asked = [(n, s["dim"], s["lo"], s["step"], int(s["goal"] - s["below"])) for n, s in state.items() if n not in cuts]
        ask = F.broadcast(small_table(spark, asked, "_ls_node int, dim int, lo long, step long, goal long"))  # one row for each open node
        key = F.element_at(F.array(*[F.col(f"_ls_d{i}") for i in range(len(dims))]), F.col("dim") + 1) * F.lit(1 << TIE) + F.col("_ls_tie")
        bins = cur.join(ask, "_ls_node").withColumn("bin", F.call_function("div", key - F.col("lo"), F.col("step")))
        bins = bins.where((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy("_ls_node", "goal", "bin").agg(F.sum("_ls_w").alias("w"))
        bins = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("_ls_node").orderBy("bin")))
        hit = bins.where("upto >= goal").groupBy("_ls_node").agg(F.min(F.struct("bin", "w", "upto")).alias("h"))
        for r in hit.collect():
            s, h = state[r["_ls_node"]], r["h"]
            before, after = s["below"] + h["upto"] - h["w"], s["below"] + h["upto"]
            if h["w"] <= tolerance * per_leaf or s["step"] == 1:
                left_is_nearer = s["goal"] - before <= after - s["goal"]
                cuts[r["_ls_node"]] = s["lo"] + (h["bin"] + (not left_is_nearer)) * s["step"]
            else:
                s |= {"lo": s["lo"] + h["bin"] * s["step"], "below": before, "step": -(-s["step"] // BINS)}
    return [(n, state[n]["dim"], cuts[n]) for n in state]


def kd_shards(rows: DataFrame, weight: str, dims: dict[str, Column], tie: Column, n_shards: int | None = None, target_bytes: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """rows with shard (int, from 0): leaves of near equal weight in a k-d tree over dims.

    Give the number of shards, or target_bytes for a leaf. dims are numeric columns, null as 0;
    tie is a long that differs between most rows and separates rows that agree in a dimension. Rows alike in
    dims and tie are told apart by where they were read, so that many equal rows spread over shards too. An empty
    table gives no rows; null weights count as 0.
    """
    spark = rows.sparkSession
    names = list(dims)
    kept = rows.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_ls_v{i}") for i, c in enumerate(dims.values())], F.monotonically_increasing_id().alias("_ls_row"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("_ls_w"))
    apart = F.shiftrightunsigned(tie, 64 - TIE + TWIN) * F.lit(1 << TWIN) + F.shiftrightunsigned(F.xxhash64("_ls_row"), 64 - TWIN)
    kept = kept.withColumn("_ls_tie", apart).drop("_ls_row")
    kept = stored(kept, "kd-rows")
    ends = kept.agg(F.sum("_ls_w").alias("w"), *[f(f"_ls_v{i}").alias(f"{n}{i}") for i in range(len(names)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = ends["w"] or 0
    n_shards = n_shards or max(1, math.ceil(total / target_bytes))
    cur = kept
    for i in range(len(names)):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        scale = ((1 << GRID) - 1) / (hi - lo) if hi > lo and math.isfinite(hi - lo) else 0.0
        cur = cur.withColumn(f"_ls_d{i}", F.floor((F.col(f"_ls_v{i}") - lo) * scale) if scale else F.lit(0).cast("long"))
    cur = cur.withColumn("_ls_node", F.lit(0))
    leaves, first_shard = {0: n_shards}, {0: 0}
    level = 0
    while total and any(k > 1 for k in leaves.values()):
        open_nodes = {n: k for n, k in leaves.items() if k > 1}
        cuts = _splits(cur, names, open_nodes, total / n_shards, tolerance)
        fresh, rows_of = max(leaves) + 1, []
        for n, dim, cut in cuts:
            k = leaves.pop(n)
            a, b = fresh, fresh + 1
            fresh += 2
            leaves |= {a: k // 2, b: k - k // 2}
            first_shard |= {a: first_shard[n], b: first_shard[n] + k // 2}
            rows_of.append((n, dim, cut, a, b))
        for n in [n for n in open_nodes if n in leaves]:  # no row is left in it
            leaves[n] = 1
        table = F.broadcast(small_table(spark, rows_of, "_ls_node int, dim int, cut long, a int, b int"))  # one row for each node
        key = F.element_at(F.array(*[F.col(f"_ls_d{i}") for i in range(len(names))]), F.col("dim") + 1) * F.lit(1 << TIE) + F.col("_ls_tie")
        cur = cur.join(table, "_ls_node", "left").withColumn("_ls_node", F.when(F.col("cut").isNull(), F.col("_ls_node")).when(key < F.col("cut"), F.col("a")).otherwise(F.col("b"))).drop("dim", "cut", "a", "b")
        level += 1
        if level % STORE_LEVELS == 0 and any(k > 1 for k in leaves.values()):
            cur = stored(cur, "kd-nodes")
    table = F.broadcast(small_table(spark, [(n, first_shard[n]) for n in leaves], "_ls_node int, shard int"))
    return cur.join(table, "_ls_node").select(*rows.columns, "shard")


def with_slots(rows: DataFrame, group: str, order: Column, rows_per_bucket: int = 100_000) -> DataFrame:
    """rows with slot (long): gapless from 0 in each group, without sorting a whole group in one task.

    Rows are dealt by `order`, a hash, into buckets; a bucket's slots begin after the rows of those before. A row's
    place in its input goes into the bucket as well, so that equal rows don't meet in one.
    """
    n = max(8, math.ceil(rows.count() / rows_per_bucket))
    dealt = rows.withColumn("_ls_order", order).withColumn("_ls_bucket", F.pmod(F.xxhash64("_ls_order", F.monotonically_increasing_id()), F.lit(n)))
    dealt = stored(dealt, "slots")
    before = F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("_ls_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = dealt.groupBy(group, "_ls_bucket").count().withColumn("_ls_base", before).drop("count")
    rank = F.row_number().over(Window.partitionBy(group, "_ls_bucket").orderBy("_ls_order"))
    out = dealt.withColumn("_ls_rank", rank).join(base, [group, "_ls_bucket"])
    return out.select(*rows.columns, (F.col("_ls_base") + F.col("_ls_rank") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32, shard and slot of each document.

    Dimensions: log of the size, source, lang, doc_id; a missing column is left out. A null text has
    size 1 and the CRC of an empty one. Equal texts, and rows that are equal altogether, may go to different shards.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    dims = {"size": F.log2("size")} | {c: prefix_number(F.col(c).cast("string")) for c in ("source", "lang") if c in docs.columns} | {"doc_id": F.col("doc_id")}
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), *[c for c in ("source", "lang") if c in docs.columns])
    tie = F.xxhash64("doc_id", "text_crc32", "size")
    out = kd_shards(rows, "size", dims, tie, n_shards=n_shards)
    return with_slots(out.select("doc_id", "size", "text_crc32", "shard"), "shard", F.xxhash64("doc_id", "text_crc32"))


def op1_kd_shards(spark, sf_dir: str) -> DataFrame:
    """The law is `bytes`: the 16 shards hold nearly the same number of bytes. Nulls and repeated rows as in shard_documents()."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
