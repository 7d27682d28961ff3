"""Mixing sources to target weights: temperature mixing.

A source's weight is its share of tokens to the power of an exponent from 0 (all alike) to 1 (as they come).
The exponent is bisected on a grid of 4096 steps to meet a target entropy or a repetition limit. Each source
then gives its part of the budget: whole permutations of its documents, and the beginning of one more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import lookup, stored

STEPS = 12  # halvings of the exponent's range
WORD = r"[^\x20\x09-\x0D]+"


def token_size(text: Column) -> Column:
    """Words and one end mark, so that no document is free."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def _exponent(sources: DataFrame, n: int, target_entropy: float | None, repetition_limit: float | None) -> float:
    """sources: share, for n sources. The largest exponent whose entropy is target_entropy * log(n) at least, or
    the smallest for which the least source is repeated repetition_limit times at most as often as the greatest.

    Each pass tries 63 exponents: six halvings of what is still open.
    """
    lo, step = 0, 1 << STEPS  # lo is the last grid point known to be on the low side
    while step > 1:
        step //= 64
        tried = [(lo + i * step) / (1 << STEPS) for i in range(1, 65)]
        power = F.pow("share", "alpha")
        by = sources.withColumn("alpha", F.explode(F.array(*map(F.lit, tried)))).groupBy("alpha").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max("share").alias("most"), F.min("share").alias("least"))
        value = {r["alpha"]: r for r in by.collect()}  # 64 rows
        if target_entropy is not None:
            fine = [math.log(value[a]["z"]) - a * value[a]["l"] / value[a]["z"] >= target_entropy * math.log(n) for a in tried]
        else:
            fine = [(value[a]["most"] / value[a]["least"]) ** (1 - a) > repetition_limit for a in tried]
        lo += step * next((i for i, ok in enumerate(fine) if not ok), 64)
        if lo >= 1 << STEPS:
            return 1.0
    if target_entropy is None and (lo or not _within(sources, 0.0, repetition_limit)):
        lo += 1
    return min(lo, 1 << STEPS) / (1 << STEPS)


def _within(sources: DataFrame, alpha: float, limit: float) -> bool:
    r = sources.agg(F.max("share"), F.min("share")).first()
    return (r[0] / r[1]) ** (1 - alpha) <= limit


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", target_entropy: float | None = None, repetition_limit: float | None = None, seed: int = 0) -> DataFrame:
    """docs' rows in the mix, each as often as it is in it, with mix_tokens, mix_exponent, mix_epoch (from 0) and mix_key.

    Give target_entropy, a share of the greatest possible, and the budget is the tokens there are; or
    repetition_limit, and the budget is the least for which every document is there once. Ordered by (mix_epoch,
    mix_key), a source's rows are permutations of it, the last one cut where the next document would go over its
    part of the budget. A null source counts as an empty one; rows that repeat an id are in or out together,
    and those with a null id are, too: their key is the hash of seed and epoch alone.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give target_entropy or repetition_limit")
    source = F.coalesce(F.col(source_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), source.alias("s"), token_size(F.col(text_col)).alias("size")), "mix-rows")
    sums = stored(rows.groupBy("s").agg(F.sum("size").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    total, n, docs_in_all = sums.agg(F.sum("tokens"), F.count("*"), F.sum("docs")).first()
    key = lambda i, epoch: F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), i.cast("string")))
    if total:
        shares = sums.withColumn("share", F.col("tokens") / F.lit(float(total)))
        alpha = _exponent(shares, n, target_entropy, repetition_limit)
        ends = shares.agg(F.sum(F.pow("share", F.lit(alpha))).alias("z"), F.max("share").alias("most")).first()
        scale = total / ends["z"] if target_entropy is not None else total * ends["most"] ** (1 - alpha)
        plan = shares.withColumn("quota", F.floor(F.pow("share", F.lit(alpha)) * scale + 0.5)).withColumn("full", F.expr("quota DIV tokens")).withColumn("more", F.expr("quota % tokens"))
    else:
        alpha, plan = 1.0, sums.withColumns({"full": F.lit(0).cast("long"), "more": F.lit(0).cast("long")})
    plan = stored(plan.select("s", "docs", "full", "more"), "mix-plan")

    # where the last permutation of a source is cut: sums of blocks of keys first, then within the block
    digits = max(1, math.ceil(math.log((docs_in_all or 1) / 50_000 + 1, 16)))
    last = lookup(rows, plan, "s", "docs", docs_in_all or 0).where("more > 0").withColumn("key", key(F.col("id"), F.col("full")))
    sized = stored(last.groupBy("s", "key", "more").agg(F.sum("size").alias("size")).withColumn("block", F.substring("key", 1, digits)), "mix-keys")
    upto = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy("s", "block").agg(F.sum("size").alias("size")).select("s", "block", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    inner = Window.partitionBy("s", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sized.join(blocks, ["s", "block"]).withColumn("after", F.col("before") + F.sum("size").over(inner)).where("after <= more").groupBy("s").agg(F.max("key").alias("cut"))
    plan = stored(plan.join(cut, "s", "left").select("s", "docs", "full", F.coalesce("cut", F.lit("")).alias("cut")), "mix-plan")

    named = docs.drop("mix_tokens", "mix_exponent", "mix_epoch", "mix_key")
    placed = lookup(named.withColumn("s", source) if "s" not in docs.columns else named.withColumnRenamed("s", "_ls_s").withColumn("s", source), plan.withColumnRenamed("docs", "_ls_docs").withColumnsRenamed({"full": "_ls_full", "cut": "_ls_cut"}), "s", "_ls_docs", docs_in_all or 0)
    part = key(F.col(id_col), F.col("_ls_full")) <= F.col("_ls_cut")
    epochs = F.when(F.col("_ls_full") + part.cast("int") > 0, F.sequence(F.lit(0).cast("long"), F.col("_ls_full") + part.cast("int") - 1)).otherwise(F.array().cast("array<bigint>"))
    out = placed.withColumn("mix_epoch", F.explode(epochs)).drop("s", "_ls_docs", "_ls_full", "_ls_cut")
    out = out.withColumnRenamed("_ls_s", "s") if "s" in docs.columns else out
    return out.select(*named.columns, token_size(F.col(text_col)).alias("mix_tokens"), F.lit(alpha).alias("mix_exponent"), "mix_epoch", key(F.col(id_col), F.col("mix_epoch")).alias("mix_key"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of `documents` with 0.999 of the greatest entropy, within as many tokens as there are."""
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), target_entropy=0.999)
    return mix.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_exponent").alias("exponent"), F.col("mix_epoch").alias("epoch"), F.col("mix_key").alias("order_key"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY s),
g AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM t),
h AS (SELECT s, tokens, total, n, CAST(tokens AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM t, g),
a AS (SELECT CAST(range AS DOUBLE) / CAST(4096 AS DOUBLE) AS alpha FROM range(0, 4097)),
z AS (SELECT alpha, max(n) AS n, sum(pow(share, alpha)) AS z, sum(pow(share, alpha) * ln(share)) AS l FROM h, a GROUP BY alpha),
b AS (SELECT max(alpha) AS alpha FROM z WHERE ln(z) - alpha * l / z >= CAST(0.999 AS DOUBLE) * ln(n)),
w AS (SELECT s, tokens, alpha, CAST(floor(pow(share, alpha) * (CAST(total AS DOUBLE) / (SELECT sum(pow(share, alpha)) FROM h, b)) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS quota FROM h, b),
p AS (SELECT s, alpha, quota // tokens AS full_n, quota % tokens AS more FROM w),
e AS (SELECT d.*, alpha, full_n, more, unnest(range(0, full_n + 1)) AS epoch FROM d JOIN p USING (s)),
k AS (SELECT *, md5('0|' || epoch || '|' || doc_id) AS order_key FROM e),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY s, epoch ORDER BY order_key) AS upto FROM k)
SELECT doc_id, source, n_tokens, alpha AS exponent, epoch, order_key FROM c WHERE epoch < full_n OR upto <= more
"""
