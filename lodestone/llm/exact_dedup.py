"""Exact dedup: two-pass Bloom filtering.

Pass one hashes every text into two filters that hold the cells hit more than once. Pass two tests
each row against both; only rows that may be repeated shuffle, the rest pass straight through.
The filters have no false negatives, so the result is exact; a full filter only makes more rows shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import lookup, lower_ascii, stored


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(lower_ascii(text), "UTF-8"), 256)


def _cell(sha: str, which: int, cells: int) -> Column:
    """From 1, as bitmap_bucket_number counts."""
    return F.pmod(F.xxhash64(F.col(sha), F.lit(which)), F.lit(cells)) + 1


def repeat_filters(hashes: DataFrame, sha: str, rows: int, cells_per_row: int = 8, max_cells: int = 1 << 29, n: int = 2, least: int = 2) -> tuple[list[DataFrame], int]:
    """n (1 or 2) Bloom filters of the hashes that occur `least` times or more, each as (bucket, bits) of 4 KB rows.

    A filter has at most max_cells bits (64 MB by default) whatever the input, so it may be broadcast.
    """
    cells = 1 << 15
    while cells < min(rows * cells_per_row, max_cells):
        cells *= 2
    out = []
    for which in range(n):
        hit = hashes.groupBy(_cell(sha, which, cells).alias("_ls_cell")).count().where(F.col("count") >= least)
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("_ls_cell")).alias(f"_ls_bits{which}")
        out.append(hit.groupBy(F.bitmap_bucket_number("_ls_cell").alias(f"_ls_bucket{which}")).agg(bits))
    return [stored(f, "repeat-filter") for f in out], cells


def maybe_repeated(rows: DataFrame, sha: str, filters: list[DataFrame], cells: int) -> DataFrame:
    """rows with _ls_maybe: false only for hashes that the filters were not made of."""
    test = F.lit(True)
    for which, f in enumerate(filters):
        rows = rows.withColumn("_ls_cell", _cell(sha, which, cells)).withColumn(f"_ls_bucket{which}", F.bitmap_bucket_number("_ls_cell")).withColumn(f"_ls_pos{which}", F.bitmap_bit_position("_ls_cell"))
        rows = rows.join(F.broadcast(f), f"_ls_bucket{which}", "left")
        byte = F.conv(F.hex(F.expr(f"substring(_ls_bits{which}, CAST(_ls_pos{which} DIV 8 + 1 AS INT), 1)")), 16, 10).cast("int")
        test = test & F.coalesce(F.getbit(byte, F.col(f"_ls_pos{which}") % 8) == 1, F.lit(False))
    rows = rows.withColumn("_ls_maybe", test)
    return rows.drop("_ls_cell", *[f"_ls_{x}{w}" for w in (0, 1) for x in ("bucket", "pos", "bits")])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", sha_col: str = "text_sha256") -> DataFrame:
    """docs, every row and column, with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts
    the row with the largest id stays (null is smallest); of rows that repeat id and text alike, one.
    With text_col None, docs already has sha_col. Columns of docs with the names of the results are replaced.
    """
    taken = {"keep_id", "group_size", "kept"} | ({sha_col} if text_col else set())
    docs = docs.drop(*[c for c in docs.columns if c in taken])
    rows = docs.withColumn(sha_col, text_sha256(F.col(text_col))) if text_col else docs
    narrow = stored(rows.select(F.col(id_col).alias("_ls_id"), sha_col), "text-hashes") if text_col else rows.select(F.col(id_col).alias("_ls_id"), sha_col)
    total = narrow.count()
    filters, cells = repeat_filters(narrow, sha_col, total)
    often = maybe_repeated(narrow, sha_col, filters, cells).where("_ls_maybe").groupBy(sha_col, "_ls_id").agg(F.count("*").alias("_ls_n"))
    top = F.max(F.struct(F.col("_ls_id").isNotNull().alias("_ls_some"), "_ls_id", "_ls_n"))
    groups = often.groupBy(sha_col).agg(top.alias("_ls_top"), F.sum("_ls_n").alias("group_size")).where("group_size > 1")
    groups = stored(groups.select(sha_col, "group_size", F.col("_ls_top._ls_id").alias("keep_id"), F.col("_ls_top._ls_n").alias("_ls_n_top")), "repeat-groups")

    tested = maybe_repeated(rows, sha_col, filters, cells)
    single = tested.where(~F.col("_ls_maybe")).drop("_ls_maybe").withColumns({"group_size": F.lit(1).cast("long"), "keep_id": F.col(id_col), "kept": F.lit(True)})
    found = lookup(tested.where("_ls_maybe").drop("_ls_maybe"), groups, sha_col, "group_size", total)
    alone = F.col("group_size").isNull()
    found = found.withColumns({"keep_id": F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")), "_ls_n_top": F.coalesce("_ls_n_top", F.lit(1)), "group_size": F.coalesce("group_size", F.lit(1))})
    found = found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    tied = F.col("kept") & (F.col("_ls_n_top") > 1)
    # the same id and text more than once: a first row of each partition, then of those
    twins = found.where(tied).withColumn("_ls_part", F.spark_partition_id())
    twins = twins.withColumn("_ls_1", F.row_number().over(Window.partitionBy(sha_col, "_ls_part").orderBy("_ls_part")))
    first = twins.where("_ls_1 = 1").withColumn("kept", F.row_number().over(Window.partitionBy(sha_col).orderBy("_ls_part")) == 1)
    later = twins.where("_ls_1 > 1").withColumn("kept", F.lit(False))
    parts = [found.where(~tied), first.drop("_ls_part", "_ls_1"), later.drop("_ls_part", "_ls_1")]
    out = single
    for p in parts:
        out = out.unionByName(p.drop("_ls_n_top"))
    return out.select(*docs.columns, "keep_id", "group_size", "kept", *([sha_col] if text_col else []))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """A-Z as a-z; a null text counts as empty. Ties and repeated rows as in exact_dedup()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = stored(docs.select("doc_id", text_sha256(F.col("text")).alias("text_sha256")), "text-hashes")
    return exact_dedup(narrow, text_col=None).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
