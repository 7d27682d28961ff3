import zlib
from collections import defaultdict

from llm.fixtures import clashing, docs, hard

from lodestone.llm import sharding


def _check(rows, source, n_shards=16):
    by_id = sorted(((r["doc_id"], r["text"] or "") for r in source.collect()), key=str)
    assert sorted(((r.doc_id, r.text_crc32, r["size"]) for r in rows), key=str) == sorted(((i, zlib.crc32(t.encode()), len(t.encode()) + 1) for i, t in by_id), key=str)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < n_shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_deals_equal_bytes(spark):
    rows = sharding.op1_kd_shards(spark, "/root/testdata/sf0.01").collect()
    _check(rows, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    most = max(r["size"] for r in rows)
    assert len(held) == 16 and max(held.values()) - min(held.values()) <= 2 * most


def test_nulls_ties_long_texts(spark):
    df = hard(spark)
    _check(sharding.shard_documents(df).collect(), df)
    _check(sharding.shard_documents(clashing(df)).collect(), df)


def test_one_source_and_repeated_rows(spark):
    df = docs(spark, [(7, "the same row")] * 50 + [(i, f"text {i}") for i in range(50)])
    _check(sharding.shard_documents(df, 4).collect(), df, 4)


def _even(rows, n_shards):
    """The law `bytes`: no shard holds more than its part and one row, give or take a thousandth."""
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += r["size"]
    part = sum(held.values()) / n_shards
    most = max(r["size"] for r in rows)
    assert len(held) == n_shards
    assert all(abs(h - part) <= 2 * most + 0.005 * part for h in held.values()), dict(held)


def test_bytes_of_equal_rows(spark):
    """2,000 equal rows, one source, null ids: equal rows spread over the shards as others do."""
    for first in ((7, "the same row " * 20), (None, "the same row " * 20), (None, None)):
        df = docs(spark, [first] * 2000 + [(i, f"text {i} " * (i % 5)) for i in range(400)])
        rows = sharding.shard_documents(df).collect()
        _check(rows, df)
        _even(rows, 16)


def test_many_shards(spark):
    """More levels than STORE_LEVELS."""
    df = docs(spark, [f"{i} " + "x" * (i * 7 % 90) for i in range(3000)])
    rows = sharding.shard_documents(df, 48).collect()
    _check(rows, df, 48)
    _even(rows, 48)


def test_empty_table(spark):
    assert sharding.shard_documents(docs(spark, [])).collect() == []


def test_target_bytes(spark):
    from pyspark.sql import functions as F

    df = docs(spark, [f"{i} " + "x" * (i * 7 % 90) for i in range(400)]).withColumn("w", F.length("text"))
    out = sharding.kd_shards(df, "w", {"w": F.col("w"), "doc_id": F.col("doc_id")}, F.xxhash64("doc_id"), target_bytes=2000)
    held = [r["w"] for r in out.groupBy("shard").agg(F.sum("w").alias("w")).collect()]
    assert max(held) <= 2000 * 1.1 and len(held) >= sum(held) / 2000
