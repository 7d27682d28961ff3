"""Helpers that several operators share: shared tables, skew-safe lookups, byte-level word hashing."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.sources.tables import shared_dir, stored  # noqa: F401

def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table from one literal, which also holds many thousands of rows; unlike createDataFrame(), it starts no Python worker."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = ", ".join(":".join(c.split()) for c in schema.split(","))
    made = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{kinds}>>")
    return spark.range(1).select(F.inline(made))


#: lookup() broadcasts the keys that hold more than one row in HOT_SHARE; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1024


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], rows_of_key: str, total: int) -> DataFrame:
    """rows left joined with table (one row for each key) on key.

    rows_of_key is the column of table that says how many rows have the key. Keys with more than
    total / HOT_SHARE rows, fewer than HOT_SHARE keys, are broadcast; the others shuffle.
    """
    is_hot = F.col(rows_of_key) * HOT_SHARE > F.lit(total)
    hot, cold = table.where(is_hot), table.where(~is_hot)
    key = [key] if isinstance(key, str) else key
    more = [c for c in table.columns if c not in key]
    marked = rows.join(F.broadcast(hot.withColumn("_ls_hot", F.lit(True))), key, "left")
    return marked.where("_ls_hot").drop("_ls_hot").unionByName(marked.where("_ls_hot IS NULL").drop("_ls_hot", *more).join(cold, key, "left"))


def lower_ascii(text):
    """Column: null as empty, A-Z as a-z, every other character unchanged."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- words of whole texts as hashes, without a Python object for each word ---

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashed(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a buffer, and where they begin in it."""
    solid = ~_SPACE[buffer]
    edge = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    at = np.arange(len(buffer), dtype=np.int64)[solid]
    within = at - np.repeat(starts, lengths)
    parts = _BYTE[buffer[solid]] * powers(int(lengths.max()))[within]
    where = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return mixed(np.add.reduceat(parts, where) + lengths.astype(np.uint64)), starts


def word_hashes(texts: list[bytes], most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts, in order, and where each text's begin (one more entry than texts).

    A word is a longest run of bytes other than ASCII white space. Beyond `most` bytes the work goes piece by piece, cut
    at white space, so that of a very long text only its words' hashes are held at once.
    """
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    hashes, starts, begin = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while begin < len(buffer):
        end = begin + most
        while end < len(buffer):
            gap = np.flatnonzero(_SPACE[buffer[end : end + most]])
            if len(gap):
                end += int(gap[0])
                break
            end += most
        h, at = _hashed(buffer[begin:end])
        hashes.append(h)
        starts.append(at + begin)
        begin = end
    text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), text_starts)


def slices(batches, rows: int = 256):
    """Arrow batches of few rows, so that the Python objects made of one stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(texts: list[bytes], most: int = 1 << 21):
    """(first, last) index ranges of about `most` bytes each, so that numpy's temporaries stay small."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def components(links: DataFrame) -> DataFrame:
    """v, root: for each node of links (a, b) but the roots, the smallest node that it is connected with."""
    return graph.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("v"), F.col("label").alias("root"))
