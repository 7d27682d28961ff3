"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees.

A link of `radius` differing bits leaves one of radius + 1 blocks of a fingerprint unchanged, so a shard holds the
fingerprints that share a block. Its BK-tree keys children by their Hamming distance to the parent, and a search
follows only edges within the radius of its own distance. A shard that outgrows a task is cut; the trees of its parts
are broadcast, in waves of a bounded size, to its other parts. Of what a task finds, a spanning forest leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, lookup, slices, stored

SHINGLE, SEED, BITS = 3, 42, 64
#: Bytes of a text that are split into words at once.
PIECE = 1 << 22
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int32) * 256


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes) -> int:
    """A bit is 1 if more than half of the text's shingles have it in their hash; a text without words has 0."""
    counts, n, tail, digest = np.zeros((8, 256), np.int64), 0, [], xxhash.xxh64_digest
    for words in _pieces(text):
        words = tail + words
        if len(words) >= SHINGLE:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            found = b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=False)])
            lanes = np.frombuffer(found, np.uint8).reshape(-1, 8) + _LANES
            counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
            n += len(lanes)
            tail = words[1 - SHINGLE :]
        else:
            tail = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits((2 * (counts @ _BITS_OF) > n).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed long) of docs (doc_id, text)."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint((t or b"").translate(lower)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, fp long")


class Forest:
    """A BK-tree for each group of values; its first value is the root, and a node has one child for each distance."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        _, roots, which = np.unique(group, return_index=True, return_inverse=True)
        at = roots[which]  # the node that an element has come to
        left = np.setdiff1d(np.arange(len(values)), roots)
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            edge = at[left] * (BITS + 1) + np.bitwise_count(values[left] ^ values[at[left]])
            keys, first, which = np.unique(edge, return_index=True, return_inverse=True)
            child = left[first]
            edges.append(keys)
            children.append(child)
            at[left] = child[which]
            left = np.delete(left, first)
        edges, children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in queries, nodes) within the radius, for some queries at a time; roots: the node where each query begins."""
        for begin in range(0, len(queries), at_once):
            q = np.arange(begin, min(begin + at_once, len(queries)))
            node, found = roots[q], []
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                found.append((q[near], node[near]))
                low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
                n = high - low
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, node = np.repeat(q, n), self.children[np.repeat(low, n) + within]
            yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.values.tobytes(), self.edges.tobytes(), self.children.tobytes()

    @classmethod
    def unpacked(cls, values: bytes, edges: bytes, children: bytes) -> Forest:
        out = cls.__new__(cls)
        out.values, out.edges, out.children = np.frombuffer(values, np.uint64), np.frombuffer(edges, np.int64), np.frombuffer(children, np.int64)
        return out


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, where those of a and b have become the lesser of the two."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _forest_links(values: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[label[moved]].view(np.int64))], ["a", "b"])


def _within_shards(rows: DataFrame, radius: int, at_once: int = 1 << 15) -> DataFrame:
    """a, b: links that span what is near within each shard of rows (key, shard, fp)."""

    def links(values: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        _, which, size = np.unique(group, return_inverse=True, return_counts=True)
        some = size[which] > 1
        values, group = values[some], group[some]
        forest, label = Forest(values, group), np.arange(len(values))
        _, first, which = np.unique(group, return_index=True, return_inverse=True)
        for q, node in forest.search(values, first[which], radius):
            label = _merged(label, q, node)
        return _forest_links(values, label)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shards, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys, shards = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([shards, batch.column(1).to_numpy()])
            values = np.concatenate([values, batch.column(2).to_numpy().view(np.uint64)])
            if len(keys) >= at_once:
                group = np.cumsum(np.concatenate([[True], (keys[1:] != keys[:-1]) | (shards[1:] != shards[:-1])]))
                whole = int(np.searchsorted(group, group[-1]))  # the last shard may go on
                if whole:
                    yield links(values[:whole], group[:whole])
                    keys, shards, values = keys[whole:], shards[whole:], values[whole:]
        if len(keys):
            yield links(values, np.cumsum(np.concatenate([[True], (keys[1:] != keys[:-1]) | (shards[1:] != shards[:-1])])))

    dealt = rows.repartition("key", "shard").sortWithinPartitions("key", "shard")
    return dealt.select("key", "shard", "fp").mapInArrow(find, "a long, b long")


def _across_shards(rows: DataFrame, members: int, radius: int, wave_bytes: int) -> DataFrame:
    """The same between the shards of each key of rows; `members` of them."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [Forest(v := np.array(x, np.int64).view(np.uint64), np.zeros(len(v), np.int64)).packed() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.binary()) for c in zip(*trees, strict=True)]], ["key", "shard", "nodes", "edges", "children"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, *tree in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                queries, forest = np.frombuffer(own, np.uint64), Forest.unpacked(*tree)
                values, label = np.concatenate([queries, forest.values]), np.arange(len(queries) + len(forest.values))
                for q, node in forest.search(queries, np.zeros(len(queries), np.int64), radius):
                    label = _merged(label, q, node + len(queries))
                yield _forest_links(values, label)

    # a shard's size is bounded by the cut, so its list is too
    shards = rows.groupBy("key", "shard").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    trees = stored(shards.mapInArrow(plant, "key long, shard long, nodes binary, edges binary, children binary"), "bk-trees")
    waves = max(1, -(-members * 24 // wave_bytes))
    others = trees.select("key", F.col("shard").alias("own_shard"), F.col("nodes").alias("own"))
    out = None
    for w in range(waves):
        wave = trees.where(F.pmod(F.xxhash64("key", "shard"), F.lit(waves)) == w)
        met = others.join(F.broadcast(wave), "key").where("own_shard < shard").select("own", "nodes", "edges", "children")
        part = met.repartition(F.xxhash64("own", "nodes")).mapInArrow(search, "a long, b long")
        out = part if out is None else out.unionByName(part)
    return out


def fingerprint_links(unique: DataFrame, radius: int = 2, most: int = 1 << 15, wave_bytes: int = 32 << 20) -> DataFrame:
    """a, b: links whose components are those of all pairs of unique (fp) that differ in `radius` bits at most.

    A shard with more than `most` fingerprints is cut into parts of about that many.
    """
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    keys = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) * (radius + 1) + i for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = unique.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = stored(rows.groupBy("key").count().where(F.col("count") > most), "large-shards")
    members = large.agg(F.sum("count")).first()[0] or 0
    if not members:
        return _within_shards(rows.withColumn("shard", F.lit(0).cast("long")), radius)
    parts = F.ceil(F.col("count") / F.lit(most))
    cut = stored(rows.join(large, "key", "left").select("key", "fp", "count", F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), parts)).cast("long").alias("shard")), "shards")
    return _within_shards(cut, radius).unionByName(_across_shards(cut.where("count IS NOT NULL"), members, radius, wave_bytes))


def simhash_components(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 15, wave_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    A text's shingles are the runs of 3 of its words, A-Z as a-z, repeats included; a text of fewer words is one shingle,
    and one without words (null, empty, white space) has fingerprint zero. Rows whose fingerprints differ in `radius`
    bits at most are linked; component_id is the smallest id reachable. A row without an id is a document too; its
    component_id is that of the others reached, null if none of them has an id. Repeated rows are rows each.
    """
    rows = stored(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints")
    total = rows.count()
    unique = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "unique-fingerprints")
    linked = components(fingerprint_links(unique.select("fp"), radius, most, wave_bytes)).withColumnRenamed("v", "fp")
    own = unique.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = own.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    named = stored(lookup(own, roots, "root", "nodes", total).where("copies > 1 OR nodes > 1").select("fp", "copies", "component_id"), "components")
    out = lookup(rows, named, "fp", "copies", total)
    alone = F.col("copies").isNull()
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of `documents`, links at 2 differing bits or fewer; nulls, repeated rows and short texts as in simhash_components()."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
