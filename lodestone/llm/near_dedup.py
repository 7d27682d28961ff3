"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures.

A signature has SYMBOLS minhash values of 16 bits. Cut into CHUNKS chunks, two signatures that differ
in at most 2 * CHUNKS - 1 symbols have a chunk with at most one difference (pigeonhole); a chunk's
allowed errors are enumerated by leaving out each of its symbols in turn, which gives a document one key
for each symbol. So every pair within that distance shares a key, and most pairs beyond it do. Candidates are confirmed on full sets.

Groups are joined in two rounds, so that g near copies don't give g * g rows. First each document names the one
that most of its buckets begin with; those within the distance form clusters, and a cluster's full sets are
compared tile by tile, a tile pair giving as many rows as it has documents at most. Then, within a bucket, only
documents of different clusters and components are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, lookup, mixed, stored, text_slices, word_hashes

SYMBOLS, CHUNKS, SHINGLE = 64, 11, 5
#: One-bit minhashes of a candidate's full set, and how many deviations below the mean a link's agreement may lie.
BITS, DEVIATIONS = 1024, 5.5
MOST_ERRORS = 2 * CHUNKS - 1
BLOCK = 2048

_rng = np.random.default_rng(20250101)
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_PLACE = mixed(_rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64))
_CHUNK = np.repeat(np.arange(CHUNKS), [len(x) for x in np.array_split(np.arange(SYMBOLS), CHUNKS)])
_CHUNK_START = np.searchsorted(_CHUNK, np.arange(CHUNKS))
_BIT_A = _rng.integers(1, 2**31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BIT_B = _rng.integers(0, 2**31, BITS, dtype=np.uint32)
_WEIGHTS = mixed(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's distinct 5-word shingles, hashed to 64 bits and sorted; texts are bytes in which A-Z is lower case."""
    for a, b in text_slices(texts):
        words, first = word_hashes(texts[a:b])
        sums = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            sums += words[k : len(words) - SHINGLE + 1 + k] * _WEIGHTS[k] if len(sums) else np.uint64(0)
        sums = mixed(sums)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= SHINGLE:
                yield np.unique(sums[first[i] : first[i + 1] - SHINGLE + 1])
            elif n:
                yield mixed((words[first[i] : first[i + 1]] * _WEIGHTS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096][None, :] * _A[:, None] + _B[:, None]).min(1))
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def sketch(hashes: np.ndarray) -> bytes:
    """BITS one-bit minhashes: two sets of similarity J agree in a share of J + (1 - J) / 2 of them."""
    least = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        least = np.minimum(least, (short[at : at + 256][:, None] * _BIT_A + _BIT_B).min(0))
    return np.packbits(mixed(least.astype(np.uint64)) & np.uint64(1) != 0).tobytes()


def least_agreement(percent: int) -> int:
    """Fewer equal bits than this are DEVIATIONS below what a pair of this similarity has on average."""
    p = (1 + percent / 100) / 2
    return int(BITS * p - DEVIATIONS * np.sqrt(BITS * p * (1 - p)))


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) keys: in column k, the chunk of symbol k without it. The low 6 bits are k."""
    terms = mixed(signatures.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(16)))
    whole = np.add.reduceat(terms, _CHUNK_START, axis=1)[:, _CHUNK]
    keys = mixed(whole - terms + _PLACE)
    return ((keys & ~np.uint64(63)) | np.arange(SYMBOLS, dtype=np.uint64)).view(np.int64)


def _lowered(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, hi, lo (a hash of the set), sig."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, sigs = [], [], [], []
            for s in shingle_sets(_lowered(batch.column(1).to_pylist())):
                n.append(len(s))
                hi.append(mixed(s).sum(dtype=np.uint64))
                lo.append(mixed(s ^ _PLACE[0]).sum(dtype=np.uint64))
                sigs.append(signature(s).tobytes() if len(s) else None)
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), long(hi), long(lo), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "hi", "lo", "sig"])

    return docs.mapInArrow(profile, "doc_id long, n_shingles long, hi long, lo long, sig binary")


def _keys(sets: DataFrame) -> DataFrame:
    """key, id: SYMBOLS rows for each set."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS))
                for at in range(0, len(keys), 1024):
                    part = keys[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), pa.array(np.repeat(batch.column(0).to_numpy()[at : at + 1024], SYMBOLS))], ["key", "id"])

    return sets.select("id", "sig").mapInArrow(spread, "key long, id long")


def _whole_keys(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by that column, in batches that don't split the rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        at = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
        if at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tiles(members: DataFrame, group: str, weight, tile_rows: int) -> DataFrame:
    """members dealt into pairs of tiles of their group: pair, own, low, high beside their columns."""
    split = members.groupBy(group).agg(F.ceil(F.greatest(F.count("*") / tile_rows, F.sum(weight) / (tile_rows * 1024))).alias("tiles"))
    dealt = members.join(split, group).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.withColumn("pair", F.xxhash64(group, low, high)).withColumn("low", low).withColumn("high", high).drop("tiles", "other")


def _tile_components(ids: np.ndarray, across: np.ndarray | None, lengths: np.ndarray, values: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(least id, id) for each document that links join to another; across: tiles of which only documents of different ones are compared."""
    n = len(ids)
    row = np.repeat(np.arange(n), lengths)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    for at in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        there = np.zeros((n, 4096), np.float32)
        there[row[a:b], column[a:b] - at] = 1
        common += there @ there.T
    linked = 100 * common >= percent * (lengths[:, None] + lengths[None, :] - common)
    if across is not None:
        linked &= across[:, None] != across[None, :]
    np.fill_diagonal(linked, False)
    open_, out = linked.any(1), []
    while open_.any():
        part = np.zeros(n, bool)
        part[np.flatnonzero(open_)[0]] = True
        while (grown := part | linked[part].any(0)).sum() > part.sum():
            part = grown
        least = ids[part].min()
        out += [(int(least), int(i)) for i in ids[part] if i != least]
        open_ &= ~part
    return out


def _cluster_links(clusters: DataFrame, sets: DataFrame, percent: int, tile_rows: int = 256) -> DataFrame:
    """a, b: connections that the links within clusters (cluster, id) make, from full sets."""
    dealt = _tiles(clusters.join(sets, "id").withColumn("n", F.size("shingles")), "cluster", F.col("n"), tile_rows)
    dealt = dealt.select("pair", "cluster", "id", "own", "low", "high", "shingles")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, 0):
            pair, cluster, ids, own, low, high = (batch.column(c).to_numpy() for c in range(6))
            offsets, values = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (cluster[1:] != cluster[:-1]), [True]]))
            found = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 1:
                    found += _tile_components(ids[a:b], None if low[a] == high[a] else own[a:b], np.diff(offsets[a : b + 1]), values[offsets[a] : offsets[b]], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return dealt.repartition("pair").sortWithinPartitions("pair", "cluster").mapInArrow(link, "a long, b long").distinct()


def _within(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in MOST_ERRORS symbols at most."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x != y).sum(1) <= MOST_ERRORS))

    sig = sets.select("id", "sig")
    both = pairs.join(sig.withColumnsRenamed({"id": "b", "sig": "y"}), "b").join(sig.withColumnsRenamed({"id": "a", "sig": "x"}), "a")
    return both.select("a", "b", "x", "y").mapInArrow(near, "a long, b long")


def _near_pairs(members: DataFrame, percent: int, sketches: bool) -> DataFrame:
    """a, b: pairs that share a key, of sizes that allow the similarity, in different clusters and components, once each.

    members: key, id, cluster, comp, n, sig, bits. Buckets of more than BLOCK rows are compared in pairs of tiles.
    With sketches, pairs whose sketches agree in fewer bits than least_agreement() are left out.
    """
    dealt = _tiles(members, "key", F.lit(1), BLOCK).select("pair", "key", "id", "cluster", "comp", "n", "sig", "bits", "own", "low", "high")
    agree = least_agreement(percent) if sketches else 0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, 0):
            pair, key, ids, cluster, comp, n, own, low, high = (batch.column(c).to_numpy() for c in ("pair", "key", "id", "cluster", "comp", "n", "own", "low", "high"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
            slot = key & 63
            out_a, out_b = [], []
            for d in range(1, len(ids)):
                same = pair[d:] == pair[:-d]
                if not same.any():
                    break
                i = np.flatnonzero(same & (key[d:] == key[:-d]) & (comp[d:] != comp[:-d]) & (cluster[d:] != cluster[:-d]) & ((low[d:] == high[d:]) | (own[d:] != own[:-d])))
                j = i + d
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                ok = small * 100 >= large * percent
                i, j = i[ok], j[ok]
                for at in range(0, len(i), 8192):
                    x, y = i[at : at + 8192], j[at : at + 8192]
                    alike = BITS - np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) >= agree
                    x, y = x[alike], y[alike]
                    if not len(x):
                        continue
                    wrong = sig[x] != sig[y]
                    errors = np.add.reduceat(wrong, _CHUNK_START, axis=1, dtype=np.int16)
                    chunk = (errors <= 1).argmax(1)
                    start = _CHUNK_START[chunk]
                    masked = np.where(np.arange(SYMBOLS) >= start[:, None], wrong, False) & (_CHUNK[None, :] == chunk[:, None])
                    first = np.where(masked.any(1), masked.argmax(1), start)  # the pair's first shared key
                    ok = slot[x] == first
                    out_a.append(np.minimum(ids[x[ok]], ids[y[ok]]))
                    out_b.append(np.maximum(ids[x[ok]], ids[y[ok]]))
            if out_a and sum(map(len, out_a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return dealt.repartition("pair").sortWithinPartitions("pair", "key").mapInArrow(compare, "a long, b long").distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, shingles, bits (their sketch): wanted (id, doc_id, hi) read again from the texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hi = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [(i, s) for i, h, s in zip(ids, hi, shingle_sets(_lowered(batch.column(0).to_pylist())), strict=True) if int(mixed(s).sum(dtype=np.uint64).view(np.int64)) == h]
            if found:
                lengths = np.cumsum([0, *(len(s) for _, s in found)])
                values = pa.array(np.concatenate([s for _, s in found]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values), pa.array([sketch(s) for _, s in found], pa.binary())], ["id", "shingles", "bits"])

    return docs.join(wanted, "doc_id").select("text", "id", "hi").mapInArrow(read, "id long, shingles array<long>, bits binary").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs with 100 * intersection >= percent * union."""
    of_a = pairs.groupBy("a").agg(F.ceil(F.count("*") / 1024).alias("blocks"))
    right = pairs.join(of_a, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))).join(sets.withColumnRenamed("id", "b"), "b").select("a", "block", "b", "shingles")
    left = of_a.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(sets.withColumnRenamed("id", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "shingles")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            lists = batch.column(2)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = values[offsets[i] : offsets[i + 1]]
                if b is None:
                    current = own.copy()
                    continue
                both = np.sort(np.concatenate([current, own]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(current) + len(own) - common):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    rows = right.unionByName(left).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    return rows.select("a", "b", "shingles").mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", sketches: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Links join documents whose sets of 5-word shingles have 100 * intersection >= percent * union; percent is 80 or
    more. Equal sets are one node, so copies aren't compared. component_id is the smallest id of those reachable;
    a document without words, or with a null id, is alone. MinHash can miss a link only if the signatures share no key:
    at a similarity of 0.85 one pair in 26 million, at 0.80 one in 210,000. Of pairs of different clusters, the sketches
    drop one link in 10 million at most before full sets are compared; without sketches, every pair that shares a key is.
    Rows that repeat an id are one document, which goes as a whole.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(_profiles(docs), "profiles")
    total = rows.count()
    grouped = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    sets = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "sets")
    keys = _keys(sets)
    named = keys.groupBy("key").agg(F.min("id").alias("p"), F.count("*").alias("g")).where("g > 1").drop("g")
    members = stored(keys.join(named, "key"), "members")
    wanted = members.select("id").distinct().join(sets.select("id", F.col("rep").alias("doc_id"), "hi"), "id")
    stored_sets = stored(_full_sets(docs, wanted), "full-sets")
    full = stored_sets.drop("bits")
    votes = members.where("id <> p").groupBy("id", "p").count()
    star = votes.groupBy("id").agg(F.max(F.struct("count", (-F.col("p")).alias("p"))).alias("m")).select((-F.col("m.p")).alias("a"), F.col("id").alias("b"))
    star = components(_within(star, sets)).select(F.col("root").alias("cluster"), F.col("v").alias("id"))
    clusters = stored(star.unionByName(star.select("cluster", F.col("cluster").alias("id")).distinct()), "clusters")
    links = components(_cluster_links(clusters, full, percent))
    comp = members.select("key", "id").join(clusters, "id", "left").join(links.select(F.col("v").alias("id"), "root"), "id", "left")
    comp = stored(comp.select("key", "id", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("root", "id").alias("comp")), "members")
    open_keys = comp.groupBy("key").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y").select("key")
    still = comp.join(open_keys, "key", "left_semi").join(sets.select("id", F.col("n_shingles").alias("n"), "sig"), "id").join(stored_sets.select("id", "bits"), "id")
    pairs = stored(_near_pairs(still, percent, sketches), "pairs")
    later = _confirmed(pairs, full, percent)
    links = components(links.select(F.col("root").alias("a"), F.col("v").alias("b")).unionByName(later))

    ids = sets.select("id", "hi", "lo", "rep", "copies").join(links.select(F.col("v").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = ids.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("nodes"))
    named = stored(ids.join(least, "root").where("copies > 1 OR nodes > 1").select("hi", "lo", "copies", "component_id"), "components")
    out = lookup(rows.select("doc_id", "n_shingles", "hi", "lo"), named, ["hi", "lo"], "copies", total)
    alone = F.col("component_id").isNull() | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links at 85 percent. A null or empty text, or a null id, is alone; see near_duplicates()."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
