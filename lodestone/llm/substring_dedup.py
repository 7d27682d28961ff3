"""Suffix-array dedup: removes every byte that a repeated string of LENGTH bytes covers.

Each string of LENGTH bytes holds an anchor, a place whose k-gram has the least hash of some window of
that length; equal strings have equal anchors, so both occurrences of a repeated string are found among
the places that share an anchor's k-gram. Such places are grouped by the k-gram. Places with the same
bytes around them stand for each other; for the rest, suffix arrays of the texts right and left of the
anchors (deep-shallow sorting) tell which strings around an anchor occur again.

The words of a text, as hashes of WORD bytes each, are a second string of bytes, in which strings of WORDS
words are sought in the same passes. The low bit of a k-gram's hash tells the kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import _BYTE, lookup, mixed, powers, slices, stored, text_slices, word_hashes
from lodestone.llm.exact_dedup import maybe_repeated, repeat_filters
from lodestone.llm.suffix_sort import deep_shallow_sort, matrix

GRAM = 64
#: Words of a repeated passage, bytes of a word's hash, and words of a k-gram.
WORDS, WORD, WORD_GRAM = 50, 5, 8
PIECE = 1 << 19
_TOP = np.iinfo(np.uint64).max


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w; len(x) - w + 1 values."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, _TOP, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _least(h: np.ndarray, ends: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places whose gram's hash h is the least in some window of `length` units, ties included; a window ends by its first unit's ends."""
    w = length - gram + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _sliding_min(h, w)
    at = np.arange(len(h))
    least[at[: len(least)] + length > ends[: len(least)]] = 0
    edge = np.full(w - 1, _TOP, np.uint64)
    most = ~_sliding_min(np.concatenate([edge, ~least, edge]), w)  # the greatest minimum of the windows that hold a place
    return np.flatnonzero((most == h) & (at + gram <= ends[: len(h)]))


class Rolling:
    """Hashes of the strings of `width` bytes at any place of a buffer."""

    def __init__(self, table: np.ndarray, base: int):
        self.table, self.kept = table, [powers(1, np.uint64(b)) for b in (base, pow(base, -1, 1 << 64))]
        self.bases = [np.uint64(b) for b in (base, pow(base, -1, 1 << 64))]

    def _powers(self, n: int, which: int) -> np.ndarray:
        """The first n powers; those of one piece are kept."""
        if n > 3 * PIECE:
            return powers(n, self.bases[which])
        if len(self.kept[which]) < n:
            self.kept[which] = powers(max(n, 2 * len(self.kept[which])), self.bases[which])
        return self.kept[which][:n]

    def __call__(self, x: np.ndarray, width: int) -> np.ndarray:
        if len(x) < width:
            return np.zeros(0, np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.table[x] * self._powers(len(x), 0))])
        return mixed((sums[width:] - sums[:-width]) * self._powers(len(x) - width + 1, 1))


_rng = np.random.default_rng(77)
ROLL = [Rolling(_BYTE, 0x9E3779B97F4A7C15), *[Rolling(_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), int(_rng.integers(1, 2**62)) * 4 + 1) for _ in range(2)]]


def _by_text(places: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places in a buffer as places in its texts, which begin at `first`, with the hashes of their k-grams."""
    at = np.searchsorted(places, first)
    return [(places[at[i] : at[i + 1]] - first[i], hashes[at[i] : at[i + 1]]) for i in range(len(first) - 1)]


def anchors(texts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the places whose k-gram has the least hash in some window of `length` bytes, ties included, and those hashes."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in text_slices(texts, PIECE):
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])]).astype(np.int64)
        x = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        ends = np.repeat(first[1:], np.diff(first))
        found, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at in range(0, max(len(x) - length + 1, 0), 2 * PIECE):  # a slice is longer than two pieces only if a text is
            part = slice(at, at + 2 * PIECE + length - 1)
            h = ROLL[0](x[part], GRAM)
            places = _least(h, ends[part] - at, length, GRAM)
            found.append(places + at)
            grams.append(h[places])
        places, once = np.unique(np.concatenate(found), return_index=True)
        out += _by_text(places, np.concatenate(grams)[once], first)
    return out


def word_anchors(words: np.ndarray, first: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for texts that are hashes of words, windows of `length` words; places count words."""
    gram = WORD_GRAM
    sums = np.zeros(max(len(words) - gram + 1, 0), np.uint64)
    for k in range(gram if len(sums) else 0):
        sums += words[k : len(words) - gram + 1 + k] * _BYTE[k]
    h = mixed(sums)
    places = _least(h, np.repeat(first[1:], np.diff(first)), length, gram)
    return _by_text(places, h[places], first)


def _hash(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def _content(raw: bytes) -> tuple[int, int]:
    return _hash(raw, 1), _hash(raw, 2)


def _raw(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def _coded(words: np.ndarray) -> bytes:
    """WORD bytes of each word's hash."""
    return words.view(np.uint8).reshape(-1, 8)[:, :WORD].tobytes()


def _kinds(length: int, words: int) -> dict[int, tuple[int, int, int]]:
    """By kind, bytes of a string that is sought, of its k-gram, and from one place to the next."""
    return {0: (length, GRAM, 1), 1: (words * WORD, WORD_GRAM * WORD, WORD)}


def _scan(docs: DataFrame, length: int, words_of: int) -> DataFrame:
    """doc_id, c1, c2 (a hash of the text), n_bytes, n_words, sha, and the anchors' places, k-grams and surroundings as arrays."""
    of_kind = _kinds(length, words_of)
    xxh, half, one = xxhash.xxh3_64_intdigest, 1 << 63, np.uint64(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = _raw(batch.column(1).to_pylist())
            cols: list[list] = [[] for _ in range(8)]
            by_words: list[tuple[bytes, np.ndarray]] = []
            for a, b in text_slices(raws):
                words, first = word_hashes(raws[a:b])
                by_words += [(_coded(words[first[i] : first[i + 1]]), (p * WORD, h)) for i, (p, h) in enumerate(word_anchors(words, first, words_of))]
            for raw, of_bytes, (coded, of_words) in zip(raws, anchors(raws, length), by_words, strict=True):
                ctx = []
                for kind, text, (at, _) in ((0, raw, of_bytes), (1, coded, of_words)):
                    size, gram, _ = of_kind[kind]
                    before = size - gram
                    ctx += [xxh(text[p - before if p > before else 0 : p + size], p if p < before else before) - half for p in at.tolist()]
                pos = np.concatenate([of_bytes[0], of_words[0]])
                kg = np.concatenate([of_bytes[1] | one, of_words[1] & ~one]).view(np.int64) ^ 1
                for c, v in zip(cols, (*_content(raw), len(raw), len(coded) // WORD, hashlib.sha256(raw).hexdigest(), pos, kg, ctx), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "c1", "c2", "n_bytes", "n_words", "sha", "pos", "kg", "ctx"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, c1 long, c2 long, n_bytes long, n_words long, sha string, pos array<long>, kg array<long>, ctx array<long>")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """stored(); shuffles hold several times the tables that they make, so they go once a table is written."""
    return stored(df, name, release=True)


def _twice(cells_hit: DataFrame, cells: int):
    """A broadcast bitmap of the cells (column cell) that are hit more than once: a bit for each of at most 2^29 cells, 64 MB."""
    twice = cells_hit.groupBy("cell").count().where("count > 1").select((F.col("cell") + 1).alias("cell"))
    bits = twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    return cells_hit.sparkSession.sparkContext.broadcast(_bits(_kept(bits, "cells").toArrow(), cells))


def _n_cells(n: int) -> int:
    cells = 1 << 15
    while cells < min(8 * n, 1 << 29):
        cells *= 2
    return cells


def _hit(cell: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)


def _places(batches: Iterator[pa.RecordBatch], twice) -> Iterator[pa.RecordBatch]:
    """One row for each place of the arrays of _scan() whose k-gram's cell is hit more than once."""
    bits = twice.value
    for batch in slices(batches, 1024):
        of = {c: batch.column(c) for c in batch.schema.names}
        pos, kg, ctx = (of[c].flatten().to_numpy() for c in ("pos", "kg", "ctx"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(of["pos"].offsets.to_numpy()))
        hit = _hit(kg >> 1 & 8 * len(bits) - 1, bits)
        kg, row = kg[hit], row[hit]
        kind = (kg & 1).astype(np.int32)
        n = np.where(kind == 0, of["n_bytes"].to_numpy()[row], of["n_words"].to_numpy()[row] * WORD)
        cols = (kg, ctx[hit], kind, of["c1"].to_numpy()[row], of["c2"].to_numpy()[row], pos[hit], n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kg", "ctx", "kind", "c1", "c2", "pos", "n"])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (c1, c2, rep and more) with the text of rep's row of docs. A Bloom filter of rep keeps other texts from the shuffle."""
    wanted = _kept(wanted, "wanted")
    filters, cells = repeat_filters(wanted.select("rep"), "rep", wanted.count(), cells_per_row=16, n=1, least=1)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [_content(r) for r in _raw(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["rep", "text", "c1", "c2"])

    asked = maybe_repeated(docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rep"), "text"), "rep", filters, cells).where("_ls_maybe")
    rows = asked.select("rep", "text").mapInArrow(named, "rep long, text string, c1 long, c2 long")
    return rows.join(wanted, ["c1", "c2", "rep"])


def _best_lcp(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest prefix that each string has in common with any other: that with a neighbour in the sorted order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(lcp, np.concatenate([[0], lcp[:-1]]))
    return out


def _ranges(rights: list[bytes], lefts: list[bytes], length: int, before: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the least and greatest number of bytes left of it, a multiple of step, with which a string of `length` bytes occurs again (-1: none)."""
    n = len(rights)
    low, high = np.full(n, -1), np.full(n, -1)
    right_table, right_n = matrix(rights, length)
    left_table, left_n = matrix(lefts, before)
    right_order, right_lcp = deep_shallow_sort(rights, right_table, right_n)
    left_order, left_lcp = deep_shallow_sort(lefts, left_table, left_n)
    # a string can begin between these only
    least, most = length - _best_lcp(right_order, right_lcp), _best_lcp(left_order, left_lcp)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(0, before + 1, step):
        there = np.flatnonzero((least <= o) & (o <= most))
        if len(there) < 2:
            continue
        right_class[right_order] = np.concatenate([[0], np.cumsum(right_lcp[:-1] < length - o)])
        left_class[left_order] = np.concatenate([[0], np.cumsum(left_lcp[:-1] < o)])
        both = right_class[there] * n + left_class[there]
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        again = there[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        high[again] = o
        low[again[low[again] < 0]] = o
    return low, high


def _strings(batch: pa.RecordBatch, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, first byte in the row's text, and two hashes of the strings of `length` bytes, a multiple of step apart, that hold a row's k-gram."""
    texts = [left[::-1] + right for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
    n_left = np.array([len(x) for x in batch.column("left").to_pylist()], np.int64)
    n = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(n) - n
    many = np.maximum(np.minimum(n_left, n - length) // step + 1, 0)
    row = np.repeat(np.arange(len(n)), many)
    within = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * step
    x = np.frombuffer(b"".join(texts), np.uint8)
    h1, h2 = (r(x, length)[begin[row] + within].view(np.int64) for r in ROLL[1:])
    return row, batch.column("pos").to_numpy()[row] - n_left[row] + within, h1, h2


def _cells(batches: Iterator[pa.RecordBatch], length: int, step: int, cells: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        yield pa.RecordBatch.from_arrays([pa.array(_strings(batch, length, step)[2] & (cells - 1))], ["cell"])


def _bits(got: pa.Table, cells: int) -> np.ndarray:
    """The bitmap as one array; buckets of 4 KB count from 1."""
    out = np.zeros(cells // 8, np.uint8)
    for bucket, bits in zip(got.column("bucket").to_pylist(), got.column("bits").to_pylist(), strict=True):
        part = out[(bucket - 1) * 4096 : bucket * 4096]
        part[:] = np.frombuffer(bits, np.uint8)[: len(part)]
    return out


def _windows(batches: Iterator[pa.RecordBatch], length: int, step: int, twice) -> Iterator[pa.RecordBatch]:
    """c1, c2, start, h1, h2 of the strings whose cell is hit more than once."""
    bits = twice.value
    for batch in slices(batches, 64):
        row, start, h1, h2 = _strings(batch, length, step)
        cell = h1 & (8 * len(bits) - 1)
        hit = _hit(cell, bits)
        c1, c2 = (batch.column(c).to_numpy()[row[hit]] for c in ("c1", "c2"))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (c1, c2, start[hit], h1[hit], h2[hit])], ["c1", "c2", "start", "h1", "h2"])


def _runs(batches: Iterator[pa.RecordBatch], length: int, step: int, known) -> Iterator[pa.RecordBatch]:
    """c1, c2, start, end of the runs of strings that are known to repeat; known: pairs of hashes sorted by the first."""
    k1, k2 = known.value
    most = int(np.unique(k1, return_counts=True)[1].max(initial=0))  # 1, but for chance
    for batch in slices(batches, 64):
        row, start, h1, h2 = _strings(batch, length, step)
        at, hit = np.searchsorted(k1, h1), np.zeros(len(h1), bool)
        for k in range(most):
            i = np.minimum(at + k, len(k1) - 1)
            hit |= (k1[i] == h1) & (k2[i] == h2)
        row, start = row[hit], start[hit]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + step)
        edge = np.flatnonzero(new)
        last = np.append(edge, len(row))[1:] - 1
        c1, c2 = (batch.column(c).to_numpy()[row[edge]] for c in ("c1", "c2"))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (c1, c2, start[edge], start[last] + length)], ["c1", "c2", "start", "end"])


def _covered(spans) -> Column:
    """The number of units that an array of (start, end) covers."""
    step = lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, acc.end))).alias("n"), F.greatest(acc.end, s.end).alias("end"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.sort_array(spans), none, step, lambda acc: acc.n)


def repeated_bytes(docs: DataFrame, length: int = 400, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", most_in_task: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words for each row of docs; see repeated_spans().

    n_repeated_words counts the words that a string of `words` words covers that begins elsewhere too; nothing is
    removed for it, as such a passage may be shorter than `length` bytes. Repeated rows are rows with the same text: all
    their bytes go, if there are `length` of them. Null texts are empty.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, contents, spans = repeated_spans(docs, length, words, most_in_task)
    parts = spans.groupBy("c1", "c2", "kind").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    cut = _texts_of(docs, contents.where(~whole).join(parts.where("kind = 0"), ["c1", "c2"]).select("c1", "c2", "rep", "spans")).select("c1", "c2", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for c1, c2, raw, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _raw(batch.column(2).to_pylist()), batch.column(3).to_pylist(), strict=True):
                kept, at, n = hashlib.sha256(), 0, 0
                end = -1
                for a, b in sorted((s["start"], s["end"]) for s in found):
                    if a > end:
                        n += 1
                        kept.update(raw[at:a])
                    end = max(end, b)
                    at = end
                kept.update(raw[at:])
                edges = np.zeros(len(raw) + 1, np.int64)
                for s in found:
                    edges[s["start"]] += 1
                    edges[s["end"]] -= 1
                out.append((c1, c2, int((np.cumsum(edges[:-1]) > 0).sum()), n, kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["c1", "c2", "n_removed", "n_spans", "kept_sha256"])

    done = cut.mapInArrow(remove, "c1 long, c2 long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["c1", "c2"])
    in_words = parts.where("kind = 1").select("c1", "c2", (_covered("spans") / WORD).cast("long").alias("n_repeated_words"))
    of = contents.join(done, ["c1", "c2"], "left").join(in_words, ["c1", "c2"], "left")
    all_words = (F.col("copies") > 1) & (F.col("n_words") >= words)
    results = of.select(
        "c1", "c2", "copies", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(all_words, F.col("n_words")).otherwise(F.col("n_repeated_words")).alias("n_repeated_words"),
    ).where("n_removed > 0 OR n_repeated_words > 0")
    out = lookup(rows, _kept(results, "removed"), ["c1", "c2"], "copies", rows.count())
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "n_spans")]
    return out.select("doc_id", "n_bytes", *counts, F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_repeated_words", F.lit(0)).alias("n_repeated_words"))


def repeated_spans(docs: DataFrame, length: int, words: int, most_in_task: int, most_known: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, c1, c2, n_bytes, sha), contents (c1, c2, rep, copies, n_bytes, n_words) and spans (c1, c2, kind, start, end).

    A byte is in a span of kind 0 if a string of `length` bytes that covers it also begins at another place of any text;
    spans of kind 1 are of `words` words, WORD units each. Contents that occur more than once are repeated as a whole. Of hot
    k-grams, at most most_known repeated strings (16 bytes each) are broadcast; more come back by a join.
    """
    of_kind = _kinds(length, words)
    by_kind = lambda a, b: F.when(F.col("kind") == 0, a).otherwise(b)
    scan = _kept(_scan(docs, length, words), "anchors")
    rows = scan.select("doc_id", "c1", "c2", "n_bytes", "sha")
    contents = scan.groupBy("c1", "c2").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("rep"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("n_words").alias("n_words"))
    contents = _kept(contents, "contents")
    # most k-grams occur once: a bitmap of the others keeps those places from every shuffle
    total = scan.agg(F.coalesce(F.sum(F.size("pos")), F.lit(0))).first()[0]
    cells = _n_cells(total)
    twice = _twice(scan.select(F.explode("kg").alias("kg")).select(F.shiftright("kg", 1).bitwiseAND(F.lit(cells - 1)).alias("cell")), cells)
    places = scan.select("c1", "c2", "pos", "kg", "ctx", "n_bytes", "n_words")
    flat = places.mapInArrow(partial(_places, twice=twice), "kg long, ctx long, kind int, c1 long, c2 long, pos long, n long")
    place = F.xxhash64("c1", "c2", "pos")
    classes = flat.groupBy("kg", "ctx").agg(F.count("*").alias("m"), (F.min(place) != F.max(place)).alias("again"), *[F.first(c).alias(c) for c in ("c1", "c2", "pos")])  # of one row: none is null
    classes = _kept(classes, "classes")
    shared = _kept(classes.groupBy("kg").agg(F.count("*").alias("q")).where("q > 1"), "shared-grams")
    reps = lookup(classes, shared, "kg", "q", classes.count()).where("q IS NOT NULL")
    reps = _kept(reps.select("kg", "ctx", "q", "c1", "c2", "pos"), "class-places")

    # places whose whole surroundings occur again
    found = lookup(flat, classes.where("again").select("kg", "ctx", "m"), ["kg", "ctx"], "m", total).where("m IS NOT NULL")
    full, before = (by_kind(F.lit(a), F.lit(b)) for a, b in zip(*[(size, size - gram) for size, gram, _ in of_kind.values()], strict=True))
    start, end = F.greatest(F.col("pos") - before, F.lit(0)), F.least(F.col("pos") + full, F.col("n"))
    certain = found.select("c1", "c2", "kind", start.cast("long").alias("start"), end.cast("long").alias("end")).where(F.col("end") - F.col("start") >= full).distinct()

    # the others, by suffix arrays
    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):  # a place takes over a kilobyte, and a long text has hundreds
            cols: list[list] = [[] for _ in range(8)]
            raws = _raw(batch.column(0).to_pylist())
            hashes, first = word_hashes(raws)
            for i, (raw, c1, c2, places_of) in enumerate(zip(raws, batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                texts = (raw, _coded(hashes[first[i] : first[i + 1]]))
                for p in places_of:
                    at, kind = p["pos"], p["kg"] & 1
                    size, gram, _ = of_kind[kind]
                    for c, v in zip(cols, (p["kg"], p["ctx"], kind, c1, c2, at, texts[kind][at : at + size], texts[kind][max(0, at - size + gram) : at][::-1]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(cols[:6])], *[pa.array(c, pa.binary()) for c in cols[6:]]], ["kg", "ctx", "kind", "c1", "c2", "pos", "right", "left"])

    def near(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("c1", "c2").agg(F.collect_list(F.struct("kg", "ctx", "pos")).alias("places")).join(contents.select("c1", "c2", "rep"), ["c1", "c2"])
        return _texts_of(docs, wanted).select("text", "c1", "c2", "places").mapInArrow(around, "kg long, ctx long, kind int, c1 long, c2 long, pos long, right binary, left binary")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most_in_task):
            for kind, (size, gram, step) in of_kind.items():
                t = chunk.filter(pc.equal(chunk.column("kind"), kind))
                low, high = _ranges(t.column("right").to_pylist(), t.column("left").to_pylist(), size, size - gram, step)
                ok = np.flatnonzero(high >= 0)
                pos = t.column("pos").to_numpy()[ok]
                yield pa.RecordBatch.from_arrays([pa.array(t.column("c1").to_numpy()[ok]), pa.array(t.column("c2").to_numpy()[ok]), pa.array(np.full(len(ok), kind, np.int32)), pa.array(pos - high[ok]), pa.array(pos - low[ok] + size)], ["c1", "c2", "kind", "start", "end"])

    span = "c1 long, c2 long, start long, end long"
    sorted_ = near(reps.where(F.col("q") <= most_in_task)).repartition("kg").sortWithinPartitions("kg", "ctx").mapInArrow(solve, "c1 long, c2 long, kind int, start long, end long")

    # k-grams with more places than a task may hold: count their strings by hash, first in cells, then those in cells hit twice
    beyond = reps.where(F.col("q") > most_in_task)
    if beyond.head(1):
        every = _kept(near(beyond).dropDuplicates(["c1", "c2", "kind", "pos"]).select("c1", "c2", "kind", "pos", "right", "left"), "hot-places")
        for kind, (size, gram, step) in of_kind.items():
            hot = every.where(F.col("kind") == kind).drop("kind")
            n = hot.count()
            cells = _n_cells(((size - gram) // step + 1) * n)
            twice = _twice(hot.mapInArrow(partial(_cells, length=size, step=step, cells=cells), "cell long"), cells)
            strings = hot.mapInArrow(partial(_windows, length=size, step=step, twice=twice), "c1 long, c2 long, start long, h1 long, h2 long")
            place = F.xxhash64("c1", "c2", "start")
            again = strings.groupBy("h1", "h2").agg(F.count("*").alias("n"), (F.min(place) != F.max(place)).alias("again")).where("again").select("h1", "h2", "n")
            again = _kept(again, "repeated-strings")
            if again.count() <= most_known:
                got = again.select("h1", "h2").toArrow()
                order = np.argsort(got.column("h1").to_numpy())
                known = hot.sparkSession.sparkContext.broadcast((got.column("h1").to_numpy()[order], got.column("h2").to_numpy()[order]))
                counted = hot.mapInArrow(partial(_runs, length=size, step=step, known=known), span)
            else:
                strings = _kept(strings, "strings")
                found = lookup(strings, again, ["h1", "h2"], "n", strings.count()).where("n IS NOT NULL")
                counted = found.select("c1", "c2", "start", (F.col("start") + size).alias("end")).distinct()
            sorted_ = sorted_.unionByName(counted.withColumn("kind", F.lit(kind)))
    return rows, contents, _kept(certain.unionByName(sorted_), "spans")


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about `most` rows sorted by kg that don't split a kg; of rows with equal (kg, ctx), the first."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        key, ctx = batch.column("kg").to_numpy(), batch.column("ctx").to_numpy()
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
        if len(key) and last == (key[0], ctx[0]):
            fresh[0] = False
        if len(key):
            last = (key[-1], ctx[-1])
        table = pa.Table.from_batches([batch]).filter(pa.array(fresh))
        if not table.num_rows:
            continue
        held.append(table)
        if sum(t.num_rows for t in held) >= most // 2:
            whole = pa.concat_tables(held)
            key = whole.column("kg").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)]
    if held:
        yield pa.concat_tables(held)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes; n_repeated_words tells passages of 50 words too. Nulls and repeated rows as in repeated_bytes()."""
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
