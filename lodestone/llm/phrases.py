"""Phrase collocations from depth-limited count tries.

A symbol is the hash of a language and a word. A phrase can be frequent only if its words and its pairs are; two passes
over the texts count words, then pairs of frequent words, and leave filters of the frequent ones. The third pass makes
the tries: a task's windows of up to 5 symbols become a trie of counts, level by level, serialised in the order of their
first pair's hash, so that a range of pairs is a slice of every level. A range's task merges the shards' slices. Walks
from the root give the counts of left parts; suffix links, joins of a phrase with the phrase less its first word, those
of right parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import _BYTE, mixed, powers, slices, stored, text_slices

DEPTH, LEAST, TOP = 5, 100, 2000
#: Bytes of text at once, and windows of a shard's trie.
PIECE, WINDOWS = 1 << 22, 1 << 19
_ODD = np.uint64(0xD6E8FEB86659FD93)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# --- words of texts as symbols ---


def _part(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, begins and ends of the words of a buffer."""
    solid = ~_GAP[x]
    edge = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    within = np.flatnonzero(solid) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_BYTE[x[solid]] * powers(int(lengths.max()))[within], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mixed(sums + lengths.astype(np.uint64)), starts, ends


class Words:
    """The words of some texts in order: symbol, piece (a number that differs across breaks), begin and end in `buffer`, text."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.buffer = x = np.frombuffer(b"\n".join([*texts, b""]).translate(_LOWER), np.uint8)
        begin, pieces, parts = 0, 0, []
        while begin < len(x):
            end = begin + PIECE
            while end < len(x) and not _GAP[x[end]]:
                end += 1
            hashes, starts, ends = _part(x[begin:end])
            breaks = np.cumsum(_BREAK[x[begin:end]])
            parts.append((hashes, breaks[starts] + pieces, starts + begin, ends + begin))
            pieces += int(breaks[-1])
            begin = end
        hashes, self.piece, self.start, self.end = (np.concatenate(c) for c in zip(*parts, strict=True))
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(first, self.start, "right") - 1
        seeds = {lang: int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") for lang in set(langs)}
        self.symbol = mixed(hashes + np.array([seeds[lang] for lang in langs], np.uint64)[self.text])

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at some places."""
        lengths = self.end[at] - self.start[at]
        ends = np.cumsum(lengths)
        data = self.buffer[np.arange(lengths.sum()) + np.repeat(self.start[at] - (ends - lengths), lengths)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    for batch in slices(batches):
        texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
        langs = batch.column(1).to_pylist()
        for a, b in text_slices(texts, PIECE):
            yield Words(texts[a:b], langs[a:b]), langs[a:b]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, langs in _words(batches):
        symbols, first, n = np.unique(words.symbol, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(words.text[first])), words.strings(first), pa.array(symbols.view(np.int64)), pa.array(n)], ["lang", "word", "symbol", "n"])


# --- filters of frequent keys ---


class Filter:
    """Bits of hashed keys, two for each; no key that it was made of is missing."""

    def __init__(self, keys: DataFrame, column: str, most: int = 1 << 29):
        """At most `most` bits (64 MB); fuller filters let more through, and results stay the same."""
        n, self.cells = keys.count(), 1 << 15
        while self.cells < min(16 * n, most):
            self.cells *= 2
        cells = F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(self.cells - 1)) + 1 for s in (0, 32)])
        cell = keys.select(F.explode(cells).alias("cell"))
        bits = cell.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
        self.bits = np.zeros(self.cells // 8, np.uint8)
        for bucket, found in bits.collect():
            self.bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(found, np.uint8)
        self.n = n

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for s in (0, 32):
            cell = (keys >> np.uint64(s)) & np.uint64(self.cells - 1)
            out &= (self.bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _pair_keys(symbols: np.ndarray) -> np.ndarray:
    return mixed(symbols[:-1] * _ODD + symbols[1:])


def _count_pairs(batches: Iterator[pa.RecordBatch], known: Filter) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["pair", "n"])

    for words, _ in _words(batches):
        some = known(words.symbol)
        held.append(_pair_keys(words.symbol)[some[:-1] & some[1:] & (words.piece[:-1] == words.piece[1:])])
        size += len(held[-1])
        if size >= 1 << 21:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


# --- tries ---


class Trie:
    """Levels from pairs on: symbols (two columns at the first level), parent's place in the level above, count, path hash.

    Each level is sorted by parent, then by path hash, so that the descendants of a slice of pairs are slices.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def added(cls, raw: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
        """From levels whose nodes may repeat, in any order; a parent is a place in the raw level above."""
        levels, place = [], np.zeros(1, np.int64)
        for symbols, parent, n, key in raw:
            keys, first, which = np.unique(key, return_index=True, return_inverse=True)
            up = place[parent[first]]
            order = np.lexsort((keys, up))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, which, n)
            levels.append((symbols[first][order], up[order], total[order], keys[order]))
            place = rank[which]
        return cls(levels)

    @classmethod
    def of_windows(cls, windows: np.ndarray, depth: np.ndarray) -> Trie:
        """windows: symbols (rows of DEPTH); the first `depth` of each count, at every length from two."""
        raw, at, key = [], np.arange(len(windows)), _pair_keys_of(windows[:, 0], windows[:, 1])
        raw.append((windows[:, :2], np.zeros(len(at), np.int64), np.ones(len(at), np.int64), key))
        for d in range(2, windows.shape[1]):
            on = np.flatnonzero(depth[at] > d)
            at, key = at[on], _pair_keys_of(key[on], windows[at[on], d])
            raw.append((windows[at, d : d + 1], on, np.ones(len(at), np.int64), key))
        return cls.added(raw)

    def serialised(self, ranges: int) -> Iterator[tuple[int, list[bytes]]]:
        """(range, bytes of each level) for each range of the first pairs' hashes that has nodes."""
        part = _range_of(self.levels[0][3], ranges)
        for r in np.unique(part).tolist():
            a, b = np.searchsorted(part, [r, r + 1]).tolist()
            out, above = [], 0
            for symbols, parent, n, _ in self.levels:
                if out:
                    above, (a, b) = a, np.searchsorted(parent, [a, b]).tolist()
                out.append(np.ascontiguousarray(symbols[a:b]).tobytes() + (parent[a:b] - above).astype(np.int64).tobytes() + n[a:b].tobytes())
            yield r, out

    @classmethod
    def merged(cls, tries: list[list[bytes]]) -> Trie:
        """The sum of serialised slices of one range."""
        raw, base, keys = [], np.zeros(len(tries), np.int64), [np.zeros(1, np.uint64)] * len(tries)
        for level in range(len(tries[0])):
            columns, sizes = [], []
            for i, t in enumerate(tries):
                x = np.frombuffer(t[level], np.uint64)
                wide = 2 if level == 0 else 1
                n = len(x) // (wide + 2)
                symbols, parent, count = x[: wide * n].reshape(n, wide), x[wide * n : wide * n + n].view(np.int64), x[wide * n + n :].view(np.int64)
                keys[i] = _pair_keys_of(symbols[:, 0], symbols[:, 1]) if level == 0 else _pair_keys_of(keys[i][parent], symbols[:, 0])
                columns.append((symbols, parent + base[i] if level else parent * 0, count, keys[i]))
                sizes.append(n)
            raw.append(tuple(np.concatenate(c) for c in zip(*columns, strict=True)))
            base = np.cumsum([0, *sizes[:-1]])
        return cls.added(raw)

    def size(self) -> int:
        return sum(len(level[2]) for level in self.levels)

    def frequent(self, least: int) -> Iterator[pa.RecordBatch]:
        """symbols, n and lefts (counts of the prefixes from two symbols on) of the nodes with `least` or more."""
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))
        for d in range(len(self.levels)):
            at = np.flatnonzero(self.levels[d][2] >= least)
            n, path, lefts = self.levels[d][2][at], [], []
            for up in range(d, -1, -1):
                symbols, parent, count, _ = self.levels[up]
                path.insert(0, symbols[at])
                if up < d:
                    lefts.insert(0, count[at])
                at = parent[at]
            if len(n):
                left = np.stack(lefts, 1) if lefts else np.zeros((len(n), 0), np.int64)
                yield pa.RecordBatch.from_arrays([lists(np.concatenate(path, 1)), pa.array(n), lists(left)], ["symbols", "n", "lefts"])


def _pair_keys_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _ODD + b)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """ranges is a power of two."""
    return (keys >> np.uint64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)


def _shard_tries(batches: Iterator[pa.RecordBatch], words_known: Filter, pairs_known: Filter, depth: int, ranges: int) -> Iterator[pa.RecordBatch]:
    held, depths, size = [], [], 0

    def made() -> pa.RecordBatch:
        parts, levels = zip(*Trie.of_windows(np.concatenate(held), np.concatenate(depths)).serialised(ranges), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(levels, pa.list_(pa.binary()))], ["range", "levels"])

    for words, _ in _words(batches):
        s, n = words.symbol, len(words.symbol)
        if n < 2:
            continue
        some = words_known(s)
        ok = np.zeros(n + depth, bool)
        at = np.flatnonzero(some[:-1] & some[1:] & (words.piece[:-1] == words.piece[1:]))
        ok[at[pairs_known(_pair_keys_of(s[at], s[at + 1]))]] = True
        first = np.flatnonzero(ok)
        s = np.concatenate([s, np.zeros(depth, np.uint64)])
        for begin in range(0, len(first), WINDOWS):
            f = first[begin : begin + WINDOWS]
            go, deep = np.ones(len(f), bool), np.full(len(f), 1)
            for k in range(depth - 1):
                go &= ok[f + k]
                deep += go
            held.append(s[f[:, None] + np.arange(depth)])
            depths.append(deep)
            size += len(f)
            if size >= WINDOWS:
                yield made()
                held, depths, size = [], [], 0
    if size:
        yield made()


def _merge_ranges(batches: Iterator[pa.RecordBatch], least: int, at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    part, tries, size = None, [], 0
    for batch in batches:
        for r, levels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if r != part:
                if tries:
                    yield from Trie.merged(tries).frequent(least)
                part, tries, size = r, [], 0
            tries.append(levels)
            size += sum(map(len, levels)) // 24
            if size >= at_once:  # one trie takes the place of many
                (_, levels), = Trie.merged(tries).serialised(1)
                tries = [levels]
                size = min(sum(map(len, levels)) // 24, at_once // 2)
    if tries:
        yield from Trie.merged(tries).frequent(least)


# --- the operator ---


def frequent_phrases(docs: DataFrame, least: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words (symbol, lang, word, n), totals (lang, total) and phrases (symbols, n, lefts) of docs (text, lang); words and phrases have n >= least."""
    sc = docs.sparkSession.sparkContext
    words = stored(docs.mapInArrow(_count_words, "lang string, word string, symbol long, n long").groupBy("lang", "word", "symbol").agg(F.sum("n").alias("n")), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    often = stored(words.where(F.col("n") >= least), "frequent-words")
    known = sc.broadcast(Filter(often, "symbol"))
    pairs = docs.mapInArrow(lambda b: _count_pairs(b, known.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs_filter = Filter(stored(pairs.select("pair"), "frequent-pairs"), "pair")
    pairs_known, ranges = sc.broadcast(pairs_filter), 64
    while ranges < pairs_filter.n >> 12:
        ranges *= 2
    shards = docs.mapInArrow(lambda b: _shard_tries(b, known.value, pairs_known.value, depth, ranges), "range long, levels array<binary>")
    merged = shards.repartition("range").sortWithinPartitions("range").mapInArrow(lambda b: _merge_ranges(b, least), "symbols array<long>, n long, lefts array<long>")
    return often, totals, stored(merged, "frequent-phrases")


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, percent: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language (null: und).

    Texts (null: empty), A-Z as a-z, fall into pieces at . , ; : ! ? and line ends, and those into words at spaces and
    tabs. A candidate has 2 to `depth` words and a >= least occurrences. Of its cuts into left part (l occurrences) and
    right part (r), the one with the least floor(1000 * a * n / (l * r)) counts, n being the language's words; ties go
    to the shortest left part. A candidate inside a longer one with percent / 100 of its occurrences is dropped. Order:
    score, a, both descending, phrase. Repeated rows count each.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    words, totals, found = frequent_phrases(rows, least, depth)
    # suffix links: rights of a phrase are its own count, then those of the phrase less its first word
    linked = words.select(F.array("symbol").alias("symbols"), F.array("n").alias("rights"))
    out = None
    for d in range(2, depth + 1):
        own = found.where(F.size("symbols") == d).withColumn("tail", F.slice("symbols", 2, d - 1))
        links = linked.select(F.col("symbols").alias("tail"), F.col("rights").alias("tail_rights"))
        linked = stored(own.join(links, "tail").select("symbols", F.col("n").alias("a"), "lefts", F.concat(F.array("n"), "tail_rights").alias("rights")), "linked-phrases")
        out = linked if out is None else out.unionByName(linked)
    longer = out.where(F.size("symbols") > 2).select(F.explode(F.array(F.expr("slice(symbols, 1, size(symbols) - 1)"), F.expr("slice(symbols, 2, size(symbols) - 1)"))).alias("symbols"), "a")
    longer = longer.groupBy("symbols").agg(F.max("a").alias("longer"))
    kept = out.join(longer, "symbols", "left").where(F.expr(f"longer IS NULL OR 100 * longer < {percent} * a"))
    firsts = words.select(F.col("symbol").alias("first"), "lang", F.col("n").alias("l1"))
    kept = kept.withColumn("first", F.col("symbols")[0]).join(firsts, "first").join(totals, "lang")
    exact = "(1000 * CAST(a AS DECIMAL(38, 0)) * total) DIV (CAST({0} AS DECIMAL(38, 0)) * {1})"
    left, right = "element_at(parts, k)", "element_at(rights, k + 1)"
    cuts = F.expr(f"array_min(transform(sequence(1, size(symbols) - 1), k -> struct({exact.format(left, right)} AS score, k AS k, {left} AS l, {right} AS r)))")
    scored = kept.withColumn("parts", F.concat(F.array("l1"), "lefts")).withColumn("best", cuts)
    scored = scored.select("lang", "symbols", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("total").alias("n"), F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a")]
    scored = scored.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    scored = stored(scored, "top-phrases")
    names = scored.select("lang", "symbols", F.posexplode("symbols").alias("at", "symbol")).join(words.select("symbol", "word"), "symbol")
    names = names.groupBy("lang", "symbols").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = scored.join(names, ["lang", "symbols"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of `documents`; nulls and repeated rows as in collocations()."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) k(m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
      FROM c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, a, ws, len(ws) AS m, unnest(range(2, len(ws))) AS d FROM (SELECT lang, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 2)),
i AS (SELECT lang, array_to_string(ws[j:j + d - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - d + 2)) AS j FROM o) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""
