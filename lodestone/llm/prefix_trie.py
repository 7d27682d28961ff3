"""Conversation prefix trie by an LCP-aware external mergesort.

A conversation is the string of its turns' hashes; equal strings are one sequence with its number of copies. Map tasks
sort sequences into runs that carry the longest common prefix (LCP) with the sequence before, and send each range of
keys only what lies beyond it. A range's task merges its runs by a loser tree whose comparisons begin at known LCPs, and
the merged stream keeps a stack of open nodes: what lies deeper than the next LCP is finished. The prefixes of the
ranges' bounds are the only nodes of several ranges; their parts are added up.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lookup, small_table, stored

#: Bytes of a turn's hash.
TURN = 16
_MOST = (1 << 63) - 1
FRAGMENT = "range long, lcp binary, turns binary, rest binary, words binary, least binary, copies binary, ends binary"
NODE = "conv_id long, depth long, parent_conv_id long, bound long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, words long, shared long"


def common_turns(a: bytes, b: bytes, known: int) -> int:
    """Turns that a and b share from the beginning; `known` of them need no comparison."""
    i, n = known * TURN, min(len(a), len(b))
    while i < n and a[i : i + TURN] == b[i : i + TURN]:
        i += TURN
    return i // TURN


# --- sorted runs ---


class Run:
    """Sequences in order, each as its LCP with the one before and what follows it; values stand beside them."""

    def __init__(self, lcp, turns, rest: bytes, words, least, copies, ends: bytes):
        self.lcp, self.turns, self.rest, self.words, self.least, self.copies, self.ends = lcp, turns, rest, words, least, copies, ends
        self.at, self.place, self.current = -1, 0, b""

    def advance(self) -> bool:
        """To the next sequence; `current` is all of it, own_lcp what it shares with the one before."""
        self.at += 1
        if self.at == len(self.lcp):
            return False
        self.own_lcp = int(self.lcp[self.at])
        end = self.place + (int(self.turns[self.at]) - self.own_lcp) * TURN
        self.current = self.current[: self.own_lcp * TURN] + self.rest[self.place : end]
        self.fresh, self.place = self.words[self.place // TURN : end // TURN], end
        return True

    def value(self) -> tuple[int, int, bytes]:
        return int(self.least[self.at]), int(self.copies[self.at]), self.ends[32 * self.at : 32 * self.at + 32]


def sorted_run(rows: list[tuple[bytes, list[int], int, int, bytes]], bounds: list[bytes]) -> Iterator[tuple]:
    """rows (sequence, words of each turn, least id, copies, digest) in order, cut at the bounds, as rows of FRAGMENT."""
    rows.sort(key=lambda r: r[0])
    begin = 0
    while begin < len(rows):
        part = bisect_right(bounds, rows[begin][0])
        end = bisect_left(rows, bounds[part], lo=begin, key=lambda r: r[0]) if part < len(bounds) else len(rows)
        own = rows[begin:end]
        lcp = [0, *(common_turns(a[0], b[0], 0) for a, b in zip(own, own[1:], strict=False))]
        rest = b"".join(r[0][k * TURN :] for r, k in zip(own, lcp, strict=True))
        words = np.array([w for r, k in zip(own, lcp, strict=True) for w in r[1][k:]], np.int64)
        longs = lambda x: np.array(x, np.int64).tobytes()
        yield part, longs(lcp), longs([len(r[0]) // TURN for r in own]), rest, words.tobytes(), longs([r[2] for r in own]), longs([r[3] for r in own]), b"".join(r[4] for r in own)
        begin = end


def merged(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    """Each next sequence in order, as the run that stands at it, and its LCP with the one before.

    A loser tree: an inner node keeps the run that lost there, and a run's lcp is the one with the last winner. Of two
    runs the one with the longer lcp is less; only where both are equal are turns compared, from the lcp on.
    """
    k = len(runs)
    lcp = [0] * k
    alive = [r.advance() for r in runs]

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if not alive[a] or not alive[b]:
            return (a, b) if alive[a] else (b, a)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = runs[a].current, runs[b].current
        shared = common_turns(x, y, lcp[a])
        if x[shared * TURN : shared * TURN + TURN] > y[shared * TURN : shared * TURN + TURN]:
            a, b = b, a
        lcp[b] = shared
        return a, b

    loser = [0] * k
    winner = [0] * k + list(range(k))  # leaves k .. 2k - 1
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = duel(winner[2 * node], winner[2 * node + 1])
    top = winner[1]
    while alive[top]:
        yield runs[top], lcp[top]
        alive[top] = runs[top].advance()
        lcp[top] = runs[top].own_lcp
        node = (top + k) // 2
        while node:
            top, loser[node] = duel(top, loser[node])
            node //= 2


# --- nodes of the merged stream ---


class Nodes:
    """The trie of one range's sequences, which come in order."""

    def __init__(self, known: dict[bytes, int]):
        """known: the bounds' prefixes, whose nodes other ranges may have too, and their numbers."""
        self.known = known
        self.columns = {c: array("q") for c in ("least", "depth", "parent", "bound", "convs", "children", "leaves", "saved", "words", "shared")}
        self.ends: dict[int, bytes] = {}
        self.open: list[int] = []

    def _push(self, prefix: bytes | None, words: int) -> None:
        c, parent = self.columns, self.open[-1] if self.open else -1
        bound = self.known.get(prefix, -1) if prefix is not None else -1
        if parent >= 0:
            c["shared" if bound >= 0 else "children"][parent] += 1
        for name, v in (("least", _MOST), ("depth", len(self.open)), ("parent", parent), ("bound", bound), ("convs", 0), ("children", 0), ("leaves", 0), ("saved", 0), ("words", words), ("shared", 0)):
            c[name].append(v)
        self.open.append(len(c["least"]) - 1)

    def _finish(self) -> None:
        """The deepest open node has all its sequences: its parent gets its sums."""
        c, i = self.columns, self.open.pop()
        up, n = c["parent"][i], c["convs"][i]
        if c["bound"][i] < 0:
            c["leaves"][i] += not c["children"][i]
            c["saved"][i] += (n - 1) * c["words"][i]
            c["leaves"][up] += c["leaves"][i]
            c["saved"][up] += c["saved"][i]
        if up >= 0:
            c["convs"][up] += n
            c["least"][up] = min(c["least"][up], c["least"][i])

    def add(self, run: Run, lcp: int) -> None:
        if not self.open:
            self._push(b"", 0)
        while len(self.open) - 1 > lcp:
            self._finish()
        seq, fresh = run.current, run.fresh
        for d in range(lcp + 1, len(seq) // TURN + 1):
            # what the run's last sequence shares with this one, the stream's last sequence shares too
            self._push(seq[: d * TURN] if self.columns["bound"][self.open[-1]] >= 0 else None, int(fresh[d - 1 - run.own_lcp]))
        top = self.open[-1]
        least, copies, ends = run.value()
        self.columns["convs"][top] += copies
        self.columns["least"][top] = min(self.columns["least"][top], least)
        self.ends[top] = ends

    def rows(self) -> pa.RecordBatch:
        while self.open:
            self._finish()
        c = {k: np.frombuffer(v, np.int64) if len(v) else np.zeros(0, np.int64) for k, v in self.columns.items()}
        up = np.maximum(c["parent"], 0)
        own_bound, up_bound = c["bound"] >= 0, c["bound"][up]
        parent = pa.array(c["least"][up], mask=own_bound | (up_bound >= 0))
        bound = np.where(own_bound, c["bound"], np.where(c["parent"] >= 0, up_bound, -1))
        ends = pa.array([self.ends.get(i) for i in range(len(up))], pa.binary())
        kind = np.where(own_bound, c["shared"], -1)
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in (c["least"], c["depth"], parent, bound, c["convs"], c["children"], c["leaves"], c["saved"], ends, c["words"], kind)], [f.split()[0] for f in NODE.split(", ")])


def range_nodes(fragments: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The nodes of each range of fragments (rows of FRAGMENT, by range); `shared` is -1 but for nodes of bounds, which are in parts."""

    def closed(runs: list[Run]) -> pa.RecordBatch:
        nodes = Nodes(known)
        for run, lcp in merged(runs):
            nodes.add(run, lcp)
        return nodes.rows()

    part, runs = None, []
    for batch in fragments:
        for number, *columns in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
            if number != part and runs:
                yield closed(runs)
                runs = []
            part = number
            lcp, turns, words, least, copies = (np.frombuffer(columns[i], np.int64) for i in (0, 1, 3, 4, 5))
            runs.append(Run(lcp, turns, columns[2], words, least, copies, columns[6]))
    if runs:
        yield closed(runs)


# --- the operator ---


def turn_strings(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array of (turn, role, hash, words) in order.

    Null roles and texts are empty; null turn numbers come first, equal ones are ordered by role, then by the hash of
    role and text, and repeated rows are turns each. Rows without a conversation are left out. A conversation is one
    row of some 80 bytes a turn.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    said = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), said.alias("said"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def as_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (the turns' hashes in a row), words (of each turn), sid (a hash of seq) of conversations (conv_id, turns)."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["said"]), ""))
    out = conversations.select("conv_id", seq.alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
    return out.withColumn("sid", F.substring(F.sha2("seq", 256), 1, 2 * TURN))


def _ends(members: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """sid, digest of the comma-joined ids of members (sid, conv_id), ascending: ids become text where they lie in order, and a task hashes its sids' pieces of text one by one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, first, text, out = None, 0, [], []
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != sid or len(text) == chunk // 8:
                    if text:
                        out.append((sid, first, ",".join(text)))
                    sid, first, text = s, c, []
                text.append(str(c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["sid", "first", "ids"])
                out = []
        if text:
            yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([first], pa.int64()), pa.array([",".join(text)])], ["sid", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, sha, out = None, None, []
        for batch in batches:
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s == sid:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((sid, sha.digest()))
                    sid, sha = s, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["sid", "ends"])
                out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([sha.digest()])], ["sid", "ends"])

    pieces = members.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(join, "sid string, first long, ids string")
    return pieces.repartition("sid").sortWithinPartitions("sid", "first").select("sid", "ids").mapInArrow(digest, "sid string, ends binary")


def _bounds(seqs: DataFrame, parts: int, rows: int, each: int = 16) -> list[bytes]:
    """At most parts - 1 bounds from about `each` sampled sequences a part, cut behind the turn where they first differ from the sequence before."""
    step = max(1, rows // (each * parts))
    sample = sorted(bytes(r[0]) for r in seqs.where(F.pmod(F.xxhash64("sid"), F.lit(step)) == 0).select("seq").toLocalIterator())
    out = []
    for i in range(1, parts):
        at = len(sample) * i // parts
        if 0 < at < len(sample) and sample[at] != sample[at - 1]:
            bound = sample[at][: (common_turns(sample[at - 1], sample[at], 0) + 1) * TURN]
            if not out or bound > out[-1]:
                out.append(bound)
    return out


def trie_nodes(sequences: DataFrame, range_bytes: int = 4 << 20, run_bytes: int = 4 << 20, parts: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each prefix of sequences (conv_id, seq, words, sid).

    The root is the empty prefix; without sequences there is none. A range holds about range_bytes of hashes, a run
    run_bytes, or one sequence where that is longer. The driver holds the ranges' bounds and the sums of their prefixes.
    """
    spark = sequences.sparkSession
    rows = stored(sequences, "sequences")
    groups = stored(rows.groupBy("sid").agg(F.min("conv_id").alias("least"), F.count("*").alias("copies")), "distinct-sequences")
    total, distinct = groups.agg(F.sum("copies"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    members = lookup(rows.select("sid", "conv_id"), groups.where("copies > 1").select("sid", "copies"), "sid", "copies", total).where("copies IS NOT NULL")
    named = groups.join(_ends(members.select("sid", "conv_id")), "sid", "left")
    alone = F.unhex(F.sha2(F.col("least").cast("string"), 256))
    named = named.select("sid", F.col("least").alias("conv_id"), "copies", F.coalesce("ends", alone).alias("ends"))
    seqs = stored(rows.join(named, ["sid", "conv_id"]), "sequences")
    size = seqs.agg(F.sum(F.length("seq"))).first()[0]
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    bounds = _bounds(seqs, parts, distinct)
    prefixes = sorted({b[:k] for b in [b"", *bounds] for k in range(0, len(b) + 1, TURN)})
    known = {p: i for i, p in enumerate(prefixes)}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FRAGMENT.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*sorted_run(rows, bounds), strict=True)], names)
        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                held.append(row)
                size += len(row[0])
                if size >= run_bytes:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    fragments = seqs.select("seq", "words", "conv_id", "copies", "ends").mapInArrow(runs, FRAGMENT)
    made = stored(fragments.repartition("range").sortWithinPartitions("range").mapInArrow(lambda b: range_nodes(b, known), NODE), "trie-nodes")

    # nodes of bounds: parts of several ranges, at most one row for each prefix of a bound
    least = made.where("shared >= 0").groupBy("bound").agg(F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("ends"), F.max("words")).collect()
    node = {r[0]: list(r[1:]) for r in least}
    up = lambda i: known[prefixes[i][:-TURN]]
    shared = dict.fromkeys(node, 0)
    for i in node:
        if i:
            shared[up(i)] += 1
    out = []
    for i in sorted(node, key=lambda i: -len(prefixes[i])):  # children first
        conv, convs, children, leaves, saved, ends, words = node[i]
        children += shared[i]
        leaves += not children
        saved += (convs - 1) * words
        if i:
            node[up(i)][3] += leaves
            node[up(i)][4] += saved
        out.append((i, conv, len(prefixes[i]) // TURN, node[up(i)][0] if i else None, convs, children, leaves, saved, (ends or hashlib.sha256().digest()).hex()))
    tops = small_table(spark, out, "bound long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    own = made.where("shared < 0").withColumn("ends_sha256", F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256)))
    above = tops.select("bound", F.col("conv_id").alias("above"))
    own = own.join(F.broadcast(above) if len(out) < 1 << 18 else above, "bound", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    names = tops.columns[1:]
    return own.select(names).unionByName(tops.select(names))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """conversations (conv_id, turns) with the first h turns of conversation c - c % every before their own after the first h; h = crc32(c) % (most + 1)."""
    first = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    own = conversations.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")})
    joined = own.join(first, "base", "left")
    taken = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(taken, rest).alias("turns"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt `conversations`; nulls, ties and repeated rows as in turn_strings()."""
    turns = turn_strings(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie_nodes(as_sequences(rebuilt(stored(turns, "conversations"))))


OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS s,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, s, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, s) AS pos FROM t),
i AS (SELECT conv_id, max(pos) AS n, conv_id - conv_id % 20 AS base,
             xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: z::UBIGINT)),
                     lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))) % 4 AS h FROM c GROUP BY conv_id),
r AS (SELECT i.conv_id, c.pos AS d, c.s, c.w FROM i JOIN c ON c.conv_id = i.base AND c.pos <= i.h
      UNION ALL SELECT i.conv_id, c.pos - i.h + least(i.h, coalesce(b.n, 0)), c.s, c.w FROM i JOIN c ON c.conv_id = i.conv_id AND c.pos > i.h LEFT JOIN i b ON b.conv_id = i.base),
m AS (SELECT conv_id, d, w, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM i),
l AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
g AS (SELECT d, k, min(m.conv_id) AS conv_id, count(*) AS n, max(w) AS w, coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (l.d IS NOT NULL), '') AS e
      FROM m LEFT JOIN l USING (conv_id, d) GROUP BY d, k),
p AS (SELECT g.conv_id, g.d, m.k AS up FROM g JOIN m ON m.conv_id = g.conv_id AND m.d = g.d - 1),
f AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT m.d, m.k, count(*) FILTER (f.n IS NULL) AS leaves, sum((g.n - 1) * g.w) AS saved
      FROM g LEFT JOIN f ON f.d = g.d AND f.k = g.k JOIN m ON m.conv_id = g.conv_id AND m.d <= g.d GROUP BY m.d, m.k)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, g.n AS n_convs, coalesce(f.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(g.e) AS ends_sha256
FROM g JOIN s ON s.d = g.d AND s.k = g.k LEFT JOIN f ON f.d = g.d AND f.k = g.k LEFT JOIN p ON p.conv_id = g.conv_id AND p.d = g.d LEFT JOIN g a ON a.d = g.d - 1 AND a.k = p.up
"""
