import hashlib
import random
import re
import zlib

import pytest
from llm.fixtures import clashing

from lodestone.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _said(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def conversations(rows):
    """conv_id -> its turns (role, text) in order."""
    out = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", _said(r[2] or "", r[3] or ""))):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    """The nodes of conv_id -> turns, by dictionaries of prefixes."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, below = {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
        for d in range(len(p) + 1):
            below.setdefault(p[:d], []).append(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, own in members.items():
        saved = sum((len(members[q]) - 1) * words(q) for q in below[p])
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children.get(p, [])), sum(q not in children for q in below[p]), saved, digest))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def _nodes(spark, rows, **how):
    turns = prefix_trie.turn_strings(clashing(spark.createDataFrame(rows, ROWS)))
    return _got(prefix_trie.trie_nodes(prefix_trie.as_sequences(turns), **how))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(compare, sf):
    compare(prefix_trie.op11_prefix_trie, prefix_trie.OP11_SQL, f"/root/testdata/{sf}")


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(prefix_trie.op11_prefix_trie(spark, "/root/testdata/sf0.001")) == brute(rebuild(conversations(rows)))


def _branching(seed, n, most=9, alphabet=3):
    """Conversations over few different turns: copies, prefixes of each other, deep shared parts."""
    rng = random.Random(seed)
    return [(c, t, "user" if t % 2 else "assistant", " ".join(["w"] * rng.randrange(alphabet))) for c in rng.sample(range(-500, 5000), n) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize(("parts", "run_bytes", "seed"), [(1, 1 << 20, 1), (7, 400, 2), (40, 64, 3), (300, 1, 4)])
def test_ranges_and_runs(spark, parts, run_bytes, seed):
    rows = _branching(seed, 300)
    assert _nodes(spark, rows, parts=parts, run_bytes=run_bytes) == brute(conversations(rows))


def test_a_third_are_copies_and_a_first_turn_is_shared(spark):
    rows = [(c, t, "user", f"{'same' if c % 3 == 0 or t == 0 else c} turn {t}") for c in range(600) for t in range(4)]
    assert _nodes(spark, rows, parts=9, run_bytes=512) == brute(conversations(rows))


def test_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t if t < 200 - 7 * c else (c, t)}") for c in range(4) for t in range(200)]
    assert _nodes(spark, rows, parts=3) == brute(conversations(rows))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 1, "user", "x"), (1, None, "user", "b"), (1, None, "user", "a"), (1, None, None, None), (1, 0, "user", "c"), (1, 0, "user", "c"), (2, None, "", ""), (2, None, "user", "a"), (3, 0, "a", "bc"), (4, 0, "ab", "c"), (5, 1, None, "  \t\n")]
    assert _nodes(spark, rows) == brute(conversations(rows))


def test_rebuilt_conversations(spark):
    """Absent bases, bases shorter than h, conversations that lose all their turns."""
    rows = [(c, t, "user", f"{c} {t}") for c in [*range(21, 60), 81, 100, 119] for t in range(1 + c % 3)]
    turns = prefix_trie.turn_strings(spark.createDataFrame(rows, ROWS))
    got = _got(prefix_trie.trie_nodes(prefix_trie.as_sequences(prefix_trie.rebuilt(turns))))
    assert got == brute(rebuild(conversations(rows)))
    assert any(not turns for turns in rebuild(conversations(rows)).values())


def test_empty_table(spark):
    assert _nodes(spark, []) == []


def test_many_ids_of_one_sequence(spark):
    """The ids of copies are hashed in pieces."""
    members = spark.createDataFrame([("s", c) for c in range(3000, 0, -1)] + [("t", 7), ("t", -1)], "sid string, conv_id long")
    got = {r.sid: bytes(r.ends) for r in prefix_trie._ends(members, chunk=160).collect()}
    assert got == {"s": hashlib.sha256(",".join(map(str, range(1, 3001))).encode()).digest(), "t": hashlib.sha256(b"-1,7").digest()}


def test_merging_does_not_compare_shared_turns_again(monkeypatch):
    """Comparisons of turns are few more than the turns and the merge steps, however much the sequences share."""
    rng = random.Random(6)
    turn = lambda x: hashlib.md5(str(x).encode()).digest()
    deep = b"".join(turn(i) for i in range(400))
    seqs = sorted({deep + b"".join(turn(rng.randrange(3)) for _ in range(8)) for _ in range(2000)})
    rows = [(s, [1] * (len(s) // 16), i, 1, b"0" * 32) for i, s in enumerate(seqs)]
    rng.shuffle(rows)
    import numpy as np

    runs = []
    for i in range(0, len(rows), 100):
        for _, lcp, turns, rest, words, least, copies, ends in prefix_trie.sorted_run(rows[i : i + 100], []):
            runs.append(prefix_trie.Run(*(np.frombuffer(x, np.int64) for x in (lcp, turns)), rest, *(np.frombuffer(x, np.int64) for x in (words, least, copies)), ends))
    compared, real = [0], prefix_trie.common_turns

    def counted(a, b, known):
        found = real(a, b, known)
        compared[0] += found - known + 1
        return found

    monkeypatch.setattr(prefix_trie, "common_turns", counted)
    assert [run.current for run, _ in prefix_trie.merged(runs)] == seqs
    assert compared[0] < len(runs) * 400 + len(seqs) * (8 + 6)
