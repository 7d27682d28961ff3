import random
import re

import numpy as np
import pytest
import xxhash
from llm.fixtures import clashing, docs, hard, prose

from lodestone.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(fps, radius=2):
    """The root of each fingerprint, all pairs compared."""
    x, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius) + i + 1:
            root[find(i)] = find(int(j))
    return [find(i) for i in range(len(x))]


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    least, roots = {}, roots_of(fps)
    for r, (doc, _) in zip(roots, rows, strict=True):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots, strict=True)), key=str)


def _check(df, source):
    got = sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in source.collect()])


def test_query(spark):
    _check(simhash.op12_simhash(spark, "/root/testdata/sf0.001"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_nulls_ties_long_texts(spark, wrap):
    _check(simhash.simhash_components(wrap(hard(spark))), hard(spark))


def test_empty_table(spark):
    assert simhash.simhash_components(docs(spark, [])).collect() == []


def test_near_copies(spark):
    texts = []
    for g in range(8):
        words = prose(g, 300).split()
        for k in range(6):
            words[50 * k] = f"other{k}"
            texts.append(" ".join(words))
    df = docs(spark, [(len(texts) - i, t) for i, t in enumerate(texts)])
    got = simhash.simhash_components(df)
    _check(got, df)
    assert got.select("component_id").distinct().count() < len(texts)


def test_long_texts_go_piece_by_piece(monkeypatch):
    text = prose(3, 500).encode() + b"  \n\t " + prose(4, 5).encode()
    whole = simhash.fingerprint(text)
    for n in (7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", n)
        assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


def _clouds(n, seed):
    """Fingerprints in chains and balls of near ones, all with the same lowest block."""
    rng, out = random.Random(seed), set()
    while len(out) < n:
        x = rng.getrandbits(43) << 21
        for _ in range(rng.randrange(1, 12)):
            out.add(x)
            x ^= 1 << rng.randrange(21, 64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(21, 64)
    return sorted(out)


@pytest.mark.parametrize(("most", "wave"), [(1 << 15, 1 << 25), (40, 1 << 25), (40, 4000)])
def test_shards_and_their_parts(spark, most, wave):
    """All fingerprints share a block: one tree, trees of parts, trees in waves."""
    fps = _clouds(700, most)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(df, most=most, wave_bytes=wave).collect()]
    at = {f: i for i, f in enumerate(fps)}
    assert all((a ^ b) and a in at and b in at for a, b in links)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(at[a])] = find(at[b])
    pairs = lambda r: {(min(j for j in range(len(r)) if r[j] == r[i]), i) for i in range(len(r))}
    assert pairs([find(i) for i in range(len(fps))]) == pairs(roots_of(fps))


def test_trees_visit_only_edges_within_the_radius():
    """A search gives what all comparisons give, and compares with far fewer nodes."""
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    forest = simhash.Forest(values, np.zeros(len(values), np.int64))
    queries = values[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    got = {(int(a), int(b)) for q, n in forest.search(queries, np.zeros(200, np.int64), 2) for a, b in zip(q, n, strict=True)}
    want = {(i, int(j)) for i, x in enumerate(queries) for j in np.flatnonzero(np.bitwise_count(values ^ x) <= 2)}
    assert got == want
    parent = forest.edges // 65
    assert len(np.unique(forest.edges)) == len(values) - 1 and (np.bitwise_count(values[forest.children] ^ values[parent]) == forest.edges % 65).all()
