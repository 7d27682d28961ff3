import random
import re
from itertools import combinations

import numpy as np
import pytest
from llm.fixtures import clashing, docs, hard, prose

from lodestone.llm import near_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text), all pairs on full sets."""
    sets = [_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j] or min(len(sets[i]), len(sets[j])) * 100 < percent * max(len(sets[i]), len(sets[j])):
            continue
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def _check(df, source):
    got = sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in source.collect()])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    _check(near_dedup.op3_minhash_near_dedup(spark, f"/root/testdata/{sf}"), spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_nulls_ties_long_texts(spark, wrap):
    _check(near_dedup.near_duplicates(wrap(hard(spark))), hard(spark))


def _edited(text, k, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_chains_and_thresholds(spark):
    """Groups of near copies at every distance round the threshold, and chains that only links of links join."""
    texts = []
    for g in range(12):
        base = prose(g, 120)
        texts += [_edited(base, k, 100 * g + k) for k in range(0, 6)]
    step = prose(99, 150)
    for k in range(15):
        texts.append(step)
        step = _edited(step, 1, 7000 + k)
    df = docs(spark, [(len(texts) - i, t) for i, t in enumerate(texts)])
    _check(near_dedup.near_duplicates(df), df)


def test_large_group_in_tiles(spark):
    """More near copies than a tile holds."""
    base = prose(5, 200)
    df = docs(spark, [_edited(base, 1 + i % 2, i) for i in range(700)] + [prose(1000 + i, 60) for i in range(50)])
    _check(near_dedup.near_duplicates(df), df)


def test_without_sketches(spark):
    """The exact way: every pair that shares a key is held against full sets."""
    texts = [_edited(prose(g, 120), k, 100 * g + k) for g in range(10) for k in range(6)]
    df = docs(spark, texts)
    _check(near_dedup.near_duplicates(df, sketches=False), df)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []


def test_pairs_within_the_distance_share_a_key():
    """Pigeonhole: signatures that differ in MOST_ERRORS symbols at most share an enumerated key."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (500, near_dedup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for i in range(len(b)):
        at = rng.permutation(near_dedup.SYMBOLS)[: near_dedup.MOST_ERRORS]
        b[i, at] ^= np.uint16(1) + rng.integers(0, 1 << 15, len(at), dtype=np.uint16)
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(1).all()


def test_links_beyond_the_distance_that_share_a_key(spark):
    """Pairs of similarity 0.8507 whose signatures differ in more than MOST_ERRORS symbols, but share a key."""
    seeds = (4205, 5556, 9659, 29438)
    pairs = [(prose(k, 190), _edited(prose(k, 190), 3, k)) for k in seeds]
    for pair in pairs:
        a, b = (near_dedup.signature(s) for s in near_dedup.shingle_sets([t.encode() for t in pair]))
        assert (a != b).sum() > near_dedup.MOST_ERRORS
    df = docs(spark, [t for pair in pairs for t in pair])
    assert near_dedup.near_duplicates(df).where("NOT kept").count() == len(seeds)
    _check(near_dedup.near_duplicates(df), df)
