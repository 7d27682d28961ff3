import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from llm.fixtures import clashing, docs, hard, prose

from lodestone.llm import substring_dedup
from lodestone.llm.suffix_sort import deep_shallow_sort, matrix


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), every string of `length` bytes in a table."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    at = defaultdict(list)
    for k, (_, b) in enumerate(raw):
        for s in range(len(b) - length + 1):
            at[hashlib.md5(b[s : s + length]).digest()].append((k, s))
    gone = [np.zeros(len(b) + 2, np.int64) for _, b in raw]
    for places in at.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s + 1] += 1
                gone[k][s + 1 + length] -= 1
    out = []
    for (i, b), g in zip(raw, gone, strict=True):
        mask = np.cumsum(g)[1 : len(b) + 1] > 0
        spans = int(np.count_nonzero(np.diff(mask.astype(int), prepend=0) == 1))
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, words):
    """(doc_id, n_repeated_words)."""
    lists = [(i, (t or "").encode().translate(bytes(32 if 9 <= b <= 13 else b for b in range(256))).split(b" ")) for i, t in rows]
    lists = [(i, [w for w in ws if w]) for i, ws in lists]
    at = defaultdict(list)
    for k, (_, ws) in enumerate(lists):
        for s in range(len(ws) - words + 1):
            at[hashlib.md5(b" ".join(ws[s : s + words])).digest()].append((k, s))
    gone = [np.zeros(len(ws) + 1, np.int64) for _, ws in lists]
    for places in at.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s] += 1
                gone[k][s + words] -= 1
    return sorted(((i, int((np.cumsum(g) > 0).sum())) for (i, _), g in zip(lists, gone, strict=True)), key=str)


def _check(df, source, length, words=50):
    df = df.persist()
    assert sorted((tuple(r) for r in df.select("doc_id", "n_repeated_words").collect()), key=str) == brute_words([(r.doc_id, r.text) for r in source.collect()], words)
    got = sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in source.collect()], length)


def test_query(spark):
    _check(substring_dedup.op7_suffix_dedup(spark, "/root/testdata/sf0.001"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 400)


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_nulls_long_and_repetitive_texts(spark, wrap):
    df = hard(spark).unionByName(docs(spark, [(50, "ab" * 600), (51, "x" * 399), (52, "x" * 400), (53, "x" * 401), (54, "é" * 350)]))
    _check(substring_dedup.repeated_bytes(wrap(df)), df, 400)


def _mosaic(seed, n):
    """Texts of shared passages, cut anywhere and put in new surroundings."""
    rng = random.Random(seed)
    pool = [prose(seed * 100 + i, 120) for i in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randrange(20, 500)], prose(rng.randrange(10**9), rng.randrange(1, 40))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (2, 150), (3, 400), (4, 80)])
def test_passages_cut_anywhere(spark, seed, length):
    df = docs(spark, _mosaic(seed, 60))
    _check(substring_dedup.repeated_bytes(df, length=length), df, length)


def test_passages_with_more_places_than_a_task_holds(spark):
    df = docs(spark, _mosaic(7, 60) + ["y" * 300 + prose(i, 5) for i in range(30)])
    _check(substring_dedup.repeated_bytes(df, length=120, words=20, most_in_task=8), df, 120, 20)


def test_short_passages_of_fifty_words(spark):
    """Passages of 50 words and less than 400 bytes: nothing is removed, but the words are counted; 49 words are not."""
    p = prose(5, 51, words=9)
    texts = [prose(1, 90) + " " + p + " " + prose(2, 90), prose(3, 30) + "\n" + p.replace(" ", "  ") + "\t" + prose(4, 70), prose(6, 60) + " " + " ".join(p.split()[:49]) + " " + prose(8, 60)]
    df = docs(spark, texts)
    out = substring_dedup.repeated_bytes(df).persist()
    assert {r.doc_id: (r.n_removed, r.n_repeated_words) for r in out.collect()} == {0: (0, 51), 1: (0, 51), 2: (0, 0)}
    _check(out, df, 400)


def test_long_texts_go_piece_by_piece(monkeypatch):
    from lodestone.llm.common import word_hashes

    texts = [(" ".join(f"w{i}" for i in range(k))).encode() for k in (0, 3, 500, 1)] + [b"x" * 300, b" \n ", b"a b"]
    for most in (1, 7, 64, 1 << 22):
        got = word_hashes(texts, most)
        assert all((x == y).all() for x, y in zip(got, word_hashes(texts), strict=True))
    monkeypatch.setattr(substring_dedup, "PIECE", 70)
    pieces = substring_dedup.anchors(texts, 100)
    monkeypatch.setattr(substring_dedup, "PIECE", 1 << 19)
    for of_pieces, whole in zip(pieces, substring_dedup.anchors(texts, 100), strict=True):
        assert all((x == y).all() for x, y in zip(of_pieces, whole, strict=True))


def test_within_one_document(spark):
    p = prose(3, 100)
    df = docs(spark, [p + " between " + p, "other " + prose(9, 80)])
    _check(substring_dedup.repeated_bytes(df), df, 400)


def test_empty_table(spark):
    assert substring_dedup.repeated_bytes(docs(spark, [])).collect() == []


def test_deep_shallow_sort():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 90))) for _ in range(300)] + [b"a" * 80 + bytes([rng.randrange(256)]) for _ in range(200)] + [b"same"] * 5
    table, lengths = matrix(strings, 100)
    order, lcp = deep_shallow_sort(strings, table, lengths)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for a, b, n in zip(got, got[1:], lcp, strict=False):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert n == k
