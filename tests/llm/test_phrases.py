import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.fixtures import clashing, hard
from pyspark.sql import functions as F

from lodestone.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top, depth=5, percent=100):
    """The result for rows (lang, text), by dictionaries of all phrases."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, depth + 1):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inside = Counter()
    for p, a in candidates.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                q = (p[0], *p[i : i + m])
                inside[q] = max(inside[q], a)
    out = []
    for p, a in candidates.items():
        if 100 * inside[p] >= percent * a:
            continue
        lang, *words = p
        cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, rows = Counter(), []
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            rows.append((r[0], ranks[r[0]], *r[1:]))
    return sorted(rows)


def _check(df, source, **how):
    got = sorted(tuple(r) for r in df.select(COLUMNS).collect())
    assert got == brute([(r.lang, r.text) for r in source.collect()], **how)
    return got


def test_query(compare):
    compare(phrases.op13_phrases, phrases.OP13_SQL, "/root/testdata/sf0.01")


def test_query_against_brute_force(spark):
    assert _check(phrases.op13_phrases(spark, "/root/testdata/sf0.001"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), least=100, top=2000)


def _corpus(spark, seed, n=150):
    rng, rows = random.Random(seed), []
    fixed = ["in the end of it all", "New York City", "a b c d e f g", "to be, or not to be", "the the the the the the"]
    for _ in range(n):
        words = [rng.choice(["x", "y", "z", "w", "\tq"]) if rng.random() < 0.6 else rng.choice(fixed) for _ in range(rng.randrange(0, 40))]
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", ". ", "\n"]).join(words)))
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.mark.parametrize(("least", "top", "windows", "piece"), [(5, 2000, 1 << 19, 1 << 22), (3, 7, 64, 50), (1, 40, 1000, 7)])
def test_small_corpora(spark, monkeypatch, least, top, windows, piece):
    """Shards of few windows, texts cut anywhere."""
    monkeypatch.setattr(phrases, "WINDOWS", windows)
    monkeypatch.setattr(phrases, "PIECE", piece)
    df = _corpus(spark, least)
    assert _check(phrases.collocations(clashing(df), least=least, top=top), df, least=least, top=top)


def test_other_depth_and_share(spark):
    df = _corpus(spark, 9)
    _check(phrases.collocations(df, least=4, depth=3, percent=80), df, least=4, top=2000, depth=3, percent=80)


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_nulls_ties_long_texts(spark, wrap):
    _check(phrases.collocations(wrap(hard(spark)), least=2), hard(spark), least=2, top=2000)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", " . ")], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits; the whole number below the quotient is exact."""
    a, n, l1, r = 3_000_000_007, 900_000_000_000_000_011, 3_000_000_019, 5_000_000_029
    df = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("total"), F.lit(l1).alias("l"), F.lit(r).alias("r"))
    got = df.select(F.expr("(1000 * CAST(a AS DECIMAL(38, 0)) * total) DIV (CAST(l AS DECIMAL(38, 0)) * r)")).first()[0]
    assert got == 1000 * a * n // (l1 * r)


def test_merged_tries_are_the_trie_of_all_windows():
    rng = np.random.default_rng(8)
    windows, depth = rng.integers(1, 6, (3000, 5)).astype(np.uint64), rng.integers(2, 6, 3000)
    whole = phrases.Trie.of_windows(windows, depth)
    slices = {}
    for i in range(0, 3000, 250):
        for r, levels in phrases.Trie.of_windows(windows[i : i + 250], depth[i : i + 250]).serialised(8):
            slices.setdefault(r, []).append(levels)
    rows = lambda t: sorted((tuple(s), n, tuple(x)) for b in t.frequent(1) for s, n, x in zip(*[c.to_pylist() for c in b.columns], strict=True))
    assert sorted(x for r in slices for x in rows(phrases.Trie.merged(slices[r]))) == rows(whole)
    assert len(slices) > 3
