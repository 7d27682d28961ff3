"""Token counts, BPE encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
from llm.fixtures import clashing, docs, hard, prose

from lodestone.llm import bpe, token_counts
from lodestone.llm.tokenizers_io import default_path, load

PARTS = ["a", "B", "é", "É", "İ", "ß", "ſ", "K", "'s", "'T", "don't", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", "<|", "|>", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "​", "　", "1", "½", "²", "٣", "中", "文", "é", "́", "...", "🙂", "ǅ", "ΑΣ", "\x00", "\xad", "ª", "_", "'ll", "ŉ", "×"]


def _random(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(PARTS) for _ in range(n))


def expected(rows):
    t, out = load(default_path()), []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, len((text or "").encode()), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _check_counts(out, source):
    assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == sorted(((i, b, n, n > 2048) for i, b, n, *_ in expected(_pairs(source))), key=str)


def _check_bpe(out, source):
    assert sorted(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == sorted(((i, n, a, b) for i, _, n, a, b in expected(_pairs(source))), key=str)


def test_queries(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _check_counts(token_counts.op6_token_counts(spark, "/root/testdata/sf0.01"), source)
    _check_bpe(bpe.op9_bpe(spark, "/root/testdata/sf0.01"), source)


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_nulls_long_texts_odd_characters(spark, wrap):
    df = hard(spark).unionByName(docs(spark, [(100 + i, _random(i, 60)) for i in range(60)]))
    _check_counts(token_counts.token_counts(wrap(df)), df)
    _check_bpe(bpe.digests(wrap(df)), df)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (97, 8), (300, 40)])
def test_huge_texts_are_spliced(spark, chunk, overlap):
    """Chunks far smaller than the texts; some have no white space for longer than an overlap or a chunk."""
    texts = [prose(i, 300) for i in range(10)] + ["x" * 500 + " y " + "z" * 900, "ab" * 3000, _random(5, 2000), "don't" * 300 + " end", " " * 700, "a " * 900]
    df = docs(spark, texts)
    _check_counts(token_counts.token_counts(df, chunk=chunk, overlap=overlap), df)


@pytest.mark.parametrize("table_bytes", [0, 3000])
def test_words_beyond_the_broadcast_come_back_by_a_join(spark, table_bytes):
    df = hard(spark).unionByName(docs(spark, [(100 + i, _random(i, 60) + " " + prose(i, 50)) for i in range(40)]))
    _check_bpe(bpe.digests(df, table_bytes=table_bytes), df)


def test_decode_joins_pieces(spark):
    df = docs(spark, ["Hello there, world", "", None, "<|endoftext|> x"])
    t = load(default_path())
    for r in bpe.bpe_decode(bpe.bpe_encode(df)).collect():
        assert r.text == t.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)
    odd = spark.createDataFrame([(1, None), (2, np.array([320, 10**6], "<u4").tobytes())], "doc_id long, ids binary")
    assert [r.text for r in bpe.bpe_decode(odd).orderBy("doc_id").collect()] == [None, t.decode([320], skip_special_tokens=False)]


def test_empty_table(spark):
    assert token_counts.token_counts(docs(spark, [])).collect() == []
    assert bpe.digests(docs(spark, [])).collect() == []


def test_words_encode_as_the_whole_text():
    t = load(default_path())
    for seed in range(3000):
        text = _random(seed, 12)
        assert [i for w in bpe.words_of(text) for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


def test_texts_without_white_space():
    """Letters, digits, punctuation, one word, marks: the library's counts, and few characters encoded more than twice."""
    tokenizer, rng = load(default_path()), random.Random(4)
    texts = ["".join(rng.choice("中文字。，漢") for _ in range(60_000)), "".join(rng.choice("abc019.,-_") for _ in range(60_000)), "".join(rng.choice("abcdefgh") for _ in range(60_000)), "7" * 30_000, "é" * 30_000, "don't" * 20_000, "x" * 200_000]
    for text in texts:
        seen = [0]

        class Counted:
            def encode(self, part, seen=seen, **how):
                seen[0] += len(part)
                return tokenizer.encode(part, **how)

        assert token_counts.count_huge(Counted(), text, 1 << 12, 256) == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert seen[0] < 5 * len(text)


def test_splices_of_odd_strings():
    """Chunks of a few characters, cut between contractions, special strings, marks, digits and punctuation."""
    tokenizer, rng = load(default_path()), random.Random(11)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(20, 120)))
        assert token_counts.count_huge(tokenizer, text, rng.choice([16, 24, 40]), rng.choice([4, 8, 16])) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("table_bytes", [0, 3000])
def test_texts_with_rare_words_are_read_once_more_only(spark, monkeypatch, table_bytes):
    """Beyond the broadcast table, no text is stored, joined or split again: only the words table is stored, and the plan has no join."""
    df = hard(spark).unionByName(docs(spark, [(100 + i, _random(i, 60) + " " + prose(i, 50)) for i in range(40)]))
    names, stored = [], bpe.stored
    monkeypatch.setattr(bpe, "stored", lambda table, name, *more: (names.append(name), stored(table, name, *more))[1])
    out = bpe.bpe_encode(df, table_bytes=table_bytes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert names == ["words"] and "Join" not in plan and plan.count("MapInArrow") == 1


def test_words_of_one_key_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "key_of", lambda word: len(word))
    words = ["é", "b", "ab", "cd", "xyz"]
    letters, ids = [w.encode() for w in words], [[1], [2, 70000], [], [4], [5, 6]]
    table = bpe.Table(np.array([len(w) for w in words]).tobytes(), np.array([len(i) for i in ids]), np.array(sum(ids, []), "<u4").tobytes(), np.array([len(w) for w in letters]), b"".join(letters))
    assert [table.find(w) for w in words] == [np.array(i, "<u4").tobytes() for i in ids]
    assert [table.find(w) for w in ("a", "ef", "xyzz", "")] == [None] * 4


def test_a_worker_forgets_words_that_do_not_recur(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    words = sorted((f"w{i}" for i in range(40)), key=bpe.key_of)
    table = bpe.Table(np.array([bpe.key_of(w) for w in words]).tobytes(), np.ones(40, int), np.arange(40).astype("<u4").tobytes(), np.array([len(w) for w in words]), "".join(words).encode())
    known = bpe.Known(table, default_path())
    for w in words * 2:
        assert known[w] == np.array([words.index(w)], "<u4").tobytes() and known[words[0]] == bytes(4) and len(known) <= 4
    assert np.frombuffer(known["quite unknown"], "<u4").tolist() == load(default_path()).encode("quite unknown", add_special_tokens=False).ids
