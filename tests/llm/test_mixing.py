import math
from collections import Counter, defaultdict

import pytest
from llm.fixtures import clashing, docs, hard, prose

from lodestone.llm import mixing


def test_query(compare):
    compare(mixing.op8_mix_sources, mixing.OP8_SQL)
    compare(mixing.op8_mix_sources, mixing.OP8_SQL, "/root/testdata/sf0.01")


def _sources(spark):
    return docs(spark, [(i, prose(i, 20 + i % 30), ["big", "big", "big", "big", "big", "mid", "mid", "small"][i % 8]) for i in range(400)])


def test_entropy_is_met_within_the_budget(spark):
    df = _sources(spark)
    out = mixing.mix_sources(df, target_entropy=0.97).collect()
    tokens = Counter()
    for r in out:
        tokens[r.source] += r.mix_tokens
    total = sum(tokens.values())
    entropy = -sum(v / total * math.log(v / total) for v in tokens.values()) / math.log(3)
    assert abs(entropy - 0.97) < 0.01
    whole = sum(len(r.text.split()) + 1 for r in df.collect())
    assert whole * 0.97 <= total <= whole


@pytest.mark.parametrize("limit", [1.0, 1.5, 3.0, 100.0])
def test_repetition_limit_keeps_every_document(spark, limit):
    """Every document is there once at least, and a source's epochs are whole permutations but for the last."""
    df = _sources(spark)
    out = mixing.mix_sources(df, repetition_limit=limit).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in df.collect()}
    by = defaultdict(lambda: defaultdict(set))
    for r in out:
        assert r.doc_id not in by[r.source][r.mix_epoch]
        by[r.source][r.mix_epoch].add(r.doc_id)
    for epochs in by.values():
        assert all(epochs[e] == epochs[0] for e in range(max(epochs)))
        assert len(epochs) <= math.ceil(limit) + 1
    keys = [(r.source, r.mix_epoch, r.mix_key) for r in out]
    assert len(set(keys)) == len(keys)


def test_nulls_ties_clashing_columns(spark):
    for wrap in (lambda d: d, clashing):
        out = mixing.mix_sources(wrap(hard(spark)), repetition_limit=1.5)
        assert Counter(r.doc_id for r in out.where("mix_epoch = 0").collect()) == Counter(r.doc_id for r in hard(spark).collect())
    own = clashing(docs(spark, ["a"]))
    assert mixing.mix_sources(own, repetition_limit=1.0).first()["s"] == "own s"


def test_empty_table_and_arguments(spark):
    assert mixing.mix_sources(docs(spark, []), target_entropy=0.9).collect() == []
    with pytest.raises(ValueError, match="give"):
        mixing.mix_sources(docs(spark, []))
