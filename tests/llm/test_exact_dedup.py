import hashlib
from collections import defaultdict

import pytest
from llm.fixtures import clashing, docs, hard

from lodestone.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _check(out, source):
    groups = defaultdict(list)
    sha = lambda t: hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
    for r in source.collect():
        groups[sha(r.text)].append(r.doc_id)
    got = defaultdict(list)
    for r in out.collect():
        got[r.text_sha256].append(r)
    assert set(got) == set(groups)
    for k, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted((r.doc_id for r in got[k]), key=str) == sorted(ids, key=str)
        assert all(r.keep_id == keep and r.group_size == len(ids) for r in got[k])
        stays = [r.doc_id for r in got[k] if r.kept]
        assert stays == [keep]


def test_query(compare):
    compare(exact_dedup.op2_exact_dedup, exact_dedup.OP2_SQL)
    compare(exact_dedup.op2_exact_dedup, exact_dedup.OP2_SQL, "/root/testdata/sf0.01")


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_nulls_ties_repeated_rows(spark, wrap):
    df = hard(spark)
    _check(exact_dedup.exact_dedup(wrap(df)), df)


def test_hot_group_and_full_filter(spark):
    df = docs(spark, ["the same"] * 900 + [f"text {i // 2}" for i in range(900)])
    _check(exact_dedup.exact_dedup(df), df)


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def test_other_columns_stay(spark):
    row = exact_dedup.exact_dedup(docs(spark, [(1, "a", "web"), (2, "A", "books")])).where("kept").first()
    assert (row.doc_id, row.source, row.lang) == (2, "books", "en")
