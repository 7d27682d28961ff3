"""The pipeline's stages, each against a brute-force version on its own input."""

import corpus_pipeline
from llm.fixtures import clashing, docs, hard, prose
from llm.test_exact_dedup import LOWER
from llm.test_near_dedup import _edited, brute
from llm.test_tokens import expected

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        held.append([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    held.append([tuple(r) for r in docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()])
    whole, good, single, apart, mixed, encoded = held

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in good}
    assert kept < {r[0] for r in whole}
    clean = [i for i, q in labels.items() if q == 1]
    junk = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i not in kept for i in junk) >= 0.8 * len(junk)

    last = {}
    for i, text, _ in good:
        key = (text or "").translate(LOWER)
        last[key] = max(last.get(key, i), i)
    assert {r[0] for r in single} == set(last.values())

    assert {r[0] for r in apart} == {r[0] for r in brute([(i, t) for i, t, _ in single], 80) if r[3]}

    assert {r[0] for r in mixed} == {r[0] for r in apart} and len(mixed) >= len(apart)

    assert sorted(encoded) == sorted((i, n, a, b) for i, _, n, a, b in expected([(i, t) for i, t, _ in mixed]))


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert rows.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_hard_tables(spark):
    """Nulls, repeated rows and clashing columns pass through each stage."""
    for df in (hard(spark), clashing(hard(spark)), hard(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= 3 * max(df.count(), 1), name
            if name != "bpe":
                assert out.columns == df.columns, name


def test_near_links_at_80_percent(spark):
    """Pairs of similarity 0.80 exactly, with signatures 22 to 24 symbols apart, lose their second document."""
    seeds = (234, 351, 709, 1149)
    df = docs(spark, [t for k in seeds for t in (prose(k, 139), _edited(prose(k, 139), 3, k))])
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, df, SF).collect()) == [0, 2, 4, 6]
