import itertools
import re
import zlib

import numpy as np
from llm.fixtures import clashing, docs, hard
from pyspark.sql import functions as F

from lodestone.llm import quality

SF = "/root/testdata/sf0.1"


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    out = quality.op5_quality(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(out) == table.count()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    known = out[out.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert _auc(known.score.to_numpy(), known.quality.to_numpy()) > 0.95
    assert (known.predicted == known.quality).mean() > 0.85
    # calibrated: the mean score of a group is near its share of ones
    assert abs(known.score.mean() - known.quality.mean()) < 0.1


def test_other_columns_are_no_inputs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(df, labels)
    changed = df.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": -F.col("doc_id")})
    a = {r.doc_id: r.score for r in quality.score_quality(df, model).collect()}
    b = {-r.doc_id: r.score for r in quality.score_quality(changed, model).collect()}
    assert a == b
    # labels of held-out rows are no inputs either
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    c = {r.doc_id: r.score for r in quality.score_quality(df, quality.fit_quality(df, flipped)).collect()}
    assert max(abs(a[k] - c[k]) for k in a) < 1e-6


def test_nulls_long_texts_clashing_columns(spark):
    df = clashing(hard(spark))
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 0), (8, 0, 0), (1, None, None), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(df, quality.fit_quality(df, labels))
    assert set(out.columns) == set(df.columns)
    assert all(r.score is not None and 0 <= r.score <= 1 for r in out.collect()) and out.count() == df.count()


def test_empty_tables_and_one_class(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, ["a b c", "", None])
    model = quality.fit_quality(df, labels)
    assert len({r.score for r in quality.score_quality(df, model).collect()}) == 1
    assert quality.score_quality(docs(spark, []), quality.fit_quality(docs(spark, []), labels)).collect() == []


def test_vectors_pooling_and_network_as_brute_force(spark):
    """Context vectors, features and scores word by word; one broadcast model scores what the formula says."""
    texts = ["The cat sat on the mat the the end", "Rain falls 123 times a day, RAIN falls", "", None, "one", " \t\n ", "the cat été 中文 the dog's 9,000 the"]
    bucket = lambda w: int(quality.word_hashes([w])[0][0] % np.uint64(quality.BUCKETS))
    split = [[bytes(w) for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w] for t in texts]
    sums = np.zeros((quality.BUCKETS, quality.DIM))
    for words in split:
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    sums[bucket(w.lower())] += quality._INDEX[bucket(words[j].lower())]
    vectors = sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-9)
    df = docs(spark, texts)
    assert np.allclose(quality.context_vectors(df), vectors, atol=1e-6)

    want = np.zeros((len(texts), 2 * quality.DIM + quality.SHAPE_DIM + 2))
    for k, words in enumerate(split):
        if words:
            v = np.array([vectors[bucket(w.lower())] for w in words])
            shape = lambda w: "".join(c for c, _ in itertools.groupby(chr(b) for b in w.translate(quality._CLASS)))
            s = np.array([quality._SHAPES[quality.word_hashes([shape(w).encode()])[0][0] % np.uint64(1024)] for w in words])
            again = sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False)) / len(words)
            want[k] = np.concatenate([v.mean(0), v.std(0), s.mean(0), [again, np.log1p(len(words)) / 10]])
    assert np.allclose(quality.features(texts, vectors.astype(np.float32)), want, atol=1e-3)

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, labels)
    w1, b1, w2, b2 = model.layers
    got = {r.doc_id: r.score for r in quality.score_quality(df, model).collect()}
    for k in range(len(texts)):
        hidden = [max(0.0, float(b1[h] + sum((quality.features([texts[k]], model.vectors)[0] - model.centre) / model.scale * w1[:, h]))) for h in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]
        assert abs(got[k] - 1 / (1 + np.exp(-logit / model.temperature))) < 1e-6


def test_training_separates_and_calibrates():
    """Against labels drawn from a known chance: near the best possible loss, at the temperature that is best on the held fifth."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    chance = 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))
    y = (rng.random(3000) < chance).astype(float)
    model = quality.train(x, y, np.zeros((1, 1)))
    fresh = rng.normal(size=(2000, 5))
    truth = 1 / (1 + np.exp(-2 * fresh[:, 0] + fresh[:, 1]))
    assert np.abs(model.scores(fresh) - truth).mean() < 0.08
    held = np.random.default_rng(3)
    held.normal(size=(5, 32)), held.normal(size=32)
    i = held.permutation(3000)[:600]
    out = model.logits(x[i])
    loss = [np.mean(np.logaddexp(0, out / t) - y[i] * out / t) for t in np.geomspace(0.25, 8, 101)]
    assert np.isclose(model.temperature, np.geomspace(0.25, 8, 101)[int(np.argmin(loss))])
