"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Words are hashed into a fixed number of buckets. Each bucket has a sparse random index vector; its context
vector is the sum of the index vectors beside it, over all documents. A document's features are the mean
and spread of its words' context vectors, the mean random vector of its words' shapes, and how often a
word repeats the one before. The context vectors and the network have a fixed size, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import slices, stored, text_slices, word_hashes

BUCKETS, DIM, SHAPE_DIM, WINDOW = 1 << 14, 32, 16, 2
_rng = np.random.default_rng(7)
_INDEX = np.zeros((BUCKETS + 1, DIM), np.int32)  # the last row is for places without a word
for _k in range(4):
    _INDEX[np.arange(BUCKETS), _rng.integers(0, DIM, BUCKETS)] = _rng.choice([-1, 1], BUCKETS)
_SHAPES = _rng.normal(size=(1024, SHAPE_DIM)).astype(np.float32)
# lower-case letters and bytes beyond ASCII: a; capitals: A; digits: 0; others stay
_CLASS = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def _shape(text: bytes) -> bytes:
    """Each word's character classes, a run of one class as one byte; no word is lost."""
    x = np.frombuffer(text.translate(_CLASS), np.uint8)
    return x[np.concatenate([[True], x[1:] != x[:-1]])].tobytes() if len(x) else b""


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIM) unit vectors, from every word of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIM), np.int64)
        for batch in slices(batches):
            texts = [t.encode("utf-8", "surrogatepass").lower() for t in batch.column(0).to_pylist() if t]
            for a, b in text_slices(texts, 1 << 20):
                words, first = word_hashes(texts[a:b])
                if not len(words):
                    continue
                bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
                at = np.arange(len(words)) + np.repeat(np.arange(b - a) * WINDOW, np.diff(first)) + WINDOW
                line = np.full(at[-1] + 1 + WINDOW, BUCKETS, np.int64)  # empty places keep texts apart
                line[at] = bucket
                own = _INDEX[line]
                beside = np.zeros((len(line), DIM), np.int32)
                for k in range(1, WINDOW + 1):
                    beside[k:] += own[:-k]
                    beside[:-k] += own[k:]
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                total[bucket[order][starts]] += np.add.reduceat(beside[at[order]], starts, axis=0)
        used = np.flatnonzero(total.any(1))
        for at in range(0, len(used), 4096):
            part = used[at : at + 4096]
            flat = pa.array(total[part].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.FixedSizeListArray.from_arrays(flat, DIM).cast(pa.list_(pa.int64()))], ["bucket", "v"])

    parts = docs.select(F.col(text_col)).mapInArrow(count, "bucket int, v array<long>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)]).toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM), np.float32)
    values = np.stack([sums.column(f"v{i}").to_numpy() for i in range(DIM)], axis=1).astype(np.float64)
    out[sums.column("bucket").to_numpy()] = values / np.maximum(np.sqrt((values**2).sum(1, keepdims=True)), 1e-9)
    return out


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text; zeros for one without words."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), 2 * DIM + SHAPE_DIM + 2), np.float32)
    for a, b in text_slices(raw, 1 << 20):
        words, first = word_hashes([t.lower() for t in raw[a:b]])
        shapes, _ = word_hashes([_shape(t) for t in raw[a:b]])
        n = np.diff(first)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        pool = lambda x: np.add.reduceat(x, first[:-1][full], axis=0) / n[full, None]
        v = vectors[words % np.uint64(BUCKETS)]
        again = np.concatenate([[False], words[1:] == words[:-1]])
        again[first[:-1][full]] = False
        mean = pool(v)
        parts = [mean, np.sqrt(np.maximum(pool(v * v) - mean**2, 0)), pool(_SHAPES[shapes % np.uint64(1024)]), pool(again[:, None].astype(np.float32)), np.log1p(n[full, None]) / 10]
        out[a + full] = np.hstack(parts)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> Model:
    """A two-layer network by Adam; a fifth of the rows sets the temperature. Of one class, or no rows, a constant score."""
    rng = np.random.default_rng(seed)
    centre, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = (y.sum() + 1) / (len(y) + 2)
    layers = [rng.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), np.array([np.log(share / (1 - share))])]
    model = Model(vectors, centre, scale, layers, 1.0)
    if len(np.unique(y)) < 2:
        layers[2][:] = 0
        return model
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - centre) / scale
    m, s, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(epochs):
        for _ in range(0, len(fit), 128):
            i = fit[rng.integers(0, len(fit), 128)]
            h = np.maximum(z[i] @ layers[0] + layers[1], 0)
            err = (1 / (1 + np.exp(-(h @ layers[2] + layers[3][0]))) - y[i]) / len(i)
            back = np.outer(err, layers[2]) * (h > 0)
            grads = [z[i].T @ back + 1e-4 * layers[0], back.sum(0), h.T @ err + 1e-4 * layers[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                layers[k] -= 0.003 * (0.5 ** (3 * epoch / epochs)) * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    if len(held):
        out, want = model.logits(x[held]), y[held]
        loss = lambda t: np.mean(np.logaddexp(0, out / t) - want * out / t)
        model.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Learns labels.quality from texts, never from held-out rows; of more than max_rows labelled rows, those of the lowest hashes."""
    sc = docs.sparkSession.sparkContext
    vectors = context_vectors(docs)
    shared = sc.broadcast(vectors)
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labelled")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    pooled = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(pool, "doc_id long, quality int, x array<float>")
    one_each = pooled.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x"))
    got = one_each.toArrow().sort_by("doc_id")  # max_rows at most; Arrow buffers, so that the driver makes no object for each number
    shared.destroy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, 2 * DIM + SHAPE_DIM + 2).astype(np.float64)
    return train(x, (got.column("quality").to_numpy() > 0).astype(np.float64), vectors)


def score_quality(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """docs, every row and column, with score (label 1's probability) and predicted; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = shared.value.scores(features(batch.column(at).to_pylist(), shared.value.vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every row of `documents`; a null or empty text has a score too. Repeated labels count once, the greatest."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
