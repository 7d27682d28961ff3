"""Exact top-k search: a Voronoi kNN join.

Data are grouped by their nearest pivot. A group's summary is its number of vectors and its radius,
the largest distance to the pivot. For query q, group c with pivot p and radius r holds scores within
q.p +- |q| r. The k-th best score of q is at least the threshold that the lower bounds and counts of
groups give, and is raised by a search of the group with the best bound. Only groups whose upper
bound reaches the threshold get a copy of q. Groups are split into blocks, so none is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

#: Data in a block of a cell, and queries that meet a block in one group.
BLOCK, QUERIES = 4096, 16_384


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (array<double> of floor(scale * x)), without null ids, null vectors and those with null or non-finite components."""
    doubles = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows padded with zeros to dim."""
    if not len(column):
        return np.zeros((0, dim))
    if all(len(v) == dim for v in column):
        return np.vstack(column.to_numpy())
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def pick_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of a bounded sample; the method is right with any pivots."""
    rng = np.random.default_rng(1)
    centres = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        near = ((sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(0)
    return centres


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floats while they are exact, else Python integers."""
    top = (np.abs(q).max(initial=0) + 1) * (np.abs(x).max(initial=0) + 1) * max(q.shape[1], 1)
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(y) for y in r] for r in m], object).reshape(m.shape)
    return (big(q) @ big(x).T).astype(np.int64)


def voronoi_topk(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, n_pivots: int | None = None, sample_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): each query's k highest inner products among all other rows.

    is_query is a condition on rows. Ties go to the smaller id; with fewer candidates, all. A query's own
    row is the one with its id, so rows that repeat its id are no candidates either; repeated rows of another id
    are candidates each. Rows with a null id, and vectors null or with null or non-finite components, take no part; shorter ones are padded with zeros.
    Pivots, one for each BLOCK rows by default, 64 to 1024 of them, come from at most sample_rows rows; scores must fit in 64 bits.
    """
    spark = rows.sparkSession
    data = stored(integer_vectors(rows.select(F.col(id_col).alias("_ls_id"), F.col(vec_col).alias("_ls_v")), "_ls_id", "_ls_v", scale), "vectors")
    result = "query_id long, rank int, vec_id long, score long"
    n, dim = data.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], result)
    dim = max(dim, 1)
    sample = data.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    n_pivots = n_pivots or min(max(64, n // BLOCK), 1024)
    pivots = pick_pivots(_matrix(sample.v, dim), min(n_pivots, len(sample)))
    shared = spark.sparkContext.broadcast(pivots)  # n_pivots vectors

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for f in frames:
            x = _matrix(f.v, dim)
            d2 = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
            c = d2.argmin(1)
            yield pd.DataFrame({"id": f.id, "v": f.v, "cell": c.astype(np.int32), "r": np.sqrt(((x - p[c]) ** 2).sum(1))})

    cells = stored(data.mapInPandas(assign, "id long, v array<double>, cell int, r double"), "cells")
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max(F.struct("r", "id")).alias("far")).toPandas()  # n_pivots rows
    cell_ids, counts, radii = summary.cell.to_numpy(), summary.n.to_numpy(), summary.r.to_numpy() * (1 + 1e-9) + 1e-6
    blocks = dict(zip(cell_ids.tolist(), (-(-counts // BLOCK)).tolist(), strict=True))
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for c in blocks.items() for x in c]), F.col("cell"))
    data_blocks = cells.withColumn("block", F.pmod(F.xxhash64("id", "v"), n_blocks).cast("int"))
    queries = data.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid, slack = x @ shared.value[cell_ids].T, np.sqrt((x**2).sum(1))[:, None] * radii
        return mid - slack, mid + slack

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with its threshold by counts, to all blocks of the group with the highest upper bound."""
        for f in frames:
            low, high = bounds(_matrix(f.v, dim))
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(counts[order], axis=1) >= k + 1  # one may be the query itself
            at = np.where(enough.any(1), enough.argmax(1), -1)
            floor = np.where(at >= 0, np.take_along_axis(low, np.take_along_axis(order, np.maximum(at, 0)[:, None], 1), 1)[:, 0], -np.inf)
            best = cell_ids[high.argmax(1)]
            out = pd.DataFrame({"id": f.id, "v": f.v, "cell": best, "floor": np.floor(floor)})
            yield out.loc[out.index.repeat([blocks[c] for c in best])].assign(block=[b for c in best for b in range(blocks[c])])[["id", "v", "cell", "block", "floor"]]

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query to the blocks of every other group that its threshold doesn't rule out."""
        for f in frames:
            _, high = bounds(_matrix(f.v, dim))
            take = (high >= f.floor.to_numpy()[:, None]) & (cell_ids[None, :] != f.home.to_numpy()[:, None])
            rows_, cols = np.nonzero(take)
            reps = np.array([blocks[c] for c in cell_ids[cols].tolist()], dtype=np.int64)
            r, c = np.repeat(rows_, reps), np.repeat(cell_ids[cols], reps)
            b = np.arange(len(r)) - np.repeat(np.cumsum(reps) - reps, reps)
            g = f.iloc[r]
            yield pd.DataFrame({"id": g.id.to_numpy(), "v": g.v.to_numpy(), "cell": c.astype(np.int32), "block": b.astype(np.int32), "floor": g.floor.to_numpy()})

    def solve(queries_of: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries_of) and len(members):
            ids, x = members.id.to_numpy(), _matrix(members.v, dim)
            for at in range(0, len(queries_of), 512):
                part = queries_of.iloc[at : at + 512]
                s = _scores(_matrix(part.v, dim), x)
                for q, floor, line in zip(part.id.to_numpy(), part.floor.to_numpy(), s, strict=True):
                    ok = np.flatnonzero((ids != q) & (line >= floor))
                    best = ok[_best(line[ok], ids[ok], k)]
                    out += [(q, int(ids[i]), int(line[i])) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def met(asking: DataFrame) -> DataFrame:
        """The solutions of queries (with cell and block) among their blocks. Where many queries ask for a group, they are parted and its blocks copied for each part."""
        asked = asking.groupBy("cell").count().collect()  # n_pivots rows
        parts = {r["cell"]: p for r in asked if (p := -(-r["count"] // (blocks[r["cell"]] * QUERIES))) > 1}
        n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in parts.items() for x in c]), F.col("cell")), F.lit(1)) if parts else F.lit(1)
        own = asking.withColumn("part", F.pmod(F.xxhash64("id"), n).cast("int"))
        members = data_blocks.select("id", "v", "cell", "block", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
        key = ["cell", "block", "part"]
        return own.groupBy(*key).cogroup(members.groupBy(*key)).applyInPandas(solve, local)

    kinds = "id long, v array<double>, cell int, block int, floor double"
    local = "query_id long, vec_id long, score long"
    first = queries.mapInPandas(home, kinds)
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = stored(met(first), "home-scores")
    raised = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    homes = first.groupBy("id").agg(F.first("v").alias("v"), F.first("cell").alias("home"), F.first("floor").alias("floor"))
    again = homes.join(raised, "id", "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", F.lit(float("-inf")))))
    others = again.select("id", "v", "home", "floor").mapInPandas(rest, kinds)
    ranked = found.unionByName(met(others)).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    """Five neighbours of every fiftieth vector. Null and non-finite vectors take no part; see voronoi_topk() for repeated rows and ties."""
    return voronoi_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


OP10_SQL = """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM d q JOIN d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
