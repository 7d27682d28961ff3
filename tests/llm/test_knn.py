import numpy as np
import pytest

from lodestone.llm import knn


def brute(rows, k, is_query):
    """rows: (id, vector)."""
    fine = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if is_query(i)}):
        own = next(v for i, v in fine if i == q)
        scored = sorted((-int(own @ v), i) for i, v in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def _check(spark, rows, k=5, every=10, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int") if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = knn.voronoi_topk(df, lambda i: i % every == 0, k=k, **more)
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == brute(plain, k, lambda i: i % every == 0)


def test_query(compare):
    compare(knn.op10_voronoi_knn, knn.OP10_SQL)
    compare(knn.op10_voronoi_knn, knn.OP10_SQL, "/root/testdata/sf0.01")


@pytest.mark.parametrize(("pivots", "sample"), [(1, 10), (4, 50), (64, 4096)])
def test_clusters_and_ties(spark, pivots, sample):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # equal vectors: ties go to smaller ids
    _check(spark, rows, n_pivots=pivots, sample_rows=sample)


def test_nulls_and_non_finite(spark):
    good = [0.5, -1.0]
    rows = [(0, good), (10, [float("nan"), 1.0]), (20, None), (30, [float("inf"), 0.0]), (None, good), (1, [None, 1.0]), (2, [0.25, 0.0]), (3, [-0.1, 3.0]), (40, [0.0, 0.0])]
    _check(spark, rows)


def test_clashing_columns_and_repeated_rows(spark):
    """Columns with the names of helpers; queries and candidates that are there twice."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    df = spark.createDataFrame([*rows, rows[10], rows[11]], "vec_id long, embedding array<float>").withColumns({c: F.lit(f"own {c}") for c in ("id", "v", "cell", "r", "block", "floor", "rank", "score", "query_id")})
    got = sorted(map(tuple, knn.voronoi_topk(df, lambda i: i % 10 == 0, n_pivots=3).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute([*rows, rows[11]], 5, lambda i: i % 10 == 0)


def test_pivots_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 3)
    rng = np.random.default_rng(9)
    _check(spark, [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(400)])


def test_fewer_candidates_than_k_and_empty(spark):
    _check(spark, [(0, [1.0]), (1, [2.0])])
    _check(spark, [(0, [1.0])])
    _check(spark, [])


def test_large_values_stay_exact(spark):
    _check(spark, [(i, [3.0e5 + i, -2.0e5, 7.1e4 * i]) for i in range(30)])


def test_many_queries_of_one_cell_are_parted(spark, monkeypatch):
    """No group holds more than some queries, and the neighbours stay the same."""
    monkeypatch.setattr(knn, "QUERIES", 20)
    monkeypatch.setattr(knn, "BLOCK", 50)
    rng = np.random.default_rng(12)
    rows = [(i, (np.ones(6) + rng.normal(size=6) * 0.01).astype(np.float32).tolist()) for i in range(500)]
    _check(spark, rows, every=2, n_pivots=1, sample_rows=10)
    _check(spark, rows, every=1, n_pivots=3, sample_rows=30)
