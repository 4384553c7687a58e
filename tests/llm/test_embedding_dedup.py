import random

import numpy as np
from hitflow.llm import embedding_dedup, registry
from hitflow.llm.embedding_dedup import brute_force, near_vectors


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def fixture(seed, n=260, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = [base[rng.integers(12)] * rng.uniform(0.1, 9) + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.15, 0.3, 0.6]) for _ in range(n)]
    rows += [base[0] + rng.normal(size=dim) * 0.01 for _ in range(150)]
    rows = [[float(x) for x in r] for r in rows]
    rows += [rows[3], rows[3], rows[-1], None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [None] + [1.0] * (dim - 1), [1e300] * dim]
    random.Random(seed).shuffle(rows)
    return list(enumerate(rows))


def test_matches_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = fixture(seed)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert result(near_vectors(df)) == brute_force([(k, v) for k, v in rows])
    monkeypatch.setattr(embedding_dedup, "LEAST_BLOCK", 24)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 24)
    assert result(near_vectors(df, sample=100)) == brute_force([(k, v) for k, v in rows])


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 6), (None, [1.0, 0.0], 7), (2, [1.0], 8), (3, [], 9), (4, [2.0, 0.1], 1)], "vec_id long, embedding array<float>, rep int")
    got = sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 1, False)]))
    assert near_vectors(df.where("false")).collect() == []
    assert near_vectors(df.where("vec_id = 3")).collect()[0].n_links == 0


def test_query_matches_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(registry.op3_embedding_dedup(spark, sf)) == brute_force(rows)


def test_shared_ids_and_lengths(spark):
    rng = np.random.default_rng(5)
    long, short = rng.normal(size=(40, 16)), rng.normal(size=(30, 8))
    rows = [(i % 300, [float(x) for x in long[i % 40] + rng.normal(size=16) * 0.05]) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in short[i % 30] + rng.normal(size=8) * 0.05]) for i in range(300)] + [(2000, [1.0, 0.0, 0.0]), (2001, [1.0, 0.001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    want = brute_force(list(enumerate(v for _, v in rows)))
    ids = [k for k, _ in rows]
    least = {}
    for at, (_, c) in want.items():
        least[c] = min(least.get(c, ids[at]), ids[at])
    assert got == sorted((ids[at], n, least[c]) for at, (n, c) in want.items())
    assert got[-1] == (2001, 1, 2000)


def test_leaves_split_further(spark, monkeypatch):
    rng = np.random.default_rng(8)
    spots = rng.normal(size=(6, 12))
    finer = spots[rng.integers(6, size=60)] + rng.normal(size=(60, 12)) * 0.25
    rows = [[float(x) for x in finer[i % 60] * rng.uniform(0.5, 2) + rng.normal(size=12) * (0.02 if i % 3 else 0.1)] for i in range(900)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    exact = [(k, np.array(v, np.float32).astype(float).tolist()) for k, v in enumerate(rows)]
    for name, value in (("BLOCK", 32), ("LEAST_BLOCK", 32), ("MOST_CELLS", 4), ("LEAST_CELLS", 4), ("SUB_CELLS", 3)):
        monkeypatch.setattr(embedding_dedup, name, value)
    seen = []
    monkeypatch.setattr(embedding_dedup, "_small", lambda d, n: seen.append(n) or d)
    assert result(near_vectors(df, sample=64)) == brute_force(exact)
    assert len(seen) > 6  # more than one round of subtrees


def test_a_third_of_all_rows_null_or_equal(spark):
    rng = np.random.default_rng(9)
    rows = [(i, None if i % 3 == 0 else [1.0, 2.0, 3.0] if i % 3 == 1 else rng.normal(size=3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as w", "'x' as h1")
    assert result(near_vectors(df)) == brute_force(rows)
