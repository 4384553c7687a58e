import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hitflow.llm import registry, vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """Integers, loops and no filter."""
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = parts * max(1, -(-max((len(v) for _, v, _ in rows), default=0) // parts))
    ints = [[math.floor(4096 * x) if abs(x) < 1e15 else int(x) * 4096 for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    own = width // parts
    cut = [[v[p * own : (p + 1) * own] for p in range(parts)] for v in ints]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda k: (far(v[p], books[p][k]), k)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                if mine := [v[p] for v, c in zip(cut, codes, strict=True) if c[p] == k]:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    codes = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes, strict=True)]
    by = {}
    for (_, _, lab), e in zip(rows, errors, strict=True):
        by[lab] = by.get(lab, 0) + min(e, vector_codes.MOST)
    cap = lambda e: min(e, vector_codes.MOST)
    return sorted((str(i), "".join(f"{k:02x}" for k in c), cap(e), cap(by[lab]), sha) for (i, _, lab), c, e in zip(rows, codes, errors, strict=True))


def found(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_query_matches_plain_integers(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(registry.op12_vector_codes(spark, sf)) == plain(rows)


@pytest.mark.parametrize("size", [8, 64, 13])
def test_ties_repeats_nulls_and_lengths(spark, size):
    rng = random.Random(size)
    rows = [(i // 2, [rng.choice((-0.5, 0.25, 0.0, 1.0)) for _ in range(size)], rng.choice((None, 1, 2))) for i in range(120)]
    rows += rows[:9] + [(None, [0.5] * size, None), (900, None, 1), (901, [float("nan")] * size, 1), (902, [None] + [1.0] * (size - 1), 1), (903, [float("inf")] * size, 2), (904, [1.0, -1.0], 3), (905, [], 3)]
    df = frame(spark, rows).withColumnRenamed("label", "label").selectExpr("*", "'x' as id", "1 as vector", "2 as code", "3 as n")
    assert found(vector_codes.compress(df)) == plain(rows)


def test_components_beyond_64_bits(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((1e30, -3e25, 1e-30, 5.5, 2e17, -7e4)) for _ in range(16)], i % 2) for i in range(40)]
    assert found(vector_codes.compress(frame(spark, rows))) == plain(rows)


def test_small_and_empty_tables(spark):
    few = [(1, [1.0] * 16, 1), (2, [0.0] * 16, 1), (3, None, 1)]
    assert found(vector_codes.compress(frame(spark, few))) == plain(few)
    assert found(vector_codes.compress(frame(spark, []))) == []
    assert found(vector_codes.compress(frame(spark, few).where("vec_id = 3"))) == []


def test_filter_leaves_few_entries_and_never_the_nearest():
    rng = np.random.default_rng(4)
    for scale in (3, 100, 1 << 20):
        x, book = rng.integers(-scale, scale, (400, 8)), rng.integers(-scale, scale, (16, 8))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        got, far = vector_codes.nearest(x, book)
        assert (got == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    assert vector_codes.integers(pa.array([[-0.0001, 1.0], [2.5]], pa.list_(pa.float64())), 2).tolist() == [[-1, 4096], [10240, 0]]


def test_a_label_of_most_rows(spark):
    rows = [(i, [float(i % 7)] * 8, None if i % 3 else i) for i in range(30)]
    from hitflow.llm.frames import join_by_key, saved

    df = frame(spark, rows)
    table = saved(df.groupBy("label").count().withColumnRenamed("count", "n"))
    assert join_by_key(df, table, ["label"], hot=3).count() == 30
    assert found(vector_codes.compress(df)) == plain(rows)
