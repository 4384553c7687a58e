"""Live clusters against those of the batch and a direct model."""

import random

import pytest
from hitflow.streaming import OpenFootprints, join_fragments, stream_clusters, stream_fragments
from pyspark.sql import functions as F

from test_clustering import footprints

SCHEMA = "x_pix int, y_pix int, time_ns double, tot int, chip string"


def live(spark, path, batches, make):
    """All rows that a stream of these batches (each a file, in order) gives, and the largest state of any of its steps."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    q = make(stream).writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "c")).outputMode("append").start()
    q.processAllAvailable()
    state = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    return spark.read.parquet(str(path / "out")), state


def shuffled(rows, n, late):
    """Rows in n batches, none more than `late` behind the latest."""
    rng = random.Random(len(rows))
    order = sorted(rows, key=lambda r: r[2] + rng.random() * late)
    return [order[i * len(order) // n : (i + 1) * len(order) // n] for i in range(n)] + [[(0, 0, 9e8, 1, c)] for c in sorted({r[4] for r in rows})] + [[(0, 0, 9e9, 1, c) for c in {r[4] for r in rows}]]


def want(rows, dt, gap=0, chain=True):
    tot = {}
    for x, y, t, q, _ in rows:
        tot.setdefault((x, y, float(t)), []).append(q)
    out = []
    for c in footprints([(x, y, float(t)) for x, y, t, _, _ in rows], dt, gap, chain):
        first = min((t, x, y) for x, y, t in c)
        out.append((*first, max(t for _, _, t in c), len(c), sum(tot[h][0] for h in c)))
    return sorted(out)


def result(df):
    return sorted((r.t_min, r.x0, r.y0, r.t_max, r.n_pixels, r.tot_sum) for r in df.where("t_min < 8e8").collect())


def some_hits(seed, n, side, step, chips=("a",)):
    rng = random.Random(seed)
    rows, seen, t = [], set(), 0
    while len(rows) < n:
        t += rng.randint(1, step)
        x, y, chip = rng.randint(0, side), rng.randint(0, side), rng.choice(chips)
        if (x, y, t, chip) not in seen:
            seen.add((x, y, t, chip))
            rows.append((x, y, float(t), rng.randint(1, 99), chip))
    return rows


@pytest.mark.parametrize("mode", ["chain", "min"])
def test_chips_of_a_stream(spark, tmp_path, mode):
    rows = some_hits(1, 400, 12, 400, ("a", "b"))
    got, _ = live(spark, tmp_path, shuffled(rows, 3, 3000), lambda s: stream_clusters(s, 1500, 1, mode, 5000, "chip"))
    batch = stream_clusters(spark.createDataFrame(rows, SCHEMA), 1500, 1, mode, tile="chip")
    for chip in "ab":
        expected = want([r for r in rows if r[4] == chip], 1500, 1, mode == "chain")
        assert result(got.where(F.col("chip") == chip)) == expected
        assert result(batch.where(F.col("chip") == chip)) == expected


def test_endless_flux_has_bounded_state(spark, tmp_path):
    """One pixel pair fires without pause beside short clusters: the state does not grow with the stream."""
    rows = [(20 + i % 2, 20, float(700 * i), 5, "a") for i in range(1200)]
    rows += [(x, y, t, q, c) for x, y, t, q, c in some_hits(2, 300, 12, 4000) if t < 700 * 1200]
    batches = shuffled(rows, 8, 4000)
    got, state = live(spark, tmp_path, batches, lambda s: stream_clusters(s, 1500, 0, "chain", 5000))
    assert result(got) == want(rows, 1500)
    assert max(r[4] for r in result(got)) == 1200
    assert max(state[4:]) <= max(state[:4]) + 20 and max(state) < 400  # entries of all lists and timers


def test_fields_of_one_sensor_are_joined(spark, tmp_path):
    rows = some_hits(3, 500, 15, 250)
    got, _ = live(spark, tmp_path, shuffled(rows, 3, 3000), lambda s: stream_fragments(s, 4, 1500, 0, 5000))
    closed = got.where("t_min < 8e8")
    assert closed.select("field_x", "field_y").distinct().count() == 16
    expected = want(rows, 1500)
    assert closed.count() > len(expected)  # fields do cut clusters
    assert result(join_fragments(closed, 1500, 0, slice_ns=20_000.0)) == expected


def test_empty_and_null_input(spark):
    df = spark.createDataFrame([(None, 1, 1.0, 1, "a"), (1, 1, None, 1, "a"), (3, 1, 5.0, None, None)], SCHEMA)
    assert [tuple(r) for r in stream_clusters(df).collect()] == [(5.0, 3, 1, 5.0, 1, 0)]
    assert [tuple(r) for r in stream_clusters(df, tile="chip").collect()] == [(None, 5.0, 3, 1, 5.0, 1, 0)]
    assert stream_clusters(df.where("false"), tile="chip").collect() == []
    assert OpenFootprints(1.0, 1, True, False).close() is None
