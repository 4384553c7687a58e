import random

import numpy as np
import pytest
from hitflow.operators import clustering
from hitflow.operators.clustering import cluster_hits, summary


def footprints(rows, dt, gap, chain):
    """A direct model: clusters as lists of hits, in time order."""
    open_ = []
    for x, y, t in sorted(rows, key=lambda r: r[2]):
        joined = [c for c in open_ if t - (max if chain else min)(h[2] for h in c) <= dt and any(max(abs(h[0] - x), abs(h[1] - y)) <= gap + 1 for h in c)]
        open_ = [c for c in open_ if c not in joined] + [[h for c in joined for h in c] + [(x, y, t)]]
    return sorted(sorted(c) for c in open_)


def found(spark, rows, **settings):
    df = spark.createDataFrame([(int(x), int(y), float(t), 100) for x, y, t in rows], "x_pix int, y_pix int, time_ns double, tot int")
    out = {}
    for r in cluster_hits(df, **settings).collect():
        out.setdefault(r.cluster_id, []).append((r.x_pix, r.y_pix, r.time_ns))
    assert sorted(out) == list(range(len(out)))
    return sorted(sorted(c) for c in out.values())


CASES = [
    ("separate in space", [(0, 0, 100), (1, 0, 110), (100, 100, 105), (101, 100, 115)], {}, 2),
    ("late hit joins", [(10, 10, 1000), (11, 10, 1010), (10, 11, 1950)], {}, 1),
    ("beyond dt", [(10, 10, 1000), (11, 10, 3500)], {}, 2),
    ("out of order", [(5, 5, 300), (5, 6, 100), (6, 5, 200)], {}, 1),
    ("close-out", [(0, 0, 0), (1, 0, 100), (0, 0, 800), (1, 0, 900)], {"dt_ns": 500.0, "safety_margin_ns": 100.0}, 2),
    ("gap 0", [(0, 0, 100), (2, 0, 110)], {}, 2),
    ("gap 1", [(0, 0, 100), (2, 0, 110)], {"max_gap": 1}, 1),
    ("chaining by cluster", [(5, 5, 0), (6, 5, 1500), (4, 5, 3000)], {}, 1),
    ("min mode", [(5, 5, 0), (6, 5, 1500), (4, 5, 3000)], {"time_criterion": "min"}, 2),
    ("at dt", [(5, 5, 0), (5, 5, 2000)], {}, 1),
    ("bridge", [(0, 0, 0), (2, 0, 0), (1, 0, 10)], {}, 1),
    ("corner", [(255, 255, 0), (254, 254, 5)], {}, 1),
    ("negative margin", [(5, 5, 0), (5, 5, 1900)], {"safety_margin_ns": -200.0}, 2),
]


@pytest.mark.parametrize(("name", "rows", "settings", "n"), CASES, ids=[c[0] for c in CASES])
def test_case(spark, name, rows, settings, n):
    assert len(found(spark, rows, **settings)) == n


@pytest.mark.parametrize("mode", ["chain", "min"])
@pytest.mark.parametrize("large", [200_000, 12])
def test_random_hits_match_the_model(spark, monkeypatch, mode, large):
    monkeypatch.setattr(clustering, "LARGE", large)
    rng = random.Random(large + len(mode))
    rows = [(rng.randint(0, 7), rng.randint(0, 7), 40 * rng.randint(0, 60) + rng.randint(0, 12)) for _ in range(220)]
    rows += rows[:3]
    for dt, gap in ((10, 0), (25, 1), (45, 0)):
        assert found(spark, rows, dt_ns=float(dt), max_gap=gap, time_criterion=mode, slice_ns=300.0) == footprints(rows, dt, gap, mode == "chain")


def test_one_long_epoch_is_dealt_to_several_tasks(spark, monkeypatch):
    """Hits without any gap above the reach, on islands of pixels; within an island there are gaps."""
    monkeypatch.setattr(clustering, "LARGE", 100)
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x, y = 12 * rng.randint(0, 9), 12 * rng.randint(0, 9)
        rows += [(x + rng.randint(0, 2), y + rng.randint(0, 2), 5 * i + rng.randint(0, 20)) for _ in range(4)]
    df = spark.createDataFrame([(int(x), int(y), float(t)) for x, y, t in rows], "x_pix int, y_pix int, time_ns double")
    one = clustering.epochs(df, 40.0)
    assert one.select("epoch").distinct().count() == 1
    parts = clustering._split(one.selectExpr("epoch", "time_ns as t", "x_pix as x", "y_pix as y"), 40.0, 1, 300.0).groupBy("part").count().collect()
    assert len(parts) > 50 and max(r["count"] for r in parts) <= 100 and sum(r["count"] for r in parts) == len(rows)
    assert found(spark, rows, dt_ns=40.0, slice_ns=300.0) == footprints(rows, 40, 0, True)


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1, 1.0, 1), (1, 1, None, 1), (1, 1, 5.0, None)], "x_pix int, y_pix int, time_ns double, tot int")
    assert cluster_hits(df.where("false")).collect() == []
    assert [(r.cluster_id, r.n_pixels, r.t_min) for r in summary(cluster_hits(df)).collect()] == [(0, 1, 5.0)]
    with pytest.raises(ValueError, match="x_pix"):
        cluster_hits(df.drop("x_pix"))


def strips_used(monkeypatch):
    """How many strips the connected parts of a run had, round by round."""
    seen, before = [], clustering._strips
    monkeypatch.setattr(clustering, "_strips", lambda rows: seen.append(before(rows)) or seen[-1])
    return seen


@pytest.mark.parametrize("mode", ["chain", "min"])
def test_a_connected_epoch_is_dealt_strip_by_strip(spark, monkeypatch, mode):
    """One epoch whose pixels all touch: no cut in time or place, and clusters that cross the borders of strips."""
    monkeypatch.setattr(clustering, "LARGE", 60)
    seen = strips_used(monkeypatch)
    rng = random.Random(11)
    rows, t = [], 0
    while len(rows) < 700:
        t += rng.randint(1, 9)
        rows.append((rng.randint(0, 14), rng.randint(0, 14), t))
    want = footprints(rows, 20, 0, mode == "chain")
    assert found(spark, rows, dt_ns=20.0, time_criterion=mode, slice_ns=500.0) == want
    assert len(seen) == 1 and seen[0].select("part", "strip").distinct().count() >= 10
    assert len(want) > 20


def test_a_cluster_that_outlasts_all_strips(spark, monkeypatch):
    """Steady flux on few pixels is one endless cluster beside short ones; a pixel hit once at the start still counts at the end."""
    monkeypatch.setattr(clustering, "LARGE", 40)
    monkeypatch.setattr(clustering, "ROUNDS", 3)
    rng = random.Random(12)
    rows = [(0, 0, 1), (1, 0, 2)] + [(rng.choice((1, 2, 3)), rng.choice((0, 1)), 6 * i) for i in range(1, 400)]
    rows += [(rng.randint(5, 9), rng.randint(0, 3), rng.randint(0, 2400)) for _ in range(90)] + [(4, 3, 1200), (0, 1, 2397)]
    want = footprints(rows, 15, 0, True)
    assert max(len(c) for c in want) > 390 and len(want) > 10
    assert found(spark, rows, dt_ns=15.0, slice_ns=500.0) == want


@pytest.mark.parametrize("large", [200_000, 50])
def test_sweep_reads_the_hits_once(spark, monkeypatch, large):
    monkeypatch.setattr(clustering, "LARGE", large)
    rng = random.Random(13)
    rows = [(rng.randint(0, 20), rng.randint(0, 20), rng.randint(0, 3000)) for _ in range(400)]
    df = spark.createDataFrame([(x, y, float(t)) for x, y, t in rows], "x_pix int, y_pix int, time_ns double")
    got = clustering.sweep(df, [10.0, 60.0], [0, 2], slice_ns=500.0)
    for r in got.collect():
        sizes = sorted(len(c) for c in footprints(rows, r.dt_ns, r.max_gap, True))
        assert (r.n_clusters, r.mean_size) == (len(sizes), round(sum(sizes) / len(sizes), 6))
        at = 0.95 * (len(sizes) - 1)
        low = int(at)
        assert r.p95_size == round(sizes[low] + (sizes[min(low + 1, len(sizes) - 1)] - sizes[low]) * (at - low), 6)
    assert got.count() == 4
    if large > 400:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsInArrow") == 1


@pytest.mark.parametrize("mode", ["chain", "min"])
def test_rounds_over_arrays_give_what_the_fold_gives(mode):
    """Crowded and sparse hits, equal times and places, reaches from 0 on and distances from 1 to 4."""
    rng = np.random.default_rng(21)
    for i in range(120):
        n, wide, long = int(rng.integers(0, 90)), int(rng.integers(1, 14)), int(rng.integers(1, 400))
        t, x, y = (a.astype(kind) for a, kind in zip((rng.integers(0, long, n), rng.integers(-wide, wide, n), rng.integers(0, wide, n)), (np.float64, np.int32, np.int32), strict=True))
        order = np.lexsort((y, x, t))
        t, x, y = t[order], x[order], y[order]
        reach, d = float(rng.integers(0, 30)), 1 + i % 4
        _, first, at = np.unique(clustering._labels(x, y, t, reach, d, mode == "chain")[0], return_index=True, return_inverse=True)
        assert clustering._heads(x, y, t, reach, d, mode == "chain").tolist() == first[at].tolist()


def test_short_clusters_are_not_folded_hit_by_hit(monkeypatch):
    monkeypatch.setattr(clustering, "_labels", None)
    t, x, y = np.repeat(np.arange(500) * 100.0, 4) + np.tile([0.0, 6, 12, 18], 500), np.tile([5, 6, 7, 7], 500), np.repeat(np.arange(500) * 7 % 50 * 3, 4)
    assert clustering._heads(x, y, t, 2000.0, 1, False).tolist() == clustering._heads(x, y, t, 7.0, 1, True).tolist() == np.repeat(np.arange(500) * 4, 4).tolist()


@pytest.mark.parametrize("burst", [0, 300])
def test_blocks_of_time_and_their_ends(spark, monkeypatch, burst):
    """Epochs within blocks, across their ends and longer than they are; a burst above LARGE; each row of the hits goes once."""
    monkeypatch.setattr(clustering, "LARGE", 200)
    rng = random.Random(22 + burst)
    rows = [(rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9000)) for _ in range(700)] + [(rng.randint(0, 9), rng.randint(0, 9), 4000 + rng.randint(0, 3)) for _ in range(burst)]
    df = spark.createDataFrame([(x, y, float(t), x, i) for i, (x, y, t) in enumerate(rows)], "x_pix int, y_pix int, time_ns double, tot int, given_id long")
    add, dealt, left = clustering._blocks(clustering._rows(df), 12.0, 50.0)
    assert dealt.count() + left.count() == len(rows) and dealt.groupBy("g", "h").count().agg({"count": "max"}).first()[0] <= 200 and (left.count() > 0) == bool(burst)
    want = footprints(rows, 12, 0, True)
    assert found(spark, rows, dt_ns=12.0, slice_ns=50.0) == want
    first = {i: (min((h[2], h[0], h[1]) for h in c), max(h[2] for h in c), len(c), sum(h[0] for h in c)) for i, c in enumerate(sorted(want, key=lambda c: min((h[2], h[0], h[1]) for h in c)))}
    got = clustering.clusters(df, 12.0, slice_ns=50.0)
    assert {r.cluster_id: ((r.t_min, r.x0, r.y0), r.t_max, r.n_pixels, r.tot_sum) for r in got.collect()} == first
    assert {r.key for r in cluster_hits(df, 12.0, slice_ns=50.0).collect()} == {str(i) for i in range(len(rows))}
