"""Steps whose cost must not outgrow the input."""

import numpy as np
from hitflow.operators import learning, mixture, network, patches, trees
from hitflow.plans import queries
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F


def test_patches_are_joined_as_cells(spark, sf):
    """Rows of 512 numbers go through no shuffle."""
    plan = queries.QUERIES["i_aligned"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Join")
    sparse = spark.createDataFrame([(1, 0, 0, 2.0, 5.0), (1, 1, 0, 3.0, 6.0), (2, 1, 1, 4.0, 7.0)], "cluster_id long, px int, py int, ch0 double, ch1 double")
    stats = spark.createDataFrame([(0, 1.0, 2.0), (1, 5.0, 1.0)], "channel int, mean double, std double")
    got = {r.cluster_id: (r.ch0, r.ch1) for r in patches.dense(sparse, stats, 2).collect()}
    assert got == {1: ([0.5, 1.0, -0.5, -0.5], [0.0, 1.0, -5.0, -5.0]), 2: ([-0.5, -0.5, -0.5, 1.5], [-5.0, -5.0, -5.0, 2.0])}
    assert patches.dense(sparse.where("false"), stats, 2).collect() == []


def test_the_perceptron_is_as_wide_as_what_changes(spark):
    """Cells that no patch fills cost nothing and change nothing."""
    rng = np.random.default_rng(4)
    rows = [(i, Vectors.dense([0.0] * 60 + [float(x), 7.0]), int(x > 0)) for i, x in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, ["cluster_id", "x", "hard_label"])
    model = learning.fit_perceptron(df, ["x"], "hard_label", 2, hidden=3)
    assert len(model.stages[-1].weights) == (1 + 1) * 3 + (3 + 1) * 2
    assert model.transform(df).where("prediction = hard_label").count() > 390
    none = learning.fit_perceptron(df.withColumn("x", F.lit(1.0)), ["x"], "hard_label", 2, hidden=3)
    assert none.transform(df.withColumn("x", F.lit(1.0))).count() == 400


def test_trees_read_blocks_of_rows(spark, monkeypatch):
    """The written table of the boosting has a row for each block."""
    seen, before = [], trees.saved
    monkeypatch.setattr(trees, "saved", lambda df: seen.append(before(df)) or seen[-1])
    df = spark.range(3000).selectExpr("id as cluster_id", "cast(id % 97 as double) as a", "cast(id % 31 as double) as b", "cast(id % 97 > 40 as int) as hard_label", "if(id % 4 = 0, 'val', 'train') as split")
    model = trees.fit(df, ["a", "b"], rounds=3, leaves=4, rate=0.5)
    assert len(seen) >= 3 and all(t.count() <= df.rdd.getNumPartitions() for t in seen)
    assert model.transform(df).where("prediction = hard_label").count() == 3000


def test_the_network_splits_cells_not_patches(spark, sf, monkeypatch):
    """Patches are filled behind the split and its sort, and only for the block at hand."""
    seen, before = [], learning.time_block_split
    monkeypatch.setattr(learning, "time_block_split", lambda df, *a: seen.append(df.columns) or before(df, *a))
    monkeypatch.setattr(queries.network, "fit", lambda train, val, *a: (train, val))
    test, (train, val) = queries._network(spark, sf)
    assert "cells" in seen[0] and "ch0" not in seen[0]
    assert all(set(df.select("split").distinct().toPandas()["split"]) <= {name} for df, name in ((test, "test"), (train, "train"), (val, "val")))
    assert len(train.first()["ch0"]) == 256


def test_a_field_of_equal_cells_passes_its_gradient_once():
    """The largest of four cells, and of equal ones the first, takes the whole gradient."""
    p = queries.network.initial(1, 2, 4, channels=(2,), hidden=3, seed=1, kind=np.float64)
    x, s = np.zeros((2, 4, 4, 2)), np.ones((2, 1))
    logits, back, _ = queries.network.forward(p | {"b0": np.ones(2)}, x, s)
    g, dx = queries.network.backward(p, back, np.ones_like(logits), train=False)
    joined, pre, *_ = back[-1]
    per = ((np.ones_like(logits) @ p["h2"].T) * (pre > 0)) @ p["h1"].T
    assert np.allclose(g["b0"], per[:, :2].sum(axis=0)) and dx.shape == x.shape
    assert queries.network.backward(p, back, np.ones_like(logits), train=False, patches=False)[1] is None


def test_bimodality_and_temperature_read_distinct_values(spark, sf, monkeypatch):
    """What goes on after the labels grows with the distinct values, not with the clusters."""
    seen = {}
    for module in (queries.contamination, queries.fn):
        monkeypatch.setattr(module, "saved", lambda df, before=module.saved, name=module.__name__: seen.setdefault(name, []).append(before(df)) or seen[name][-1])
    df = spark.range(4000).selectExpr("cast(id % 2 as int) as hard_label", "id % 7 as n_pixels", "cast(id % 5 as double) as tot_sum", "cast(id % 3 as double) as tot_max", "0.5 as eccentricity")
    got = {(r.hard_label, r.feature): r.n for r in queries.contamination.bimodality(df, iterations=2).collect()}
    assert len(got) == 8 and set(got.values()) == {2000}
    assert all(t.count() <= 2 * (7 + 5 + 3 + 1) for t in seen[queries.contamination.__name__])
    rows = spark.range(600).selectExpr("cast(id % 2 as int) as y", "array(cast(id % 3 as double), 1.0D) as z")
    counted = rows.groupBy("y", "z").count()
    assert learning.temperature(rows, "z", "y") == learning.temperature(counted, "z", "y", weight="count")
    queries.QUERIES["i_temperature_fixed"](spark, sf)
    assert "n" in seen[queries.fn.__name__][-1].columns


def test_filters_on_labels_repeat_no_densities(spark):
    """A filter on the label is pushed below it; each density stands in it a few times, not once for each use of each share."""
    start = mixture.Mixture.start(1785.0, [175.0, 250.0], [20.0, 20.0])
    df = spark.createDataFrame([(170.0,), (213.0,), (1000.0,), (None,)], "folded_tof_ns double")
    got = mixture.assign(df, start)
    plan = got.where("hard_label >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count("exp(") <= 12
    rows = got.collect()
    assert [r.hard_label for r in rows] == [0, -1, 2, None] and rows[3].label_confidence is None
    for r in rows[:3]:
        p = [r.posterior_peak_0, r.posterior_peak_1, r.posterior_background]
        assert abs(sum(p) - 1) < 1e-12 and r.label_confidence == max(p)


def test_trees_get_narrow_rows_in_even_tasks(spark, sf, monkeypatch):
    """Only what the trees read is split, sorted and written, in some tasks a core; only the test block is scored for its report."""
    split, scored = [], []
    before, predict = learning.time_block_split, learning.predict
    monkeypatch.setattr(learning, "time_block_split", lambda df, **a: split.append((df.columns, a)) or before(df, **a))
    monkeypatch.setattr(learning, "predict", lambda df, model: scored.append(df) or predict(df, model))
    support = {r["class"]: r.support for r in queries.QUERIES["h_gbt"](spark, sf).collect()}
    assert len(split[0][0]) == 3 + len(queries.features.MODEL_FEATURES) and split[0][1] == {"even": True}
    assert {r.split for r in scored[0].select("split").distinct().collect()} == {"test"} and support["accuracy"] == scored[0].count()
    rows = spark.range(90_000).selectExpr("id as cluster_id", "id * 1e5 as t_min")
    even, usual = before(rows, even=True), before(rows)
    assert even.rdd.getNumPartitions() == 5 and sorted(even.collect()) == sorted(usual.collect())
    sizes = even.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert max(sizes) < 1.3 * sum(sizes) / len(sizes)


def test_scores_stay_with_their_rows(spark):
    """No join by id: rows without one, or with the same, keep their own score; nothing is kept in the cache after the fit."""
    df = spark.range(600).selectExpr("if(id % 50 = 0, null, id div 2) as cluster_id", "id as t_min", "cast(id % 10 as double) as a", "if(id % 7 = 0, -1, cast(id % 10 > 4 as int)) as hard_label", "if(id < 500, 'train', 'val') as split")
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before = held()
    model = learning.fit_boosted(learning.labelled(df), ["a"])
    assert held() <= before
    out = learning.predict(df.withColumn("features", F.lit("kept")), model)
    assert out.columns == [*df.columns, "features", "predicted_label"] and out.count() == 600
    assert out.where("hard_label < 0 and predicted_label is not null or hard_label >= 0 and predicted_label is null").count() == 0
    assert out.where("hard_label >= 0 and predicted_label <> hard_label").count() == 0
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_the_network_reads_blocks_of_rows(spark, monkeypatch):
    """The written tables of the training have a row for each block of patches, not for each patch."""
    seen, before = [], network.saved
    monkeypatch.setattr(network, "saved", lambda df: seen.append(before(df)) or seen[-1])
    flat = "transform(sequence(0, 15), i -> if(i = 5 or i = 6 and id % 2 = 0, 1.0D, 0.0D))"
    df = spark.range(3000).selectExpr("id as cluster_id", f"{flat} as ch0", f"{flat} as ch1", "array(1.0D) as scalars", "array(cast(id % 2 as double), cast(1 - id % 2 as double)) as target").coalesce(2)
    net = network.fit(df, df.limit(500), 4, 2, rounds=6, channels=(4, 4), hidden=8, rate=2e-2)
    assert len(seen) == 2 and all(0 < t.count() <= 4 for t in seen)
    assert len(net.losses) == 6 and net.transform(df).where("prediction = 1 - cluster_id % 2").count() == 3000


def test_cells_that_all_patches_share_are_computed_once():
    """Windows around what differs give the logits, statistics and gradients of whole patches, for small arrays inside."""
    rng = np.random.default_rng(6)
    for size, box, channels in ((16, (6, 11), (16, 32, 32, 64)), (16, (0, 3), (4, 3)), (7, (5, 7), (3, 4)), (9, (3, 4), (3, 4, 5))):
        p = {k: v + rng.normal(0, 0.2, v.shape) ** 2 for k, v in network.initial(3, 4, size, channels, 6, kind=np.float64).items()}
        x, s, y = np.full((9, size, size, 2), (-0.3, 0.2)), rng.normal(size=(9, 3)), rng.dirichlet(np.ones(4), 9)
        x[:, box[0] : box[1], box[0] : box[1]] = rng.normal(size=(9, box[1] - box[0], box[1] - box[0], 2))
        for train in (True, False):
            want, back, stats = network.forward(p, x, s, train)
            got, narrow, own = network.forward(p, x, s, train, windows=True)
            assert np.allclose(got, want, atol=1e-10) and all(np.allclose(own[k], stats[k], atol=1e-10) for k in stats)
        want, back, _ = network.forward(p, x, s, True)
        got, narrow, _ = network.forward(p, x, s, True, windows=True)
        assert narrow[0][0].size < back[0][0].size or box[0] == 0  # a filled first corner leaves the whole patch
        d = network.cross_entropy(want, y)[1]
        g, own = network.backward(p, back, d)[0], network.backward(p, narrow, d, patches=False)[0]
        assert g.keys() == own.keys() and all(np.allclose(own[k], g[k], atol=1e-10) for k in g)


def test_trees_make_one_histogram_for_two_children(spark, monkeypatch):
    """The larger child's is what the parent's leaves over, with the same trees; val rows lie apart and are read once a round."""
    df = spark.range(3000).selectExpr("id as cluster_id", "cast(id % 97 as double) as a", "cast(id % 31 as double) as b", "cast(id * 7 % 13 as double) as c", "cast((id % 97 + id % 31) % 3 as int) as hard_label", "if(id % 4 = 0, 'val', 'train') as split")
    left, before, made = [], trees._left_over, []
    monkeypatch.setattr(trees, "_left_over", lambda *a: left.append(before(*a)) or left[-1])
    for held in (trees.HELD, 0):
        monkeypatch.setattr(trees, "HELD", held)
        made.append(trees.fit(df, ["a", "b", "c"], rounds=3, leaves=9, rate=0.5))
        made.append(len(left))
    model, some, plain, as_many = made
    assert some == as_many >= 3 * 3 * 4  # none more without room for histograms
    assert np.allclose(model.losses, plain.losses, rtol=1e-12)
    for one, two in zip(sum(model.trees, []), sum(plain.trees, []), strict=True):
        assert (one.feature, one.bin, one.left, one.right) == (two.feature, two.bin, two.left, two.right) and np.allclose(one.value, two.value, rtol=1e-9)
    packed = trees._packed((np.arange(3), np.zeros((3, 2)), np.ones((3, 3))), (np.arange(1), np.zeros((1, 2)), np.ones((1, 3))))
    assert [len(rows[0]) for rows in next(trees._unpacked(iter([packed]), 2, 3))] == [3, 1]
    assert [len(rows[0]) for rows in next(trees._unpacked(iter([packed.select(list(trees.KINDS))]), 2, 3))] == [3]
    odd = trees._left_over(np.array([[[0.3, 0.1]], [[0.2, 0.4]], [[2.0, 1.0]]]), np.array([[[0.3, 0.1 + 1e-17]], [[0.2, 0.1]], [[1.0, 1.0]]]))
    assert odd[:, 0, 1].tolist() == [0.0, 0.0, 0.0] and odd[2, 0, 0] == 1
