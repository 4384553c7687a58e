"""Leaf-wise multiclass trees against a direct model, and their nodes as a table."""

import numpy as np
import pytest
from hitflow.operators import learning, trees
from pyspark.sql import functions as F


def fixture(spark, n=900, seed=3, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    label = np.where(x[:, 0] * x[:, 1] > 0.2, 0, np.where(x[:, 2] > 0.3, 1, 2)) % classes
    rows = [(i, *map(float, x[i]), int(label[i]), "train" if i < 0.6 * n else "val" if i < 0.8 * n else "test") for i in range(n)]
    return spark.createDataFrame(rows, "cluster_id long, a double, b double, c double, d double, hard_label int, split string").cache()


NAMES = ["a", "b", "c", "d"]


def direct(model, rows, rounds, leaves, rate):
    """One split at a time, over all rows."""
    train = [r for r in rows if r.split == "train"]
    x = np.array([[np.searchsorted(e, r[f], "left") for f, e in zip(NAMES, model.edges, strict=True)] for r in train])
    y = np.array([r.hard_label for r in train])
    k = len(model.start)
    w = np.array([len(y) / (len(set(y)) * (y == c).sum()) for c in y])
    scores, out = np.tile(model.start, (len(y), 1)).astype(float), []
    for _ in range(rounds):
        p, made = trees.softmax(scores), []
        for c in range(k):
            g, h = w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c]) * k / (k - 1)
            parts = {(): np.arange(len(y))}

            def best(at, g=g, h=h):
                found = (0.0, 0, 0)
                for f in range(x.shape[1]):
                    for b in np.unique(x[at, f]):
                        a, z = at[x[at, f] <= b], at[x[at, f] > b]
                        if min(len(a), len(z)) >= trees.LEAST_ROWS and min(h[a].sum(), h[z].sum()) >= trees.LEAST_H:
                            gain = g[a].sum() ** 2 / h[a].sum() + g[z].sum() ** 2 / h[z].sum() - g[at].sum() ** 2 / h[at].sum()
                            if round(gain, 9) > found[0]:
                                found = (round(gain, 9), f, b)
                return found

            while len(parts) < leaves:
                choice = {path: best(at) for path, at in parts.items()}
                path = max(choice, key=lambda q: choice[q][0])
                gain, f, b = choice[path]
                if gain <= 0:
                    break
                at = parts.pop(path)
                parts[*path, (f, b, 0)], parts[*path, (f, b, 1)] = at[x[at, f] <= b], at[x[at, f] > b]
            made.append(sorted((len(at), round(-rate * g[at].sum() / h[at].sum(), 9)) for at in parts.values()))
            for at in parts.values():
                scores[at, c] += -rate * g[at].sum() / h[at].sum()
        out.append(made)
    return out, scores


@pytest.mark.parametrize("keep", [10, 1])
def test_trees_equal_those_of_one_split_at_a_time(spark, monkeypatch, keep):
    monkeypatch.setattr(trees, "KEEP", keep)
    df = fixture(spark)
    model = trees.fit(df.where("split <> 'val'"), NAMES, rounds=3, leaves=9, rate=0.3)
    rows = df.collect()
    want, scores = direct(model, rows, 3, 9, 0.3)
    train = df.where("split = 'train'")
    assert len(model.trees) == 3 and all(t.feature.count(-1) == len(w) for r, ws in zip(model.trees, want, strict=True) for t, w in zip(r, ws, strict=True))
    got = {r.cluster_id: r.probability for r in model.transform(train).collect()}
    expected = trees.softmax(scores)
    for i, r in enumerate(r for r in rows if r.split == "train"):
        assert np.allclose(got[r.cluster_id], expected[i], atol=1e-9)
    values = [sorted(round(v, 9) for f, v in zip(t.feature, t.value, strict=True) if f < 0) for r in model.trees for t in r]
    assert values == [sorted(v for _, v in w) for ws in want for w in ws]


def test_accuracy_early_stop_and_files(spark, tmp_path):
    df = fixture(spark, 2000)
    model = trees.fit(df, NAMES, rounds=8, leaves=15, rate=0.5, stop=3)
    test = df.where("split = 'test'")
    right = model.transform(test).where("prediction = hard_label").count() / test.count()
    plain = learning.fit_boosted(df, NAMES)
    other = plain.transform(test).where("prediction = hard_label").count() / test.count()
    assert right > 0.93 and right >= other - 0.02, (right, other)
    assert len(model.trees) == 1 + int(np.argmin(model.losses)) and len(model.losses) <= len(model.trees) + 3
    again = trees.load(spark, model.save(spark, str(tmp_path / "m")))
    assert [r.probability for r in again.transform(test.limit(9)).collect()] == [r.probability for r in model.transform(test.limit(9)).collect()]


def test_split_counts_equal_a_walk(spark):
    model = trees.fit(fixture(spark), NAMES, rounds=2, leaves=7)
    walked = dict.fromkeys(NAMES, 0)
    for by_class in model.trees:
        for t in by_class:
            todo = [0]
            while todo:
                i = todo.pop()
                if t.feature[i] >= 0:
                    walked[NAMES[t.feature[i]]] += 1
                    todo += [t.left[i], t.right[i]]
    assert {r.feature: r.splits for r in model.split_counts(spark).collect()} == walked and sum(walked.values()) > 10
    nodes = model.nodes(spark)
    assert nodes.where("feature is null").count() == sum(t.feature.count(-1) for r in model.trees for t in r)
    assert nodes.where("threshold is null and feature is not null").count() == 0


def test_missing_values_absent_classes_and_empty_tables(spark):
    df = fixture(spark, 300)
    holes = df.withColumn("a", F.when(F.col("cluster_id") % 3 > 0, F.col("a"))).withColumn("b", F.when(F.col("cluster_id") % 5 > 0, F.col("b")).otherwise(float("nan")))
    model = trees.fit(holes, NAMES, rounds=2, leaves=5)
    assert all(np.isfinite(r.probability).all() for r in model.transform(holes).collect())
    only = trees.fit(df.withColumn("hard_label", F.when(F.col("split") == "train", F.lit(1)).otherwise(F.lit(2))), NAMES, rounds=2)
    assert {r.prediction for r in only.transform(df).collect()} == {1}
    none = trees.fit(df.where("false"), NAMES, rounds=2)
    assert none.trees == [] and none.transform(df.where("false")).collect() == []
