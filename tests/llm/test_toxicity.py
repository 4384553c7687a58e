import random

import numpy as np
from hitflow.llm import registry, toxicity


def fixture(spark, n=1200):
    rng = random.Random(4)
    vocab = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.randint(0, 300)}" for _ in range(900)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        poor, toxic = rng.random() < 0.2, rng.random() < 0.15
        if poor:
            words = [w + "!!" for w in words]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vileón", "vileta", "vileque"]))
        rows.append((i, " ".join(words), int(poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")


def test_held_out_accuracy_and_filter(spark):
    df = fixture(spark)
    model = toxicity.fit_chain(df, df.where("doc_id < 800").select("doc_id", "low_quality", "toxic"), ["low_quality", "toxic"])
    got = {r.doc_id: r for r in toxicity.score(df, model, ["low_quality", "toxic"]).collect()}
    held = [r for r in df.collect() if r.doc_id >= 800]
    assert sum(got[r.doc_id].toxic == bool(r.toxic) for r in held) >= 0.98 * len(held)
    assert sum(got[r.doc_id].low_quality == bool(r.low_quality) for r in held) >= 0.98 * len(held)
    left = toxicity.without(df, model, "toxic")
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.toxic}


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 50000), (2, "nasty")], "doc_id long, text string")
    none = df.select("doc_id").where("false").selectExpr("doc_id", "0 as toxic")
    assert toxicity.fit_chain(df, none, ["toxic"]) is None
    assert [r.p_toxic for r in toxicity.score(df, None, ["toxic"]).collect()] == [0.0] * 4
    model = toxicity.fit_chain(fixture(spark, 200), fixture(spark, 200).select("doc_id", "toxic"), ["toxic"])
    got = toxicity.score(df, model, ["toxic"]).collect()
    assert len(got) == 4 and [r.p_toxic for r in got[:2]] == [0.0, 0.0]
    assert toxicity.score(df.where("false"), model, ["toxic"]).collect() == []
    assert toxicity.without(df, model, "toxic").where("text is null").count() == 1


def test_query(spark, sf):
    assert registry.op5_toxicity(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def plain_logistic(x, y):
    """Ridge logistic regression by gradient steps."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-6)
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + 1)
    v, last = w.copy(), w
    for t in range(6000):
        last, w = w, v - step * (x.T @ (1 / (1 + np.exp(-x @ v)) - y) + ridge * v)
        v = w + t / (t + 3) * (w - last)
    return w


def test_chain_matches_a_plain_one():
    rng = np.random.default_rng(3)
    x = (rng.random((160, 6)) < 0.4).astype(float)
    first = ((x[:, 0] + x[:, 1] + rng.random(160)) > 1.4).astype(float)
    second = ((first + x[:, 2] + rng.random(160)) > 1.6).astype(float)
    fold = rng.integers(0, toxicity.FOLDS, 160)
    chosen = [np.array([True] * 6), np.array([True] * 5 + [False]), *([np.array([True] * 6)] * 3)]
    links = toxicity.chain(x, fold, [first, second], chosen)
    earlier = np.zeros((160, 0))
    for link, y in zip(links, (first, second), strict=True):
        whole = np.column_stack([x, earlier])
        w = plain_logistic(whole, y)
        assert np.abs(w - np.array(link["w"])).max() < 1e-3
        out = np.zeros(160)
        for f in range(toxicity.FOLDS):
            on = np.append(chosen[f], np.ones(earlier.shape[1], bool))
            v = plain_logistic(whole[fold != f][:, on], y[fold != f])
            out[fold == f] = 1 / (1 + np.exp(-np.column_stack([whole[fold == f][:, on], np.ones((fold == f).sum())]) @ v))
        f1 = lambda t: 2 * ((out >= t) & (y > 0)).sum() / max(1, (out >= t).sum() + y.sum())
        assert f1(link["cut"]) >= max(f1(t) for t in np.linspace(0.05, 0.95, 91)) - 0.02
        earlier = np.column_stack([earlier, out])


def test_query_catches_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.toxic for r in registry.op5_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got]
    assert sum(got[k] == bool(t) for k, t in labels) >= 0.95 * len(labels)
