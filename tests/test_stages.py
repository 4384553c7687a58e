import random
import statistics

import numpy as np
import pytest
from hitflow import functions as fn
from hitflow import sources
from hitflow.operators import clustering, contamination, edges, features, learning, mixture, network, patches, quality, synth, tof
from hitflow.plans import pipeline
from hitflow.streaming import stream_clusters
from pyspark.sql import functions as F


def times(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "time_ns double")


def test_files_by_suffix(spark, tmp_path):
    rows = "x_pix,y_pix,time_ns,tot\n1,2,3.5,7\n4,5,NaN,8\n"
    (tmp_path / "h.csv").write_text(rows)
    (tmp_path / "h.TSV").write_text(rows.replace(",", "\t"))
    for name in ("h.csv", "h.TSV"):
        assert [tuple(r) for r in sources.load_hits(spark, str(tmp_path / name)).collect()] == [(1, 2, 3.5, 7), (4, 5, None, 8)]
    with pytest.raises(ValueError, match="no reader"):
        sources.read_table(spark, "x.h5")
    (tmp_path / "e.csv").write_text("t\n1\n")
    with pytest.raises(ValueError, match="time_ns"):
        sources.load_edges(spark, str(tmp_path / "e.csv"))
    with pytest.raises(FileNotFoundError):
        sources.load_period(spark, str(tmp_path))
    assert sources.load_period(spark, str(tmp_path), 5) == 5.0
    config = sources.load_config("dt_ns: 5.0\npeak_means: [1, 2]\nother: 3\n")
    assert config.dt_ns == 5.0 and config.peak_means == (1, 2) and config.extra == {"other": 3} and config.max_gap == 0


def test_period_and_report(spark):
    rng = random.Random(1)
    at, values = 0.0, []
    for i in range(500):
        at += 1785 + rng.uniform(-1, 1)
        if i not in (100, 101, 300):
            values.append(at)
    gaps = np.diff(values)
    df = times(spark, rng.sample(values, len(values)) + [None])
    assert edges.measure_period(df) == statistics.median(gaps)
    assert fn.exact_quantile(edges.gaps(df), "gap", 0.95, most=20, bins=4) == pytest.approx(np.quantile(gaps, 0.95))
    r = edges.edge_report(df, 1785.0).first()
    assert (r.n_edges, r.n_missed_gaps, r.n_missing) == (497, 2, 3) and r.period_std_ns == pytest.approx(gaps.std(), abs=1e-5)
    with pytest.raises(ValueError, match="two edges"):
        edges.measure_period(times(spark, [1.0]))


def test_quality(spark):
    df = spark.createDataFrame([(i, float(i if i != 7 else 0)) for i in range(20)], "arrival long, time_ns double")
    assert quality.monotone_fraction(df, "time_ns", "arrival", 4).first()["monotone_fraction"] == 18 / 19
    assert len(quality.warnings(df, "time_ns", "arrival")) == 2
    assert quality.monotone_fraction(df.where("false"), "time_ns", "arrival").first()["monotone_fraction"] is None


@pytest.mark.parametrize(("pulses", "t", "raw", "folded"), [([0, 1785, 3570], 1900, 115, 115), ([0], 2100, 2100, 315), ([5000], 100, None, None), ([0, 1785], 1785, 0, 0)])
def test_time_of_flight(spark, pulses, t, raw, folded):
    clusters = spark.createDataFrame([(1, float(t))], "cluster_id long, t_min double")
    for width in (1e7, 100.0):
        r = tof.attach_tof(clusters, times(spark, pulses), 1785.0, slice_ns=width).first()
        assert (r.raw_tof_ns, r.folded_tof_ns, r.tof_valid) == (raw, folded, raw is not None)
    with pytest.raises(ValueError, match="cluster time"):
        tof.attach_tof(clusters, times(spark, pulses), 1785.0, "t_max")


def test_asof_matches_searchsorted(spark):
    rng = np.random.default_rng(3)
    e, t = np.sort(rng.integers(0, 5000, 80)).astype(float), rng.integers(-50, 5200, 300).astype(float)
    left = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)] + [(999, None)], "id long, t double")
    got = {r.id: r.edge_ns for r in tof.asof_backward(left, times(spark, e), "t", "time_ns", slice_ns=70.0).collect()}
    at = np.searchsorted(e, t, side="right") - 1
    assert got == {**{i: (float(e[k]) if k >= 0 else None) for i, k in enumerate(at)}, 999: None}


def test_features_of_one_cluster(spark):
    rng = np.random.default_rng(2)
    x, y, w, t = rng.integers(0, 9, 12), rng.integers(0, 9, 12), rng.integers(1, 90, 12), rng.uniform(0, 50, 12)
    df = spark.createDataFrame([(1, int(a), int(b), float(c), int(d)) for a, b, c, d in zip(x, y, t, w, strict=True)] + [(2, 3, 3, 1.0, None)], "cluster_id long, x_pix int, y_pix int, time_ns double, tot int")
    got = {r.cluster_id: r for r in features.cluster_features(df).collect()}
    low, high = np.linalg.eigvalsh(np.cov(np.vstack([x, y]), aweights=w, ddof=0))
    assert got[1].linearity == pytest.approx(high / (low + high)) and got[1].eccentricity == pytest.approx(np.sqrt(1 - low / high))
    assert got[1].cx_w == pytest.approx((x * w).sum() / w.sum()) and got[1].t_argmax_tot == t[w.argmax()]
    assert (got[2].n_pixels, got[2].tot_sum, got[2].cx_w, got[2].linearity) == (1, 0.0, 0.0, 0.0)


def test_mixture_finds_peaks(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(175, 15, 300), rng.normal(250, 20, 200), rng.uniform(0, 1785, 50)]).clip(0, 1785)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(9999, None)], "cluster_id long, folded_tof_ns double")
    m = mixture.fit(df, "folded_tof_ns", mixture.Mixture.start(1785.0, [170, 260], [20, 20]), 30)
    assert abs(m.means[0] - 175) < 20 and abs(m.means[1] - 250) < 20 and sum(m.weights) == pytest.approx(1)
    rows = mixture.assign(df, m).collect()
    assert all(r.hard_label is None if r.folded_tof_ns is None else abs(r.posterior_peak_0 + r.posterior_peak_1 + r.posterior_background - 1) < 1e-9 for r in rows)
    assert {r.hard_label for r in rows} == {None, -1, 0, 1, 2}
    with pytest.raises(ValueError, match="peaks"):
        mixture.Mixture.start(1.0, [1], [1], 2)


def test_split_is_ordered_and_complete(spark):
    df = spark.createDataFrame([(i, float(i * 1e5)) for i in range(1000)], "cluster_id long, t_min double").orderBy(F.xxhash64("cluster_id"))
    split = learning.time_block_split(df)
    learning.check_split(split)
    assert {r.split: (r.n, r.first, r.last) for r in learning.split_bounds(split).collect()} == {"train": (700, 0.0, 699e5), "val": (150, 700e5, 849e5), "test": (150, 850e5, 999e5)}
    assert learning.time_block_split(df.where("false")).collect() == []


def test_contamination(spark):
    rng = np.random.default_rng(6)
    x = [*rng.normal(175, 15, 200), *rng.normal(250, 20, 150), *rng.uniform(0, 1785, 150)]
    label = [0] * 200 + [1] * 150 + [2] * 150
    rows = [(i, float(v), k, float(rng.normal(3 + 40 * (i % 2), 1)) if k == 0 else float(rng.normal(9, 2))) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "cluster_id long, folded_tof_ns double, hard_label int, tot_sum double")
    assert contamination.baseline_density(df).first()["density"] >= 0
    assert all(0 <= r.mislabel_fraction <= 1 for r in contamination.class_fractions(df).collect())
    fits = {r.hard_label: r for r in contamination.bimodality(df, ["tot_sum"]).collect()}
    tot = np.array([r[3] for r in rows if r[2] == 1])
    var = np.log1p(tot - tot.min() + 1e-3).var()
    assert fits[1].bic_1 == pytest.approx(2 * np.log(150) + 150 * (np.log(2 * np.pi * var) + 1))
    assert fits[0].bimodal and fits[0].minority_fraction == pytest.approx(0.5, abs=0.02)
    truth = spark.createDataFrame([(i, int(i >= 350)) for i in range(500)], "cluster_id long, wrap_count int")
    r = contamination.truth_check(df, truth, 0.2).first()
    assert r.true_fraction == pytest.approx(0.3) and r.error == pytest.approx(0.1)
    assert contamination.truth_check(df, truth).first()["error"] is None


def test_patches(spark):
    hits = [(1, 10 + i % 5, 20 + i // 5, 1000.0 + i, 50 + (i == 7) * 500) for i in range(20)]
    df = spark.createDataFrame(hits + [(2, x + 90, y + 50, t, w) for _, x, y, t, w in hits] + [(3, 1, 1, 0.0, 5)], "cluster_id long, x_pix int, y_pix int, time_ns double, tot int")
    own = patches.patches(df, df.select("cluster_id").where("cluster_id < 3").distinct(), dt_ns=12.0)
    rows = {k: sorted(tuple(r)[1:] for r in own.where(F.col("cluster_id") == k).collect()) for k in (1, 2, 3)}
    assert rows[1] == rows[2] and len(rows[1]) == 20 and rows[3] == [] and max(r[3] for r in rows[1]) == 12.0
    assert max(rows[1], key=lambda r: r[2])[:2] == (8, 8)
    full = patches.dense(own).where("cluster_id = 1").first()
    assert len(full.ch0) == 256 and full.ch0[8 * 16 + 8] == pytest.approx(np.log1p(550))
    assert patches.dihedral(own).select("variant").distinct().count() == 8
    stats = {r.channel: (r["mean"], r["std"]) for r in patches.channel_stats(own, 2).collect()}
    assert stats[0][0] == pytest.approx(np.mean(full.ch0), abs=1e-5) and stats[0][1] == pytest.approx(np.std(full.ch0), abs=1e-4)


def test_generator_and_run(spark, tmp_path):
    hits, truth = synth.synth_hits(spark, 3e6)
    pulses = synth.synth_edges(spark, 3e6)
    assert hits.where("x_pix < 0 or x_pix > 255 or y_pix < 0 or y_pix > 255 or tot < 1").count() == 0 and truth.count() > 10
    assert truth.where("species = 'slow'").agg(F.avg((F.col("wrap_count") > 0).cast("int"))).first()[0] > 0.5
    assert sorted(r.time_ns for r in pulses.collect()) == [r.time_ns for r in pulses.orderBy("pulse").collect()]
    again = synth.synth_hits(spark, 3e6)[0]
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, again.repartition(3).collect()))
    out = pipeline.run(hits, pulses, str(tmp_path), sources.Config(em_iterations=20, extra={"rounds": 4}), trees=3)
    assert abs(sources.load_period(spark, str(tmp_path)) - 1785) < 1
    assert out["clusters"].where("tof_valid and not folded_tof_ns between 0 and 1786").count() == 0
    assert "## counts" in pipeline.markdown(out)
    text = pipeline.diagnostics(out)
    assert "## bimodality" in text and "## reliability" in text and "Not measured" in text
    scored = {r.cluster_id: r.predicted_label for r in out["clusters"].where("hard_label >= 0").collect()}
    kept = learning.load_model(f"{tmp_path}/boosted.model")
    again = learning.predict(out["clusters"].drop("predicted_label"), kept).where("hard_label >= 0").collect()
    assert len(scored) > 100 and {r.cluster_id: r.predicted_label for r in again} == scored
    fitted = network.load(spark, f"{tmp_path}/network.model")
    rows = spark.read.parquet(f"{tmp_path}/aligned.parquet").where("split = 'test'")
    right = fitted.transform(rows).where("prediction = hard_label").count() / rows.count()
    accuracy = out["network_scores"].where("class = 'accuracy'").first()
    assert right == pytest.approx(accuracy.recall, abs=1e-5)
    with pytest.raises(RuntimeError, match="no cluster"):
        synth.synth_hits(spark, 1.0)


def test_stream_gives_the_clusters_of_the_batch(spark, tmp_path):
    hits = synth.synth_hits(spark, 2e6)[0].withColumn("time_ns", F.floor("time_ns").cast("double"))
    last = spark.createDataFrame([(0, 0, 9e9, 1, 0, 1 << 60)], hits.schema)
    n = 4
    ordered = hits.orderBy("arrival").collect()
    for i in range(n):
        part = ordered[i * len(ordered) // n : (i + 1) * len(ordered) // n]
        spark.createDataFrame(part, hits.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_clusters(stream, late_ns=2_000_000).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, stream_clusters(hits).collect()))


def test_labels_agree_with_the_truth_of_generated_data(spark):
    """The background's share of labels is near the share of clusters that wrapped by the generator's truth."""
    hits, truth = synth.synth_hits(spark, 3e6)
    pulses = synth.synth_edges(spark, 3e6)
    clusters = tof.attach_tof(features.cluster_features(synth_clusters := clustering.cluster_hits(hits)), pulses, 1785.0)
    labelled, _ = mixture.label_clusters(clusters, 1785.0, [175.0, 250.0], [20.0, 20.0], 50)
    known = labelled.where("hard_label >= 0")
    background = known.agg(F.avg((F.col("hard_label") == 2).cast("int"))).first()[0]
    wrapped = truth.agg(F.avg((F.col("wrap_count") > 0).cast("int"))).first()[0]
    assert abs(background - wrapped) < 0.25
    if hits.where("given_id is not null").count():
        matched = contamination.match_truth(synth_clusters)
        assert matched.count() == matched.select("cluster_id").distinct().count()


def test_checks_on_load_and_raw_columns(spark, tmp_path):
    times(spark, [5e9 - i * 1e6 for i in range(50)]).coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    with pytest.warns(UserWarning, match="time order"):
        sources.load_edges(spark, str(tmp_path / "e.parquet"))
    assert sources.load_edges(spark, str(tmp_path / "e.parquet"), check=False).count() == 50
    (tmp_path / "rawpart.py").write_text("def read(path):\n    yield (1, 2, 3.0, int(path))\n")
    spark.sparkContext.addPyFile(str(tmp_path / "rawpart.py"))
    df = sources.load_raw(spark, ["7", "8"], "rawpart:read", {"col": "x_pix", "row": "y_pix"}, "col int, row int, time_ns double, tot int")
    assert sorted(map(tuple, df.collect())) == [(1, 2, 3.0, 7), (1, 2, 3.0, 8)]


def test_soft_labels_and_early_stop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), int(x + y > 0), 0.9 if x + y <= 0 else 0.1, 0.9 if x + y > 0 else 0.1) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "cluster_id long, x double, y double, hard_label int, p0 double, p1 double")
    model = learning.fit_perceptron(df.limit(200), ["x", "y"], "hard_label", 2, hidden=4, steps=60, val=df.offset(200), round_steps=15)
    assert model.transform(df).where("prediction = hard_label").count() >= 280
    soft = df.withColumns({"scalars": F.array("x", "y"), "target": network.posterior(["p0", "p1"])})
    fitted = network.fit(soft.limit(200), soft.offset(200), 0, 2, hidden=16, dropout=0.0, rate=2e-2)
    assert fitted.transform(soft).where("prediction = hard_label").count() >= 280
