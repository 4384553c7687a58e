"""Stages by themselves, resumed runs, and figures."""

import xml.etree.ElementTree as ET

import pytest
from hitflow import __main__ as cli
from hitflow.operators import features
from hitflow.plans import figures, pipeline
from pyspark.sql import functions as F

SETTINGS = "em_iterations: 20\nrounds: 1\nsweep: true\ntrees: leafwise\nrounds_of_trees: 1\n"


def rows(spark, folder, name):
    return sorted(map(str, spark.read.parquet(f"{folder}/{name}.parquet").collect()))


def test_stage_by_stage_equals_the_whole_run(spark, tmp_path):
    whole, single = str(tmp_path / "whole"), str(tmp_path / "single")
    (tmp_path / "c.yaml").write_text(SETTINGS)
    common = ["--config", str(tmp_path / "c.yaml"), "--synth", "4e6"]
    text = cli.main(["run", "--out", whole, *common, "--no-figures"])
    assert "## network_scores" in text and "# Diagnostics" in text
    for command in ("load", *pipeline.STAGES):
        cli.main([command, "--out", single, *common])
    for name in ("cluster_pixels", "features", "clusters_tof", "clusters_labelled", "mixture", "split", "clusters_predicted", "importances", "confusion", "sweep"):
        assert rows(spark, whole, name) == rows(spark, single, name), name

    drawn = sorted(p.name for p in (tmp_path / "single/figures").glob("*.svg"))
    wanted = ["clustering_sweep", "confusion_matrix", "edge_gaps", "edge_gaps_over_time", "labels_confidence", "labels_fit", "network_confusion_matrix", "network_reliability", "timewalk", "timewalk_size", "tof_charge", "tof_spectrum", "tree_importances"]
    assert {f"{w}.svg" for w in wanted} <= set(drawn) and any(d.startswith("network_saliency_") for d in drawn) and sum(d.startswith("morphology_") for d in drawn) == 4
    for name in drawn:
        root = ET.parse(tmp_path / "single/figures" / name).getroot()
        assert root.tag.endswith("svg") and len(list(root)) > 10, name
        assert spark.read.json(f"{single}/figures/{name[:-4]}.json").count() > 0

    before = rows(spark, single, "clusters_tof")
    (tmp_path / "d.yaml").write_text(SETTINGS.replace("20", "3"))
    cli.main(["resume", "--from", "labels", "--out", single, "--config", str(tmp_path / "d.yaml"), "--no-classifier", "--no-figures"])
    assert rows(spark, single, "clusters_tof") == before and rows(spark, single, "mixture") != rows(spark, whole, "mixture")
    assert not (tmp_path / "single/clusters_predicted.parquet").exists() and not (tmp_path / "single/figures").exists()
    with pytest.raises(FileNotFoundError, match="'load'"):
        cli.main(["clusters", "--out", str(tmp_path / "none")])
    with pytest.raises(ValueError, match="no stage"):
        pipeline.run_stages(pipeline.Work(spark, single, pipeline.Config()), ["other"])


def test_time_walk_scatter_has_its_columns(spark):
    df = spark.createDataFrame([(1, 3, -900.0, 4.5), (2, 90, 5000.0, 7.5), (3, 3, -900.0, 5.5)], "cluster_id long, n_pixels long, dt_min_vs_argmax double, tot_mean double")
    assert [tuple(r) for r in features.timewalk_points(df).orderBy("cluster_id").collect()] == [(1, 3, -200.0, 4.5), (2, 90, 2000.0, 7.5), (3, 3, -200.0, 5.5)]
    cells = {(r.bin_x, r.bin_y): (r.n, r.mean_tot) for r in figures.timewalk_cells(df).collect()}
    assert cells == {(3, 0): (2, 5.0), (59, 79): (1, 7.5)}


def test_drawings_of_nothing_and_of_odd_names(spark, tmp_path):
    empty = spark.range(0).select(F.col("id").cast("int").alias("bin"), F.col("id").alias("n"))
    kept = figures.draw("none", empty, lambda r: figures.bars(r, "a < b & c", "x", 0, 1, 10), str(tmp_path))
    assert kept.count() == 0 and ET.parse(tmp_path / "figures/none.svg").getroot() is not None
    for svg in (figures.grid([], "t", "x", "y", (0, 1, 2), (0, 1, 2)), figures.named_bars([], "t", "x"), figures.matrix([], "t"), figures.lines([], "t", "x", "y", "a", "b", "c")):
        ET.fromstring(svg)
