"""Registered queries over the test tables, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import clustering, contamination, edges, features, learning, mixture, network, patches, quality, synth, tof, trees
from ..sources import adapters
from ..streaming import stream_clusters
from .figures import timewalk_cells
from .pipeline import saliency_means

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MEANS, STDS, STEPS = [175.0, 250.0], [20.0, 20.0], 5

CTE = {
    "hits": adapters.HITS_SQL,
    "edges": adapters.EDGES_SQL,
    "gaps": "SELECT * FROM (SELECT time_ns, time_ns - lag(time_ns) OVER (ORDER BY time_ns) AS gap FROM edges) WHERE gap IS NOT NULL",
    "per": "SELECT median(gap) AS p FROM gaps",
    "cuts": "SELECT *, CASE WHEN lag(time_ns) OVER (ORDER BY time_ns) IS NULL OR time_ns - lag(time_ns) OVER (ORDER BY time_ns) > {dt} THEN time_ns END AS cut FROM hits",
    "epochs": "SELECT *, max(cut) OVER (ORDER BY time_ns) AS epoch FROM cuts",
    "numbered": "SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY time_ns, x_pix, y_pix, tot, given_id) AS k, x_pix AS x, y_pix AS y, time_ns AS t, tot, given_id AS g FROM epochs",
    "fold": """SELECT epoch, k, [{{'x': x, 'y': y, 't': t, 'tot': tot, 'g': g, 'c': 0}}] AS m FROM numbered WHERE k = 1 UNION ALL
  SELECT epoch, k, list_concat([{{'x': a.x, 'y': a.y, 't': a.t, 'tot': a.tot, 'g': a.g, 'c': CASE WHEN list_contains(hc, a.c) THEN nc ELSE a.c END}} for a in m], [{{'x': x, 'y': y, 't': t, 'tot': tot, 'g': g, 'c': nc}}])
  FROM (SELECT *, coalesce(list_min(hc), CAST(k - 1 AS INT)) AS nc FROM (SELECT n.*, f.m,
    list_distinct([a.c for a in f.m if abs(a.x - n.x) <= {d} and abs(a.y - n.y) <= {d} and n.t - {edge}([b.t for b in f.m if b.c = a.c]) <= {dt}]) AS hc
    FROM fold f JOIN numbered n ON f.epoch = n.epoch AND n.k = f.k + 1))""",
    "members": "SELECT epoch, unnest(m) AS e FROM (SELECT epoch, arg_max(m, k) AS m FROM fold GROUP BY epoch)",
    "labelled": "SELECT epoch, e.c AS c, e.x AS x_pix, e.y AS y_pix, e.t AS time_ns, e.tot AS tot, e.g AS g FROM members",
    "ids": "SELECT epoch, c, row_number() OVER (ORDER BY t0, x0, y0) - 1 AS cluster_id FROM (SELECT epoch, c, min(time_ns) AS t0, arg_min(x_pix, (time_ns, x_pix, y_pix)) AS x0, arg_min(y_pix, (time_ns, x_pix, y_pix)) AS y0 FROM labelled GROUP BY epoch, c)",
    "clustered": "SELECT cluster_id, time_ns, x_pix, y_pix, tot, g FROM labelled JOIN ids USING (epoch, c)",
    "sums": """SELECT given_id AS cluster_id, count(*) AS n_pixels, min(time_ns) AS t_min, max(time_ns) AS t_max, CAST(sum(tot) AS HUGEINT) AS s, CAST(sum(tot * x_pix) AS HUGEINT) AS sx, CAST(sum(tot * y_pix) AS HUGEINT) AS sy,
  CAST(sum(tot * x_pix * x_pix) AS HUGEINT) AS sxx, CAST(sum(tot * x_pix * y_pix) AS HUGEINT) AS sxy, CAST(sum(tot * y_pix * y_pix) AS HUGEINT) AS syy, max(tot) AS tm,
  max(x_pix) - min(x_pix) + 1 AS bw, max(y_pix) - min(y_pix) + 1 AS bh, arg_max(time_ns, (tot, -time_ns)) AS t_argmax_tot FROM hits GROUP BY given_id""",
    "cov": "SELECT *, CAST(s * sxx - sx * sx AS DOUBLE) / (CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) AS vx, CAST(s * syy - sy * sy AS DOUBLE) / (CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) AS vy, CAST(s * sxy - sx * sy AS DOUBLE) / (CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) AS vxy FROM sums",
    "eig": "SELECT *, (vx + vy) / 2 + sqrt((vx - vy) / 2 * ((vx - vy) / 2) + vxy * vxy) AS l2, (vx + vy) / 2 - sqrt((vx - vy) / 2 * ((vx - vy) / 2) + vxy * vxy) AS l1, n_pixels >= 2 AND vx + vy > 1e-12 AS ok FROM cov",
    "feats": """SELECT cluster_id, n_pixels, CAST(s AS DOUBLE) AS tot_sum, CAST(tm AS DOUBLE) AS tot_max, CAST(s AS DOUBLE) / n_pixels AS tot_mean, CAST(sx AS DOUBLE) / CAST(s AS DOUBLE) AS cx_w, CAST(sy AS DOUBLE) / CAST(s AS DOUBLE) AS cy_w,
  CAST(bw AS DOUBLE) AS bbox_w, CAST(bh AS DOUBLE) AS bbox_h, CASE WHEN ok THEN sqrt(greatest(0.0, 1 - l1 / greatest(l2, 1e-12))) ELSE 0.0 END AS eccentricity, CASE WHEN ok THEN l2 / (vx + vy) ELSE 0.0 END AS linearity,
  CAST(n_pixels AS DOUBLE) / (bw * bh) AS compactness, t_min, t_max, t_argmax_tot, t_argmax_tot - t_min AS dt_min_vs_argmax FROM eig""",
    "raw": "SELECT f.*, f.t_min AS cluster_time_ns, f.t_min - e.time_ns AS raw_tof_ns FROM feats f ASOF LEFT JOIN edges e ON f.t_min >= e.time_ns",
    "tof": "SELECT raw.*, raw_tof_ns % p AS folded_tof_ns, raw_tof_ns IS NOT NULL AS tof_valid FROM raw, per",
    "xs": "SELECT folded_tof_ns AS x FROM tof WHERE tof_valid",
    "e0": "SELECT p, 1/3.0::DOUBLE AS w0, 1/3.0::DOUBLE AS w1, 1/3.0::DOUBLE AS wb, 175.0::DOUBLE AS m0, 250.0::DOUBLE AS m1, 20.0::DOUBLE AS s0, 20.0::DOUBLE AS s1 FROM per",
    **{
        f"e{i}": f"""SELECT p, n0 / n AS w0, n1 / n AS w1, nb / n AS wb, m0, m1, greatest(1.0, sqrt(greatest(0.0, (q0 - 2 * m0 * x0 + m0 * m0 * n0) / n0))) AS s0, greatest(1.0, sqrt(greatest(0.0, (q1 - 2 * m1 * x1 + m1 * m1 * n1) / n1))) AS s1
  FROM (SELECT *, x0 / n0 AS m0, x1 / n1 AS m1 FROM (SELECT any_value(p) AS p, CAST(count(*) AS DOUBLE) AS n, sum(d0 / t) AS n0, sum(d1 / t) AS n1, sum(db / t) AS nb, sum(d0 / t * x) AS x0, sum(d1 / t * x) AS x1, sum(d0 / t * x * x) AS q0, sum(d1 / t * x * x) AS q1
  FROM (SELECT *, d0 + d1 + db AS t FROM (SELECT x, p, w0 * exp(((x - m0) / s0) * ((x - m0) / s0) * -0.5) / (s0 * 2.5066282746310002) AS d0, w1 * exp(((x - m1) / s1) * ((x - m1) / s1) * -0.5) / (s1 * 2.5066282746310002) AS d1, wb / p AS db FROM xs, e{i - 1}))))"""
        for i in range(1, STEPS + 1)
    },
    "dens": f"SELECT tof.*, CASE WHEN tof_valid THEN w0 * exp(((folded_tof_ns - m0) / s0) * ((folded_tof_ns - m0) / s0) * -0.5) / (s0 * 2.5066282746310002) END AS d0, CASE WHEN tof_valid THEN w1 * exp(((folded_tof_ns - m1) / s1) * ((folded_tof_ns - m1) / s1) * -0.5) / (s1 * 2.5066282746310002) END AS d1, CASE WHEN tof_valid THEN wb / p END AS db FROM tof, e{STEPS}",
    "post": "SELECT *, d0 / t AS posterior_peak_0, d1 / t AS posterior_peak_1, db / t AS posterior_background, greatest(d0 / t, d1 / t, db / t) AS label_confidence FROM (SELECT *, d0 + d1 + db AS t FROM dens)",
    "lab": "SELECT *, CASE WHEN NOT tof_valid THEN NULL WHEN label_confidence < 0.9 THEN -1 WHEN posterior_peak_0 = label_confidence THEN 0 WHEN posterior_peak_1 = label_confidence THEN 1 ELSE 2 END AS hard_label FROM post",
    "pred": "SELECT *, CASE WHEN hard_label >= 0 THEN CASE WHEN n_pixels >= 3 THEN 1 ELSE 0 END END AS predicted_label FROM lab",
    "split": "SELECT *, CASE WHEN r < CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train' WHEN r < CAST(floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY t_min, cluster_id) - 1 AS r, count(*) OVER () AS n FROM lab WHERE hard_label >= 0)",
    "centre": "SELECT given_id AS cluster_id, min(time_ns) AS start, arg_min(x_pix, (-tot, time_ns, x_pix, y_pix)) AS tx, arg_min(y_pix, (-tot, time_ns, x_pix, y_pix)) AS ty FROM hits GROUP BY given_id",
    "cells": "SELECT given_id AS cluster_id, x_pix - tx + 8 AS px, y_pix - ty + 8 AS py, time_ns, tot, start FROM hits JOIN centre ON given_id = cluster_id WHERE x_pix - tx + 8 BETWEEN 0 AND 15 AND y_pix - ty + 8 BETWEEN 0 AND 15",
    "patch": "SELECT cluster_id, px, py, ln(1 + CAST(arg_max(tot, (time_ns, tot)) AS DOUBLE)) AS ch0, least(greatest(max(time_ns) - min(start), 0.0), 2000.0) AS ch1 FROM cells GROUP BY cluster_id, px, py",
}
ORDER = list(CTE)


def with_ctes(last: str, sql: str, dt: float = 2000, gap: int = 0, criterion: str = "chain") -> str:
    """The query with every CTE up to `last`."""
    own = {k: CTE[k].format(dt=dt, d=gap + 1, edge="list_max" if criterion == "chain" else "list_min") if k in ("cuts", "fold") else CTE[k] for k in ORDER[: ORDER.index(last) + 1]}
    if ORDER.index(last) > ORDER.index("clustered"):  # later stages use given groups
        own = {k: v for k, v in own.items() if k not in ("cuts", "epochs", "numbered", "fold", "members", "labelled", "ids", "clustered")}
    names = ", ".join(f"{k}{'(epoch, k, m)' if k == 'fold' else ''} AS {'MATERIALIZED ' if k in ('tof', 'xs', 'lab') else ''}({v})" for k, v in own.items())
    return f"WITH RECURSIVE {names}\n{sql}"


def query(last: str | None = None, sql: str | None = None, **settings):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_ctes(last, sql, **settings) if last else sql
        return f

    return add


def bins_sql(x: str, low: str, high: str, n: int) -> str:
    return f"CASE WHEN {x} >= {low} AND {x} <= {high} THEN least(CAST(floor(({x} - {low}) / (({high} - {low}) / {n})) AS INT), {n - 1}) END"


def hits(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hits(spark, d)


def period(spark: SparkSession, d: str) -> float:
    return edges.measure_period(adapters.edges(spark, d))


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).withColumnRenamed("given_id", "cluster_id")


def feats(spark: SparkSession, d: str) -> DataFrame:
    return features.cluster_features(grouped(spark, d))


def flown(spark: SparkSession, d: str, p: float | None = None) -> DataFrame:
    return tof.attach_tof(feats(spark, d), adapters.edges(spark, d), p or period(spark, d))


def fitted(spark: SparkSession, d: str) -> tuple[DataFrame, mixture.Mixture]:
    p = period(spark, d)
    own = fn.saved(flown(spark, d, p))  # read by the fit and by what comes after
    m = mixture.fit(own, "folded_tof_ns", mixture.Mixture.start(p, MEANS, STDS), STEPS, tolerance=0.0)
    return own, m


def labels(spark: SparkSession, d: str) -> DataFrame:
    return mixture.assign(*fitted(spark, d))


def ruled(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a fixed rule in the place of a classifier."""
    rule = F.when(F.col("hard_label") >= 0, F.when(F.col("n_pixels") >= 3, 1).otherwise(0))
    return labels(spark, d).withColumn("predicted_label", rule)


def six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def six_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- sources and quality


@query("hits", "SELECT x_pix, y_pix, time_ns, tot FROM hits")
def s_scan_hits(spark, d):
    return hits(spark, d).select("x_pix", "y_pix", "time_ns", "tot")


@query("hits", "SELECT x_pix AS col, y_pix AS row_no, time_ns AS t FROM hits")
def s_rename(spark, d):
    return hits(spark, d).select("x_pix", "y_pix", "time_ns").withColumnsRenamed({"x_pix": "col", "y_pix": "row_no", "time_ns": "t"})


@query(None, "SELECT count(ok) AS n_pairs, avg(CAST(ok AS INT)) AS monotone_fraction FROM (SELECT value >= lag(value) OVER (ORDER BY event_id) AS ok FROM events WHERE value IS NOT NULL)")
def q_monotone(spark, d):
    return quality.monotone_fraction(spark.read.parquet(f"{d}/events.parquet"), "value", "event_id", 1000)


@query("edges", "SELECT (max(time_ns) - min(time_ns)) / 1e9 AS span_s, (max(time_ns) - min(time_ns)) / 1e9 BETWEEN 1e-6 AND 3600 AS plausible FROM edges")
def q_span(spark, d):
    return quality.span(adapters.edges(spark, d), "time_ns")


# --- edges


@query("gaps", "SELECT time_ns, gap FROM gaps")
def a_gaps(spark, d):
    return edges.gaps(adapters.edges(spark, d))


@query("per", "SELECT p AS period_ns FROM per")
def a_period(spark, d):
    return spark.createDataFrame([(period(spark, d),)], "period_ns double")


@query("gaps", "SELECT round(stddev_pop(gap), 6) AS period_std_ns FROM gaps")
def a_spread(spark, d):
    return edges.gaps(adapters.edges(spark, d)).agg(F.round(F.stddev_pop("gap"), 6).alias("period_std_ns"))


@query("per", "SELECT count(*) AS n_missed_gaps FROM gaps, per WHERE gap / p >= 1.5 AND gap / p < 100")
def a_missed_edges(spark, d):
    counts = edges.gap_counts(adapters.edges(spark, d))
    return edges.edge_report(adapters.edges(spark, d), edges.measure_period(None, counts=counts), counts=counts).select("n_missed_gaps")


@query(
    "per",
    """SELECT period_ns, round(sd, 6) AS period_std_ns, n + 1 AS n_edges, n_missed_gaps, n_missing, round(n_missing / greatest(span_ns / period_ns + 1, 1.0), 6) AS fraction_affected, span_ns, n * period_ns AS expected_span_ns, abs(span_ns - n * period_ns) AS span_difference_ns
FROM (SELECT any_value(p) AS period_ns, stddev_pop(gap) AS sd, count(*) AS n, count(*) FILTER (gap / p >= 1.5 AND gap / p < 100) AS n_missed_gaps, CAST(coalesce(sum(round_even(gap / p - 1, 0)) FILTER (gap / p >= 1.5 AND gap / p < 100), 0) AS BIGINT) AS n_missing, sum(gap) AS span_ns FROM gaps, per)""",
)
def a_report(spark, d):
    counts = edges.gap_counts(adapters.edges(spark, d))
    return edges.edge_report(adapters.edges(spark, d), edges.measure_period(None, counts=counts), counts=counts)


@query("gaps", f"SELECT bin, count(*) AS n FROM (SELECT {bins_sql('gap', '0.0::DOUBLE', '9000.0::DOUBLE', 200)} AS bin FROM gaps) WHERE bin IS NOT NULL GROUP BY bin")
def a_gap_hist(spark, d):
    return edges.gap_histogram(adapters.edges(spark, d), 0.0, 9000.0, 200)


@query("per", "SELECT time_ns, least(greatest(gap, 0), 5 * p) AS gap FROM gaps, per")
def a_gap_sequence(spark, d):
    return edges.gap_sequence(adapters.edges(spark, d), period(spark, d))


# --- clustering

CLUSTER = ["cluster_id", "n_pixels", "t_min", "t_max"]


@query("epochs", "SELECT epoch, count(*) AS n FROM epochs GROUP BY epoch")
def b_epochs(spark, d):
    return clustering.epochs(hits(spark, d), 2000.0).groupBy("epoch").agg(F.count("*").alias("n"))


@query("clustered", "SELECT cluster_id, count(*) AS n_pixels, min(time_ns) AS t_min, max(time_ns) AS t_max FROM clustered GROUP BY cluster_id")
def b_clusters(spark, d):
    return clustering.clusters(hits(spark, d)).select(*CLUSTER)


@query("clustered", "SELECT cluster_id, time_ns, x_pix, y_pix, tot FROM clustered", gap=1)
def b_cluster_pixels(spark, d):
    return clustering.cluster_hits(hits(spark, d).drop("given_id"), max_gap=1).drop("key")


@query("clustered", "SELECT cluster_id, count(*) AS n_pixels, min(time_ns) AS t_min, max(time_ns) AS t_max FROM clustered GROUP BY cluster_id", dt=15, criterion="min")
def b_clusters_min(spark, d):
    return clustering.clusters(hits(spark, d), 15.0, time_criterion="min").select(*CLUSTER)


@query("clustered", "SELECT cluster_id, count(*) AS n_pixels, min(time_ns) AS t_min, max(time_ns) AS t_max FROM clustered GROUP BY cluster_id", dt=8)
def b_clusters_short(spark, d):
    return clustering.clusters(hits(spark, d), 8.0).select(*CLUSTER)


def _sweep_sql() -> str:
    one = "SELECT {dt}::DOUBLE AS dt_ns, {gap} AS max_gap, count(*) AS n_clusters, round(avg(n), 6) AS mean_size, median(n) AS median_size, round(quantile_cont(n, 0.95), 6) AS p95_size FROM (SELECT cluster_id, count(*) AS n FROM clustered GROUP BY cluster_id)"
    return " UNION ALL ".join(f"SELECT * FROM ({with_ctes('clustered', one.format(dt=dt, gap=gap), dt=dt, gap=gap)})" for dt in (15, 2000) for gap in (0, 1))


@query(None, _sweep_sql())
def b_sweep(spark, d):
    return clustering.sweep(hits(spark, d), [15.0, 2000.0], [0, 1])


# --- features

C_ALL = ["tot_mean", "cx_w", "cy_w", "eccentricity", "linearity", "compactness"]


@query("feats", "SELECT cluster_id, n_pixels, tot_sum, tot_max, round(tot_mean, 6) AS tot_mean FROM feats")
def c_basic(spark, d):
    return feats(spark, d).select("cluster_id", "n_pixels", "tot_sum", "tot_max", *six("tot_mean"))


@query("feats", f"SELECT cluster_id, {six_sql('cx_w', 'cy_w', 'compactness')}, bbox_w, bbox_h FROM feats")
def c_centroid_bbox(spark, d):
    return feats(spark, d).select("cluster_id", *six("cx_w", "cy_w", "compactness"), "bbox_w", "bbox_h")


@query("feats", f"SELECT cluster_id, {six_sql('eccentricity', 'linearity')} FROM feats")
def c_pca(spark, d):
    return feats(spark, d).select("cluster_id", *six("eccentricity", "linearity"))


@query("feats", "SELECT cluster_id, t_min, t_argmax_tot, dt_min_vs_argmax FROM feats")
def c_argmax_time(spark, d):
    return feats(spark, d).select("cluster_id", "t_min", "t_argmax_tot", "dt_min_vs_argmax")


@query("feats", f"SELECT cluster_id, n_pixels, tot_sum, tot_max, bbox_w, bbox_h, t_min, t_max, t_argmax_tot, dt_min_vs_argmax, {six_sql(*C_ALL)} FROM feats")
def c_all(spark, d):
    base = grouped(spark, d).groupBy("cluster_id").agg(F.min("time_ns").alias("t_min"))
    return features.merge_features(base, feats(spark, d)).select("cluster_id", "n_pixels", "tot_sum", "tot_max", "bbox_w", "bbox_h", "t_min", "t_max", "t_argmax_tot", "dt_min_vs_argmax", *six(*C_ALL))


@query("feats", f"SELECT bin, count(*) AS n FROM (SELECT {bins_sql('least(greatest(dt_min_vs_argmax, -200.0), 2000.0)', '-200.0::DOUBLE', '2000.0::DOUBLE', 100)} AS bin FROM feats) GROUP BY bin")
def c_timewalk(spark, d):
    return features.timewalk_histogram(feats(spark, d))


@query("feats", "SELECT cluster_id, n_pixels, least(greatest(dt_min_vs_argmax, -200.0), 2000.0) AS dt_clipped, round(tot_mean, 6) AS tot_mean FROM feats")
def c_timewalk_points(spark, d):
    return features.timewalk_points(feats(spark, d)).select("cluster_id", "n_pixels", "dt_clipped", *six("tot_mean"))


@query("feats", f"SELECT bin_x, bin_y, count(*) AS n, round(avg(tot_mean), 6) AS mean_tot FROM (SELECT tot_mean, {bins_sql('least(CAST(n_pixels AS DOUBLE), 60.0)', '0.0::DOUBLE', '60.0::DOUBLE', 60)} AS bin_x, {bins_sql('least(greatest(dt_min_vs_argmax, -200.0), 2000.0)', '-200.0::DOUBLE', '2000.0::DOUBLE', 80)} AS bin_y FROM feats) GROUP BY bin_x, bin_y")
def c_timewalk_cells(spark, d):
    """The scatter by cells, as it is drawn."""
    return timewalk_cells(feats(spark, d))


# --- time of flight


@query("raw", "SELECT cluster_id, t_min, raw_tof_ns FROM raw")
def d_asof(spark, d):
    return flown(spark, d, 1785.0).select("cluster_id", "t_min", "raw_tof_ns")


@query("tof", "SELECT cluster_id, raw_tof_ns, folded_tof_ns, tof_valid FROM tof")
def d_fold(spark, d):
    return flown(spark, d).select("cluster_id", "raw_tof_ns", "folded_tof_ns", "tof_valid")


@query("tof", "SELECT n_valid, n_wrapped, round(n_wrapped * 100.0 / greatest(n_valid, 1), 6) AS wrapped_percent FROM (SELECT count(*) FILTER (tof_valid) AS n_valid, count(*) FILTER (abs(raw_tof_ns - folded_tof_ns) > 0.5) AS n_wrapped FROM tof)")
def d_wrap_count(spark, d):
    return tof.wrap_report(flown(spark, d))


@query("tof", f"SELECT bin, count(*) AS n, round(avg(tot_sum), 6) AS mean_tot FROM (SELECT tot_sum, {bins_sql('folded_tof_ns', '0.0::DOUBLE', 'p', 199)} AS bin FROM tof, per) WHERE bin IS NOT NULL GROUP BY bin")
def d_spectrum(spark, d):
    p = period(spark, d)
    own = flown(spark, d, p).withColumn("bin", fn.bin_of(F.col("folded_tof_ns"), 0.0, p, 199)).where("bin is not null")
    return own.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("tot_sum"), 6).alias("mean_tot"))


@query("tof", f"SELECT bin_x, bin_y, count(*) AS n FROM (SELECT {bins_sql('folded_tof_ns', '0.0::DOUBLE', 'p', 149)} AS bin_x, {bins_sql('ln(1 + tot_sum)', '0.0::DOUBLE', '10.0::DOUBLE', 99)} AS bin_y FROM tof, per) WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY bin_x, bin_y")
def d_hist2d(spark, d):
    p = period(spark, d)
    return tof.charge_map(flown(spark, d, p), p, 10.0)


@query("tof", "SELECT count(x) AS n, round(avg(x), 6) AS mean_difference, max(x) AS max_difference FROM (SELECT abs((f.t_min - a.time_ns) % p - (f.t_argmax_tot - b.time_ns) % p) AS x FROM feats f ASOF LEFT JOIN edges a ON f.t_min >= a.time_ns ASOF LEFT JOIN edges b ON f.t_argmax_tot >= b.time_ns CROSS JOIN per)")
def d_mode_compare(spark, d):
    return tof.compare_modes(feats(spark, d), adapters.edges(spark, d), period(spark, d))


@query(
    None,
    "SELECT e.event_id, epoch_us(e.ts) - epoch_us(s.ts) AS since_us FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT ts FROM events WHERE event_type = 'signup') s ON e.ts >= s.ts",
)
def d_asof_events(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    low = events.agg(F.min("us")).first()[0] or 0
    events = events.withColumn("t", (F.col("us") - low).cast("double"))
    met = tof.asof_backward(events.where("event_type <> 'signup'").select("event_id", "t"), events.where("event_type = 'signup'").select(F.col("t").alias("edge")), "t", "edge", slice_ns=3.6e9)
    return met.select("event_id", (F.col("t") - F.col("edge_ns")).cast("long").alias("since_us"))


# --- labels


@query("dens", "SELECT cluster_id, round(d0, 9) AS peak_0, round(d1, 9) AS peak_1, round(db, 9) AS background FROM dens")
def f_densities(spark, d):
    own, m = fitted(spark, d)
    return own.select("cluster_id", *(F.round(c, 9).alias(n) for n, c in zip(m.names, m.densities(F.col("folded_tof_ns")), strict=True)))


@query(f"e{STEPS}", f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('w0', 'w1', 'wb', 'm0', 'm1', 's0', 's1'))} FROM e{STEPS}")
def f_em_5iter(spark, d):
    _, m = fitted(spark, d)
    return spark.createDataFrame([[round(float(x), 6) for x in (*m.weights, *m.means, *m.stds)]], "w0 double, w1 double, wb double, m0 double, m1 double, s0 double, s1 double")


@query("post", f"SELECT cluster_id, {six_sql('posterior_peak_0', 'posterior_peak_1', 'posterior_background', 'label_confidence')} FROM post")
def f_posteriors(spark, d):
    return labels(spark, d).select("cluster_id", *six("posterior_peak_0", "posterior_peak_1", "posterior_background", "label_confidence"))


@query("lab", "SELECT cluster_id, hard_label FROM lab")
def f_hard_labels(spark, d):
    return labels(spark, d).select("cluster_id", "hard_label")


@query("lab", "SELECT hard_label, count(*) AS n FROM lab GROUP BY hard_label")
def f_label_counts(spark, d):
    return mixture.label_counts(labels(spark, d))


@query("lab", f"SELECT bin, count(*) AS n FROM (SELECT {bins_sql('label_confidence', '0.0::DOUBLE', '1.0::DOUBLE', 50)} AS bin FROM lab) WHERE bin IS NOT NULL GROUP BY bin")
def f_confidence_hist(spark, d):
    return mixture.confidence_histogram(labels(spark, d))


@query(f"e{STEPS}", f"SELECT round(x, 6) AS x, round((w0 * exp(((x - m0) / s0) * ((x - m0) / s0) * -0.5) / (s0 * 2.5066282746310002) + w1 * exp(((x - m1) / s1) * ((x - m1) / s1) * -0.5) / (s1 * 2.5066282746310002) + wb / p) * n * p / 199, 6) AS expected FROM (SELECT i * (p / 999) AS x, e.*, (SELECT count(*) FROM xs) AS n FROM e{STEPS} e, range(1000) AS r(i))")
def f_fit_curve(spark, d):
    own, m = fitted(spark, d)
    return mixture.fit_curve(own, m)[1].select(*six("x", "expected"))


# --- splits and measures


@query("lab", "SELECT cluster_id, hard_label FROM lab WHERE hard_label >= 0")
def h_labelled(spark, d):
    return learning.labelled(labels(spark, d)).select("cluster_id", "hard_label")


@query("split", "SELECT cluster_id, split FROM split")
def h_split(spark, d):
    return learning.time_block_split(learning.labelled(labels(spark, d))).select("cluster_id", "split")


@query("split", "SELECT split, count(*) AS n, min(t_min) AS first, max(t_min) AS last FROM split GROUP BY split")
def h_split_bounds(spark, d):
    split = learning.time_block_split(learning.labelled(labels(spark, d)))
    learning.check_split(split)
    return learning.split_bounds(split)


@query("pred", "SELECT hard_label AS label, predicted_label AS prediction, count(*) AS n FROM pred WHERE hard_label >= 0 AND predicted_label IS NOT NULL GROUP BY 1, 2")
def h_confusion(spark, d):
    return learning.confusion(ruled(spark, d).where("hard_label >= 0"), "hard_label", "predicted_label")


@query(
    "pred",
    """, k AS (SELECT hard_label AS l, predicted_label AS q FROM pred WHERE hard_label >= 0), c AS (SELECT DISTINCT l AS c FROM k UNION SELECT DISTINCT q FROM k),
r AS (SELECT c, (SELECT count(*) FROM k WHERE l = c) AS support, (SELECT count(*) FROM k WHERE q = c) AS claimed, (SELECT count(*) FROM k WHERE q = c AND l = c) AS hit FROM c),
m AS (SELECT *, CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM r), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM m),
u AS (SELECT CAST(c AS VARCHAR) AS class, pr AS precision, re AS recall, f AS f1, support FROM f UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM f UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f)
SELECT class, round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall, round(CAST(f1 AS DOUBLE), 6) AS f1, CAST(support AS BIGINT) AS support FROM u""",
)
def h_report(spark, d):
    return learning.class_report(ruled(spark, d).where("hard_label >= 0"), "hard_label", "predicted_label")


def _tree_rows(spark, d):
    """Labelled clusters with their blocks, as wide as what trees read."""
    own = learning.labelled(labels(spark, d)).select("cluster_id", "t_min", "hard_label", *features.MODEL_FEATURES)
    return fn.saved(learning.time_block_split(own, even=True))


def _boosted(spark, d):
    rows = _tree_rows(spark, d)
    return rows, learning.fit_boosted(rows)


@query()
def h_gbt(spark, d):
    rows, model = _boosted(spark, d)
    return learning.class_report(learning.predict(rows.where("split = 'test'"), model), "hard_label", "predicted_label")


@query()
def h_importance(spark, d):
    return learning.importances(_boosted(spark, d)[1])


def _leafwise(spark, d):
    rows = _tree_rows(spark, d)
    return rows, trees.fit(rows, features.MODEL_FEATURES, rounds=20)


@query()
def h_leafwise(spark, d):
    """Leaf-wise multiclass trees of up to 63 leaves, in as many rounds as h_gbt has."""
    rows, model = _leafwise(spark, d)
    return learning.class_report(model.transform(rows.where("split = 'test'")), "hard_label", "prediction")


@query()
def h_split_counts(spark, d):
    return _leafwise(spark, d)[1].split_counts(spark)


# --- contamination


@query("tof", "SELECT n, n_window, n_window / (n * 100.0::DOUBLE) AS density FROM (SELECT count(*) AS n, count(*) FILTER (folded_tof_ns >= 0 AND folded_tof_ns < 100) AS n_window FROM tof WHERE tof_valid)")
def g_baseline(spark, d):
    return contamination.baseline_density(flown(spark, d))


@query(
    "lab",
    "SELECT hard_label, count(*) AS n, round(least(1.0, (SELECT count(*) FILTER (folded_tof_ns < 100) / (count(*) * 100.0::DOUBLE) FROM lab WHERE tof_valid) * (max(folded_tof_ns) - min(folded_tof_ns))), 4) AS mislabel_fraction FROM lab WHERE hard_label >= 0 GROUP BY hard_label",
)
def g_class_fraction(spark, d):
    return contamination.class_fractions(labels(spark, d))


@query("pred", "SELECT hard_label, predicted_label, count(*) AS n FROM pred WHERE hard_label >= 0 AND label_confidence >= 0.95 AND hard_label <> predicted_label GROUP BY 1, 2")
def g_disagreement(spark, d):
    return contamination.disagreement(ruled(spark, d), 0.95)


@query("hits", "SELECT count(*) AS n, avg(CASE WHEN species = 9 THEN 1 ELSE 0 END) AS true_fraction, 0.2::DOUBLE AS estimate, abs(avg(CASE WHEN species = 9 THEN 1 ELSE 0 END) - 0.2::DOUBLE) AS error FROM (SELECT DISTINCT given_id, species FROM hits)")
def g_truth(spark, d):
    return contamination.truth_check(feats(spark, d), adapters.truth(hits(spark, d)), 0.2)


@query("lab", f"SELECT hard_label, bin, count(*) AS n FROM (SELECT hard_label, {bins_sql('tot_sum', '0.0::DOUBLE', '5000.0::DOUBLE', 50)} AS bin FROM lab WHERE hard_label >= 0) WHERE bin IS NOT NULL GROUP BY hard_label, bin")
def g_morphology_hist(spark, d):
    return contamination.morphology_histograms(labels(spark, d), "tot_sum", 0.0, 5000.0)


BIMODAL_STEPS = 10


def _bimodality_sql() -> str:
    """One and two Gaussians per class and feature, compared by BIC, with a fixed number of steps; a CTE for each step."""
    tidy = " UNION ALL ".join(f"SELECT hard_label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM lab WHERE hard_label >= 0" for f in contamination.MORPHOLOGY)
    log_p = lambda w, m, v: f"ln({w}) - (x - {m}) * (x - {m}) / (2 * {v}) - ln({v} * {2 * math.pi!r}) / 2"
    ctes = [
        f"tidy AS MATERIALIZED ({tidy})",
        "bx AS MATERIALIZED (SELECT hard_label, feature, ln(1 + (value - low + 1e-3)) AS x FROM tidy JOIN (SELECT hard_label, feature, min(value) AS low FROM tidy GROUP BY ALL HAVING count(*) >= 10) USING (hard_label, feature))",
        "b_one AS MATERIALIZED (SELECT hard_label, feature, CAST(count(*) AS DOUBLE) AS n, greatest(avg(x * x) - avg(x) * avg(x), 1e-6) AS v, quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.9) AS b FROM bx GROUP BY ALL)",
        "b0 AS (SELECT hard_label, feature, n, 0.5::DOUBLE AS w, a AS m1, b AS m2, v AS v1, v AS v2, 0.0::DOUBLE AS ll FROM b_one)",
    ]
    for i in range(1, BIMODAL_STEPS + 1):
        ctes.append(f"""b{i} AS MATERIALIZED (SELECT hard_label, feature, n, least(1 - 1e-6, greatest(1e-6, s1 / n)) AS w, m1, m2, greatest(1e-6, q1 / s1 - m1 * m1) AS v1, greatest(1e-6, q2 / s2 - m2 * m2) AS v2, ll
  FROM (SELECT *, x1 / s1 AS m1, x2 / s2 AS m2 FROM (SELECT hard_label, feature, any_value(n) AS n, sum(l) AS ll, sum(g) AS s1, sum(g * x) AS x1, sum(g * x * x) AS q1, sum(1 - g) AS s2, sum((1 - g) * x) AS x2, sum((1 - g) * x * x) AS q2
  FROM (SELECT *, exp(l1 - l) AS g FROM (SELECT *, greatest(l1, l2) + ln(exp(l1 - greatest(l1, l2)) + exp(l2 - greatest(l1, l2))) AS l FROM (SELECT bx.*, n, {log_p("w", "m1", "v1")} AS l1, {log_p("(1 - w)", "m2", "v2")} AS l2 FROM bx JOIN b{i - 1} USING (hard_label, feature)))) GROUP BY hard_label, feature)))""")
    return ", " + ",\n".join(ctes) + f"""
SELECT hard_label, feature, CAST(n AS BIGINT) AS n, round(bic_1, 3) AS bic_1, round(bic_2, 3) AS bic_2, round(CASE WHEN bic_2 < bic_1 - 2 THEN least(w, 1 - w) ELSE 0.0 END, 5) AS minority_fraction, bic_2 < bic_1 - 2 AS bimodal
FROM (SELECT f.hard_label, f.feature, o.n, f.w, 2 * ln(o.n) + o.n * (ln({2 * math.pi!r} * o.v) + 1) AS bic_1, 5 * ln(o.n) - 2 * f.ll AS bic_2 FROM b{BIMODAL_STEPS} f JOIN b_one o USING (hard_label, feature))"""


@query("lab", _bimodality_sql())
def g_bimodality(spark, d):
    found = contamination.bimodality(labels(spark, d), iterations=BIMODAL_STEPS)
    return found.withColumns({"bic_1": F.round("bic_1", 3), "bic_2": F.round("bic_2", 3), "minority_fraction": F.round("minority_fraction", 5)})


@query("clustered", "SELECT cluster_id, arg_min(g, (-n, g)) AS truth_id FROM (SELECT cluster_id, g, count(*) AS n FROM clustered GROUP BY cluster_id, g) GROUP BY cluster_id")
def g_truth_matched(spark, d):
    return contamination.match_truth(clustering.cluster_hits(hits(spark, d)))


# --- patches


def sparse(spark, d):
    return patches.patches(grouped(spark, d), feats(spark, d))


@query("patch", "SELECT cluster_id, px, py, round(ch0, 6) AS ch0, ch1 FROM patch")
def i_patch_sparse(spark, d):
    return sparse(spark, d).select("cluster_id", "px", "py", *six("ch0"), "ch1")


@query(
    "patch",
    "SELECT channel, round(m, 6) AS mean, round(sqrt(greatest(q - m * m, 0.0)) + 1e-6, 6) AS std FROM (SELECT channel, sum(v) / n AS m, sum(v * v) / n AS q FROM (SELECT 0 AS channel, ch0 AS v FROM patch UNION ALL SELECT 1, ch1 FROM patch), (SELECT count(*) * 256.0::DOUBLE AS n FROM sums) GROUP BY channel, n)",
)
def i_channel_stats(spark, d):
    return patches.channel_stats(sparse(spark, d), feats(spark, d).count())


@query("patch", "SELECT n_patches, n_clusters FROM (SELECT count(DISTINCT cluster_id) AS n_patches FROM patch), (SELECT count(*) AS n_clusters FROM sums)")
def i_coverage(spark, d):
    return patches.coverage(sparse(spark, d), feats(spark, d))


TURNS = ["px", "15 - py", "15 - px", "py"], ["py", "px", "15 - py", "15 - px"]


@query("patch", " UNION ALL ".join(f"SELECT cluster_id, {i + 4 * flip} AS variant, CAST({f'15 - ({x})' if flip else x} AS INT) AS px, CAST({y} AS INT) AS py, round(ch0, 6) AS ch0, ch1 FROM patch" for flip in (0, 1) for i, (x, y) in enumerate(zip(*TURNS, strict=True))))
def i_dihedral(spark, d):
    return patches.dihedral(sparse(spark, d)).select("cluster_id", "variant", "px", "py", *six("ch0"), "ch1")


@query("pred", "SELECT least(CAST(floor(label_confidence * 10) AS INT), 9) AS bin, count(*) AS n, round(avg(label_confidence), 6) AS mean_confidence, round(avg(CASE WHEN hard_label = predicted_label THEN 1 ELSE 0 END), 6) AS accuracy FROM pred WHERE hard_label >= 0 AND label_confidence < 1 GROUP BY 1")
def i_reliability(spark, d):
    return learning.reliability(ruled(spark, d).where("hard_label >= 0"), "label_confidence", F.col("hard_label") == F.col("predicted_label"))


@query("patch", "SELECT cluster_id, round(sum(ch0), 6) AS ch0, sum(ch1) AS ch1, any_value(n_pixels) AS n_pixels, any_value(tot_sum) AS tot_sum, any_value(tot_max) AS tot_max, round(any_value(eccentricity), 6) AS eccentricity, any_value(hard_label) AS hard_label, round(any_value(posterior_background), 6) AS posterior_background FROM patch JOIN lab USING (cluster_id) GROUP BY cluster_id")
def i_aligned(spark, d):
    """Patches with their scalars and labels; of each channel its sum."""
    rows = patches.filled(patches.aligned(patches.cells(sparse(spark, d)), labels(spark, d).withColumn("n_pixels", F.col("n_pixels").cast("long")), features.PATCH_SCALARS))
    whole = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rows.select("cluster_id", F.round(whole("ch0"), 6).alias("ch0"), whole("ch1").alias("ch1"), F.col("n_pixels").cast("long").alias("n_pixels"), "tot_sum", "tot_max", *six("eccentricity"), "hard_label", *six("posterior_background"))


def _temperature_sql(steps: int = 40, low: float = 0.05, high: float = 10.0) -> str:
    """The grid search on fixed logits: the best of a geometric grid, then of one between its neighbours."""
    grid = lambda lo, hi, src: f"SELECT i, {lo} * pow({hi} / {lo}, i / {steps - 1}.0::DOUBLE) AS t FROM range({steps}) AS r(i){src}"
    best = lambda g: f"SELECT arg_min(i, (loss, i)) AS i FROM (SELECT i, avg(ln(exp((l0 - top) / t) + exp((l1 - top) / t) + exp((l2 - top) / t)) - (own - top) / t) AS loss FROM logits, {g} GROUP BY i)"
    return f""", logits AS MATERIALIZED (SELECT *, greatest(l0, l1, l2) AS top, CASE hard_label WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END AS own FROM (SELECT hard_label, (250 - folded_tof_ns) / 40 AS l0, (folded_tof_ns - 175) / 40 AS l1, abs(folded_tof_ns - 220) / 90 AS l2 FROM lab WHERE hard_label >= 0)),
g1 AS MATERIALIZED ({grid(f"{low}::DOUBLE", f"{high}::DOUBLE", "")}), k1 AS ({best("g1")}),
ends AS (SELECT (SELECT t FROM g1 WHERE g1.i = greatest(0, k1.i - 1)) AS lo, (SELECT t FROM g1 WHERE g1.i = least({steps - 1}, k1.i + 1)) AS hi FROM k1),
g2 AS MATERIALIZED ({grid("lo", "hi", ", ends")}), k2 AS ({best("g2")})
SELECT round(greatest(1e-3, t), 9) AS temperature FROM g2 JOIN k2 ON g2.i = k2.i"""


@query("lab", _temperature_sql())
def i_temperature_fixed(spark, d):
    """The temperature of fixed logits, which SQL can give too."""
    x = F.col("folded_tof_ns")
    values = learning.labelled(labels(spark, d)).groupBy("hard_label", "folded_tof_ns").agg(F.count("*").alias("n"))  # the logits rest on these two
    scored = fn.saved(values.select("hard_label", "n", F.array((250 - x) / 40, (x - 175) / 40, F.abs(x - 220) / 90).alias("logits")))
    return spark.createDataFrame([(round(learning.temperature(scored, "logits", "hard_label", weight="n"), 9),)], "temperature double")


def _perceptron(spark, d, block: str | None = None):
    """The scored rows, or those of one block. Patches stay cells until they are inputs of the model."""
    rows = patches.aligned(patches.cells(sparse(spark, d)), labels(spark, d), features.PATCH_SCALARS).where("hard_label >= 0")
    rows = fn.saved(learning.time_block_split(rows.withColumn("scalars", F.array(*features.PATCH_SCALARS))))
    inputs = ["ch0", "ch1", "scalars"]
    of = lambda name: patches.filled(rows.where(F.col("split") == name) if name else rows).withColumns({c: array_to_vector(c) for c in inputs})
    model = learning.fit_perceptron(of("train"), inputs, "hard_label", len(MEANS) + 1, val=of("val"))
    return model.transform(of(block))


@query()
def i_mlp(spark, d):
    return learning.class_report(_perceptron(spark, d, "test").withColumn("p", F.col("prediction").cast("int")), "hard_label", "p")


@query()
def i_temperature(spark, d):
    scored = fn.saved(_perceptron(spark, d, "val").select("hard_label", vector_to_array("rawPrediction").alias("logits")))  # read twice
    return spark.createDataFrame([(learning.temperature(scored, "logits", "hard_label"),)], "temperature double")


def _network(spark, d):
    """The convolution network over whole posteriors, and the test block. Patches stay cells until they are inputs."""
    names = ["posterior_peak_0", "posterior_peak_1", "posterior_background"]
    stats = fn.saved(patches.channel_stats(sparse(spark, d), feats(spark, d).count()))  # a row for each channel
    rows = patches.aligned(patches.cells(sparse(spark, d)), labels(spark, d), features.PATCH_SCALARS).where("hard_label >= 0")
    rows = fn.saved(learning.time_block_split(rows.withColumns({"scalars": F.array(*features.PATCH_SCALARS), "target": network.posterior(names)})))
    of = lambda name: patches.filled(rows.where(F.col("split") == name), stats)
    return of("test"), network.fit(of("train"), of("val"), 16, len(names))


@query()
def i_cnn(spark, d):
    test, fitted = _network(spark, d)
    return learning.class_report(fitted.transform(test), "hard_label", "prediction")


@query()
def i_saliency(spark, d):
    """The mean saliency map of each class over the test block."""
    test, fitted = _network(spark, d)
    return saliency_means(fitted.saliency(test, "cluster_id", "hard_label"))


# --- notebook measures


@query("hits", "SELECT x_pix, y_pix, count(*) AS n FROM hits GROUP BY x_pix, y_pix")
def n_hitmap(spark, d):
    return hits(spark, d).groupBy("x_pix", "y_pix").agg(F.count("*").alias("n"))


@query("hits", f"SELECT bin, count(*) AS n FROM (SELECT {bins_sql('tot', '0.0::DOUBLE', '600.0::DOUBLE', 100)} AS bin FROM hits) WHERE bin IS NOT NULL GROUP BY bin")
def n_tot_hist(spark, d):
    return fn.histogram(hits(spark, d), F.col("tot"), 0.0, 600.0, 100)


DESCRIBED = ["n_pixels", "tot_sum", "bbox_w", "dt_min_vs_argmax"]


@query("feats", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS low, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS high FROM feats" for c in DESCRIBED))
def n_describe(spark, d):
    rows = feats(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in DESCRIBED))).alias("e")).select("e.*")
    return rows.groupBy("name").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("low"),
        *(F.round(F.percentile("v", q), 6).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.max("v").alias("high"),
    )


@query("feats", f"SELECT what, bin, count(*) AS n FROM (SELECT 'size' AS what, {bins_sql('least(n_pixels, 50)', '0.0::DOUBLE', '50.0::DOUBLE', 50)} AS bin FROM feats UNION ALL SELECT 'duration', {bins_sql('least(t_max - t_min, 3000.0)', '0.0::DOUBLE', '3000.0::DOUBLE', 100)} FROM feats) GROUP BY what, bin")
def n_size_hist(spark, d):
    own = feats(spark, d)
    size = fn.histogram(own, F.least("n_pixels", F.lit(50)), 0.0, 50.0, 50).select(F.lit("size").alias("what"), "bin", "n")
    return size.unionByName(fn.histogram(own, F.least(F.col("t_max") - F.col("t_min"), F.lit(3000.0)), 0.0, 3000.0, 100).select(F.lit("duration").alias("what"), "bin", "n"))


@query("tof", "SELECT (SELECT count(*) FROM hits) AS n_hits, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM feats) AS n_clusters, (SELECT count(*) FROM tof WHERE tof_valid) AS n_valid")
def n_summary(spark, d):
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    own = counted(hits(spark, d), "n_hits").join(counted(adapters.edges(spark, d), "n_edges"), F.lit(True))  # one row each
    return own.join(flown(spark, d, 1785.0).agg(F.count("*").alias("n_clusters"), F.count_if("tof_valid").alias("n_valid")), F.lit(True))


@query("hits", "SELECT species, count(*) AS n, avg(CASE WHEN species = 9 THEN 1 ELSE 0 END) AS wrap_rate FROM (SELECT DISTINCT given_id, species FROM hits) GROUP BY species")
def n_truth_counts(spark, d):
    return adapters.truth(hits(spark, d)).groupBy("species").agg(F.count("*").alias("n"), F.avg("wrap_count").alias("wrap_rate"))


@query("feats", "SELECT cluster_id, n_pixels, tot_sum, round(eccentricity, 6) AS eccentricity, round(linearity, 6) AS linearity FROM feats ORDER BY md5(CAST(cluster_id AS VARCHAR)), cluster_id LIMIT 1000")
def n_sample(spark, d):
    """A thousand clusters for the scatter plots, picked by a hash that both engines have."""
    return feats(spark, d).orderBy(F.md5(F.col("cluster_id").cast("string")), "cluster_id").limit(1000).select("cluster_id", "n_pixels", "tot_sum", *six("eccentricity", "linearity"))


# --- generator and others


@query("edges", "SELECT 'hit' AS what, time_ns FROM hits UNION ALL SELECT 'edge', time_ns FROM edges")
def e_union(spark, d):
    return hits(spark, d).select(F.lit("hit").alias("what"), "time_ns").unionByName(adapters.edges(spark, d).select(F.lit("edge").alias("what"), "time_ns"))


@query("hits", "SELECT given_id, time_ns FROM hits WHERE given_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_filter(spark, d):
    done = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("given_id"))
    return hits(spark, d).select("given_id", "time_ns").join(done, "given_id", "left_semi")


def _given_span(spark, d) -> float:
    """How long the given pulses last: generated data cover as much time."""
    low, high = adapters.edges(spark, d).agg(F.min("time_ns"), F.max("time_ns")).first()
    return (high or 0.0) - (low or 0.0)


@query()
def e_synth_edges(spark, d):
    return synth.synth_edges(spark, _given_span(spark, d))


@query()
def e_synth_hits(spark, d):
    return synth.synth_hits(spark, _given_span(spark, d))[0]


@query("clustered", "SELECT t_min, t_max, n_pixels, tot_sum FROM (SELECT cluster_id, min(time_ns) AS t_min, max(time_ns) AS t_max, count(*) AS n_pixels, CAST(sum(tot) AS BIGINT) AS tot_sum FROM clustered GROUP BY cluster_id)")
def stream_clusters_batch(spark, d):
    """The stream's clusters over a bounded input."""
    return stream_clusters(hits(spark, d)).select("t_min", "t_max", "n_pixels", "tot_sum")
