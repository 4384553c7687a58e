"""Measures of how far labels are contaminated."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import histogram, saved

MORPHOLOGY = ["n_pixels", "tot_sum", "tot_max", "eccentricity"]


def baseline_density(df: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """One row: (n, n_window, density) of folded times in a window without peaks, per ns and row."""
    x = F.col("folded_tof_ns")
    own = df.where(x.isNotNull()).agg(F.count("*").alias("n"), F.count_if((x >= low) & (x < high)).alias("n_window"))
    return own.withColumn("density", F.when(F.col("n") > 0, F.col("n_window") / (F.col("n") * F.lit(high - low))).otherwise(0.0))


def class_fractions(df: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """(hard_label, n, mislabel_fraction): an indicator, density times the span of the class, at most 1. The input is read once."""
    x = F.col("folded_tof_ns")
    per = df.where(x.isNotNull()).groupBy("hard_label").agg(F.count("*").alias("n"), F.count_if((x >= low) & (x < high)).alias("n_window"), (F.max(x) - F.min(x)).alias("span"))
    whole = Window.partitionBy(F.lit(0))  # over a row for each class
    per = per.withColumn("density", F.sum("n_window").over(whole) / (F.sum("n").over(whole) * F.lit(high - low)))
    return per.where("hard_label >= 0").select("hard_label", "n", F.round(F.least(F.lit(1.0), F.col("density") * F.col("span")), 4).alias("mislabel_fraction"))


def tidy(df: DataFrame, features: list[str] = MORPHOLOGY) -> DataFrame:
    """(hard_label, feature, value) of labelled rows."""
    return df.where("hard_label >= 0").select("hard_label", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("e")).select("hard_label", "e.feature", "e.value").where("value is not null")


def bimodality(df: DataFrame, features: list[str] = MORPHOLOGY, least: int = 10, iterations: int = 30) -> DataFrame:
    """(hard_label, feature, n, bic_1, bic_2, minority_fraction, bimodal) of classes with `least` rows; the fraction is 0 where the class is not bimodal.

    Values are log1p(x - min + 1e-3). One and two Gaussians are compared by BIC. All groups are
    fitted at once: an iteration is one aggregate over distinct values, and its parameters are one
    row per group.
    """
    groups = ["hard_label", "feature"]
    rows = saved(tidy(df, features).groupBy(*groups, "value").agg(F.count("*").cast("double").alias("n")))  # the clusters are read here only
    low = rows.groupBy(*groups).agg(F.min("value").alias("low"), F.sum("n").alias("size")).where(F.col("size") >= least)
    x = saved(rows.join(F.broadcast(low), groups).select(*groups, F.log1p(F.col("value") - F.col("low") + 1e-3).alias("x"), "n"))  # a row of low for each class and feature
    total = F.sum("n")
    mean, square = F.sum(F.col("n") * F.col("x")) / total, F.sum(F.col("n") * F.col("x") * F.col("x")) / total
    one = {tuple(r[g] for g in groups): r for r in x.groupBy(*groups).agg(total.alias("n"), mean.alias("m"), F.greatest(square - mean * mean, F.lit(1e-6)).alias("v"), F.expr("percentile(x, 0.1, cast(n as long))").alias("a"), F.expr("percentile(x, 0.9, cast(n as long))").alias("b")).collect()}
    spark = df.sparkSession
    now = {k: (0.5, r["a"], r["b"], r["v"], r["v"], -math.inf) for k, r in one.items()}
    for _ in range(iterations):
        if not now:
            break
        params = spark.createDataFrame([(*k, *map(float, p[:5])) for k, p in now.items()], "hard_label int, feature string, w double, m1 double, m2 double, v1 double, v2 double")
        own = x.join(F.broadcast(params), groups)  # a row for each class and feature
        log_p = lambda w, m, v: F.log(w) - (F.col("x") - F.col(m)) * (F.col("x") - F.col(m)) / (2 * F.col(v)) - F.log(F.col(v) * (2 * math.pi)) / 2
        own = own.withColumns({"l1": log_p(F.col("w"), "m1", "v1"), "l2": log_p(1 - F.col("w"), "m2", "v2")})
        own = own.withColumn("top", F.greatest("l1", "l2")).withColumn("ll", F.col("top") + F.log(F.exp(F.col("l1") - F.col("top")) + F.exp(F.col("l2") - F.col("top"))))
        own = own.withColumn("g", F.exp(F.col("l1") - F.col("ll")) * F.col("n"))
        h, v = F.col("n") - F.col("g"), F.col("x")
        sums = own.groupBy(*groups).agg(F.sum(F.col("ll") * F.col("n")).alias("ll"), F.sum("n").alias("n"), F.sum("g").alias("s1"), F.sum(F.col("g") * v).alias("x1"), F.sum(F.col("g") * v * v).alias("q1"), F.sum(h).alias("s2"), F.sum(h * v).alias("x2"), F.sum(h * v * v).alias("q2"))
        for r in sums.collect():
            s1, s2 = max(r["s1"], 1e-9), max(r["s2"], 1e-9)
            m1, m2 = r["x1"] / s1, r["x2"] / s2
            now[tuple(r[g] for g in groups)] = (min(1 - 1e-6, max(1e-6, s1 / r["n"])), m1, m2, max(1e-6, r["q1"] / s1 - m1 * m1), max(1e-6, r["q2"] / s2 - m2 * m2), r["ll"])
    out = []
    for k, r in one.items():
        n = r["n"]
        bic1 = 2 * math.log(n) + n * (math.log(2 * math.pi * r["v"]) + 1)
        bic2 = 5 * math.log(n) - 2 * now[k][5]
        bimodal = bic2 < bic1 - 2
        out.append((*k, int(n), bic1, bic2, min(now[k][0], 1 - now[k][0]) if bimodal else 0.0, bimodal))
    return spark.createDataFrame(out, "hard_label int, feature string, n long, bic_1 double, bic_2 double, minority_fraction double, bimodal boolean")


def disagreement(df: DataFrame, confidence: float = 0.8) -> DataFrame:
    """(hard_label, predicted_label, n) of confident labels that the classifier contradicts."""
    rows = df.where((F.col("hard_label") >= 0) & F.col("predicted_label").isNotNull() & (F.col("label_confidence") >= confidence) & (F.col("hard_label") != F.col("predicted_label")))
    return rows.groupBy("hard_label", "predicted_label").agg(F.count("*").alias("n"))


def truth_check(df: DataFrame, truth: DataFrame, estimate: float | None = None, key: str = "cluster_id") -> DataFrame:
    """(n, true_fraction, estimate, error) of wrapped clusters over the ids that both sides have; error is null without an estimate."""
    own = df.select(key).join(truth.select(key, "wrap_count"), key).agg(F.count("*").alias("n"), F.avg((F.col("wrap_count") > 0).cast("int")).alias("true_fraction"))
    return own.withColumn("estimate", F.lit(estimate).cast("double")).withColumn("error", F.abs(F.col("true_fraction") - F.col("estimate")))


def match_truth(clustered: DataFrame) -> DataFrame:
    """(cluster_id, truth_id): the generated cluster that most hits of a cluster came from (`key`), the smallest among equals."""
    votes = clustered.where("key is not null").groupBy("cluster_id", "key").agg(F.count("*").alias("n"))
    return votes.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("key").cast("long").alias("key"))).alias("best")).select("cluster_id", F.col("best.key").alias("truth_id"))


def morphology_histograms(df: DataFrame, feature: str, low: float, high: float, bins: int = 50) -> DataFrame:
    return histogram(df.where("hard_label >= 0"), F.col(feature).cast("double"), low, high, bins, "hard_label")
