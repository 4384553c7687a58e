"""Soft and hard labels from a mixture of Gaussians and a uniform background."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import histogram, normal_pdf, saved

LEAST_STD = 1.0


@dataclass(frozen=True)
class Mixture:
    """Weights (peaks, then background), means and stds; the log likelihood of the step before and of the last."""

    period: float
    weights: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    log_likelihood: float | None = None
    previous: float | None = None
    iterations: int = 0

    @classmethod
    def start(cls, period: float, means: list[float], stds: list[float], n_peaks: int | None = None) -> Mixture:
        k = n_peaks or len(means)
        if len(means) < k or len(stds) < k:
            raise ValueError(f"{k} peaks need as many means and stds")
        return cls(period, (1 / (k + 1),) * (k + 1), tuple(map(float, means[:k])), tuple(max(LEAST_STD, float(s)) for s in stds[:k]))

    @property
    def names(self) -> list[str]:
        return [*(f"peak_{i}" for i in range(len(self.means))), "background"]

    def densities(self, x: Column) -> list[Column]:
        """Weighted densities of the components."""
        peaks = [F.lit(w) * normal_pdf(x, m, s) for w, m, s in zip(self.weights, self.means, self.stds, strict=False)]
        return [*peaks, F.when(x.isNotNull(), F.lit(self.weights[-1] / self.period))]

    def posteriors(self, x: Column) -> list[Column]:
        own = self.densities(x)
        total = F.greatest(sum(own[1:], own[0]), F.lit(1e-300))
        return [d / total for d in own]


def fit(values: DataFrame, column: str, start: Mixture, iterations: int = 200, tolerance: float = 1e-6) -> Mixture:
    """Expectation maximisation; one aggregate over the distinct values per iteration, a few numbers to the driver."""
    x = values.select(F.col(column).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").cast("double").alias("n"))
    x, now = saved(x), start
    for step in range(iterations):
        own = [f"d{i}" for i in range(len(now.weights))]
        rows = x.select("x", "n", *(d.alias(c) for c, d in zip(own, now.densities(F.col("x")), strict=True)))
        rows = rows.withColumn("total", F.greatest(sum((F.col(c) for c in own[1:]), F.col(own[0])), F.lit(1e-300)))
        rows = rows.select("x", "n", F.log("total").alias("ll"), *((F.col(c) / F.col("total") * F.col("n")).alias(f"g{i}") for i, c in enumerate(own)))
        peaks = range(len(now.means))
        r = rows.agg(
            F.sum(F.col("ll") * F.col("n")).alias("ll"), F.sum("n").alias("n"), F.sum(f"g{len(now.means)}").alias("bg"),
            *(F.sum(f"g{i}").alias(f"s{i}") for i in peaks), *(F.sum(F.col(f"g{i}") * F.col("x")).alias(f"sx{i}") for i in peaks), *(F.sum(F.col(f"g{i}") * F.col("x") * F.col("x")).alias(f"sxx{i}") for i in peaks),
        ).first()
        if not r["n"]:
            return now
        size = [max(r[f"s{i}"], 1e-9) for i in peaks]
        means = [r[f"sx{i}"] / size[i] for i in peaks]
        stds = [max(LEAST_STD, math.sqrt(max(0.0, (r[f"sxx{i}"] - 2 * means[i] * r[f"sx{i}"] + means[i] ** 2 * r[f"s{i}"]) / size[i]))) for i in peaks]
        before = now.log_likelihood
        now = Mixture(now.period, tuple(r[f"s{i}"] / r["n"] for i in peaks) + (r["bg"] / r["n"],), tuple(means), tuple(stds), r["ll"], before, step + 1)
        if before is not None and abs(r["ll"] - before) < tolerance:
            break
    return now


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) in which value stands once, however often it is used: filters on the result are pushed below it and would repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def assign(clusters: DataFrame, mixture: Mixture, column: str = "folded_tof_ns", confidence: float = 0.9) -> DataFrame:
    """Adds posterior_<name>, label_confidence and hard_label (-1: ambiguous, K: background, null: no value)."""
    names, x = [f"posterior_{n}" for n in mixture.names], F.col(column)
    of = lambda a: [F.get(a, F.lit(i)) for i in range(len(names))]
    shares = _once(F.array(*mixture.densities(x)), lambda d: _once(F.greatest(sum(of(d)[1:], of(d)[0]), F.lit(1e-300)), lambda total: F.array(*(own / total for own in of(d)))))

    def labelled(p: Column, top: Column) -> Column:
        label = F.when(x.isNull(), None).when(top < confidence, -1).otherwise(F.array_position(p, top) - 1)
        return F.struct(*(own.alias(c) for c, own in zip(names, of(p), strict=True)), top.alias("label_confidence"), label.cast("int").alias("hard_label"))

    out = clusters.withColumn("assigned", _once(shares, lambda p: _once(F.greatest(*of(p)), lambda top: labelled(p, top))))
    return out.withColumns({c: F.col(f"assigned.{c}") for c in [*names, "label_confidence", "hard_label"]}).drop("assigned")


def label_clusters(clusters: DataFrame, period: float, means: list[float], stds: list[float], iterations: int = 200, confidence: float = 0.9) -> tuple[DataFrame, Mixture]:
    mixture = fit(clusters.where("tof_valid"), "folded_tof_ns", Mixture.start(period, means, stds), iterations)
    return assign(clusters, mixture, confidence=confidence), mixture


def fit_curve(labelled: DataFrame, mixture: Mixture, bins: int = 199, points: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The folded histogram and the model's curve on its scale."""
    hist = histogram(labelled, F.col("folded_tof_ns"), 0.0, mixture.period, bins)
    n = labelled.where("folded_tof_ns is not null").count()
    x = F.col("id") * F.lit(mixture.period / (points - 1))
    own = mixture.densities(x)
    curve = labelled.sparkSession.range(points).select(x.alias("x"), (sum(own[1:], own[0]) * F.lit(float(n)) * F.lit(mixture.period) / F.lit(float(bins))).alias("expected"))
    return hist, curve


def confidence_histogram(labelled: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(labelled, F.col("label_confidence"), 0.0, 1.0, bins)


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("hard_label").agg(F.count("*").alias("n"))
